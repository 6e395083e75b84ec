import base64
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import rows
from pyspark.sql import functions as F

from reelspan.llm.license_scan import RUNS, TEMPLATES, scale_of, scan_licenses, shingle_list, shingles_of, sure_run, words_in
from reelspan.llm.quality_rules import apply_quality_rules, host_verdicts, measure
from reelspan.llm.sharding import fill, ring_nodes, shard_documents
from reelspan.llm.token_counts import TokenRollup, count_tokens


def plain_repeats(words, n=8):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = set()
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            inside |= set(range(i, i + n))
    return len(inside)


def test_measures():
    rng = random.Random(0)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        assert measure(" ".join(words))[4] == plain_repeats(words)
    assert measure("a# b\n\n a\n a\nb é") == (5, 8, 1, 1, 0)


def test_hosts_shrink_towards_the_corpus(spark):
    data = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 200 + [("one", True)] + [(None, True)]
    for h in range(30):
        data += [(f"h{h}", i % 10 == 0) for i in range(50)]
    v = {r.host: r for r in host_verdicts(spark.createDataFrame(data, "host string, failed boolean")).collect()}
    assert not v["bad"].host_ok and v["good"].host_ok and None not in v
    assert v["one"].shrunk_rate < 0.9 and v["one"].n_docs == 1


def test_bad_hosts_take_their_documents_along(documents, spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [good] * 30 + ["short"] * 9 + [good]
    docs = documents(texts).withColumn("source", F.when(F.col("doc_id") < 30, "fine").otherwise("spam"))
    out = apply_quality_rules(docs)
    assert out.filter("kept").count() == 30 and rows(out.filter("doc_id = 39"), "base_failed", "kept") == [(False, False)]


def test_rules_on_odd_rows(odd):
    out = apply_quality_rules(odd)
    assert out.count() == odd.count() and out.filter("doc_id is null").first().kept is False
    assert rows(out.filter("doc_id = 0"), "n_words", "base_failed") == [(0, True), (0, True)]
    assert apply_quality_rules(odd.limit(0)).count() == 0


VERSIONS = {v: P.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def plain_counts(texts):
    """{version: numbers of tokens} by the library itself."""
    out = {}
    for v, path in VERSIONS.items():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        out[v] = [len(own.encode_ordinary(t or "")) for t in texts]
    return out


def test_counts_equal_the_library(spark, documents):
    rng = random.Random(2)
    texts = [None, "", " ", "a  b", "don't\n\n x", "é" * 300, "<|endoftext|>"] + ["".join(rng.choice("ab cé\n\t'st1.🙂") for _ in range(rng.randint(1, 200))) for _ in range(100)]
    got = {}
    for r in count_tokens(documents(texts), VERSIONS, P.PATTERN).collect():
        got.setdefault(r.tokenizer_version, {})[r.doc_id] = r.n_tokens
    assert got == {v: dict(enumerate(n)) for v, n in plain_counts(texts).items()}


def test_rollup_counts_batches_once(spark, documents):
    def counted(*texts):
        return count_tokens(documents(texts), {"v": VERSIONS["byte_bpe_50k"]}, P.PATTERN)

    docs = counted("a b", "c", None, "d e f")
    rollup = TokenRollup(spark)
    assert rollup.apply("one", inserted=docs) and not rollup.apply("one", inserted=docs)
    rollup.apply("two", deleted=docs.filter("doc_id = 1"))
    rollup.apply("three", inserted=counted("a b c d"), deleted=docs.filter("doc_id = 0"))
    total = rollup.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert tuple(total) == (3, 7)
    again = TokenRollup(spark, rollup.path)
    assert rows(again.totals()) == rows(rollup.totals())
    # Totals that a lost writer left without a commit don't count.
    docs.limit(1).selectExpr("source", "lang", "tokenizer_version", "1L n_docs", "99L n_tokens").write.parquet(f"{rollup.path}/totals/lost")
    assert rows(again.totals()) == rows(rollup.totals()) and tuple(again.totals().agg(F.sum("n_docs")).first()) == (3,)
    for attempt in "!~":
        rollup.totals().write.parquet(f"{rollup.path}/totals/{attempt}")
    # Of two commits of one version the first attempt by name counts; the other batch can be sent again.
    spark.createDataFrame([(4, "four", "~")], "version bigint, batch_id string, attempt string").write.mode("append").parquet(f"{rollup.path}/commits")
    spark.createDataFrame([(4, "other", "!")], "version bigint, batch_id string, attempt string").write.mode("append").parquet(f"{rollup.path}/commits")
    assert [r.batch_id for r in rollup.commits().filter("version = 4").collect()] == ["other"]
    assert rollup.apply("four", inserted=docs) and not rollup.apply("other", inserted=docs)
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == 7


def test_a_commit_reads_the_last_totals_only(spark, documents):
    rollup = TokenRollup(spark)
    docs = count_tokens(documents(["a", "b"]), {"v": VERSIONS["byte_bpe_50k"]}, P.PATTERN)
    for k in range(3):
        rollup.apply(f"b{k}", inserted=docs)
    assert len(rollup.totals().inputFiles()) >= 1 and all(f"/totals/{rollup._latest()[1]}" in f for f in rollup.totals().inputFiles())
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == 6


def test_rollup_on_odd_rows(spark, odd):
    rollup = TokenRollup(spark)
    counted = count_tokens(odd, VERSIONS, P.PATTERN)
    rollup.apply("all", inserted=counted)
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == odd.count() * 2
    assert rollup.totals().filter("lang is null").count() == 2
    rollup.apply("gone", deleted=counted)
    rollup.apply("none", inserted=count_tokens(odd.limit(0), VERSIONS, P.PATTERN))
    assert rollup.totals().count() == 0


def plain_licenses(text, percent=80):
    words, out = words_in(text or ""), {}
    for name, notice in TEMPLATES.items():
        t = words_in(notice)
        width, scale, wanted = min(5, len(t)), scale_of(len(t)), set(shingles_of(t))
        grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
        for k in range(0, len(grams), scale // 2):
            shared = len(wanted & set(grams[k : k + scale + scale // 2 - width + 1]))
            if shared * 100 >= percent * len(wanted) and shared > out.get(name, (0,))[0]:
                out[name] = (shared, len(wanted), k)
    return out


def test_licenses_equal_plain_windows(documents):
    rng = random.Random(6)
    texts = []
    for _ in range(120):
        words = [rng.choice(["the", "license", "of", "copyright", "any", "person"]) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.8:
            notice = rng.choice(list(TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = notice
        texts.append(" ".join(words))
    got = {}
    for r in scan_licenses(documents(texts)).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.shared_shingles, r.template_shingles, r.first_word)
    for i, t in enumerate(texts):
        assert got.get(i, {}) == plain_licenses(t)


def test_runs_are_sure():
    """Whatever the damage that leaves 80 % of the shingles, a run of the promised length is left."""
    rng = random.Random(8)
    for n in range(1, 200):
        run = sure_run(n, 80)
        assert run in RUNS and sum(RUNS[run]) - 1 <= run
        for _ in range(40):
            lost, left = set(), n - -(-n * 80 // 100)
            while left >= 4 and rng.random() < 0.9:
                at = rng.randrange(n)
                lost |= set(range(at, min(n, at + 4)))
                left = n - -(-n * 80 // 100) - len(lost)
            if n - len(lost) < -(-n * 80 // 100):
                continue
            longest = max(len(x) for x in "".join(" " if i in lost else "x" for i in range(n)).split(" "))
            assert longest >= run


def plain_share(text, template):
    """Most of a template's shingles in a window of 1.5 times its scale, by a plain count over every window's start."""
    words, own = words_in(text), shingles_of(words_in(template))
    scale = 6
    while scale < len(words_in(template)):
        scale += (scale + 1) // 2
    size, best = scale + scale // 2, 0
    for k in range(0, max(1, len(words)), scale // 2):
        best = max(best, len(set(shingle_list(words[k : k + size])) & set(own)))
    return best, len(own)


def test_templates_of_any_length_by_their_whole(documents):
    """Damage in one half counts against the whole template, above 160 words as below."""
    rng, templates, texts = random.Random(4), {}, []
    for n in (150, 200, 700):
        words = [f"w{n}x{i}" for i in range(n)]
        templates[f"t{n}"] = " ".join(words)
        for share in (0.9, 0.85, 0.82, 0.78, 0.7):
            broken, lost = words[:], 0
            while lost < (1 - share) * (n - 4):  # all in the second half
                broken[rng.randrange(n // 2 + 5, n - 5)] = "changed"
                lost = n - 4 - sum("changed" not in broken[i : i + 5] for i in range(n - 4))
            texts.append("pad " * rng.randrange(9) + " ".join(broken))
        texts += [" ".join(words[: int(n * 0.9)]), "x y z " * 30 + " ".join(words) + " tail"]
    texts += ["nothing here", None]
    got = {(r.doc_id, r.license): (r.shared_shingles, r.template_shingles) for r in scan_licenses(documents(texts), templates).collect()}
    want = {(i, n): plain_share(t or "", x) for i, t in enumerate(texts) for n, x in templates.items()}
    assert got == {k: v for k, v in want.items() if 100 * v[0] >= 80 * v[1]} and len(got) >= 12


def test_pieces_that_overlap_or_change_places_are_found(documents):
    """Breaks that cost no shingle: runs may be short, yet none of these is missed."""
    rng, texts = random.Random(6), []
    names = [n for n, t in TEMPLATES.items() if len(words_in(t)) >= 20]
    for _ in range(150):
        words, pieces, at = words_in(TEMPLATES[rng.choice(names)]), [], 0
        while at < len(words):
            length = rng.randint(5, 10)
            pieces.append(words[at : at + length])
            at += length - 4
        if rng.random() < 0.5:
            k = rng.randrange(len(pieces))
            pieces = pieces[k:] + pieces[:k]
        texts.append(" ".join(w for p in pieces for w in p))
    got = {}
    for r in scan_licenses(documents(texts)).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.shared_shingles, r.template_shingles, r.first_word)
    want = [plain_licenses(t) for t in texts]
    assert sum(map(len, want)) > 40 and [got.get(i, {}) for i in range(len(texts))] == want


def test_licenses_on_odd_rows(odd, spark):
    assert scan_licenses(odd).count() == 0
    assert scan_licenses(odd, {}).count() == 0
    assert rows(scan_licenses(odd.withColumn("text", F.lit("ALL rights; reserved"))), "license").count(("all-rights-reserved",)) == odd.select("doc_id").distinct().count()


def shards_of(df, shards):
    got = {}
    for r in df.collect():
        got.setdefault(r.shard, []).append(r.slot)
    for slots in got.values():
        assert sorted(slots) == list(range(len(slots)))
    return [len(got.get(s, [])) for s in range(shards)]


@pytest.mark.parametrize("n", [0, 1, 39, 40, 1003])
def test_shards_are_even(documents, n):
    counts = shards_of(shard_documents(documents([f"text {i}" for i in range(n)])), 40)
    assert sum(counts) == n and max(counts) - min(counts) <= 1


def test_a_hot_text_is_spread(documents):
    docs = documents(["same"] * 400 + [f"text {i}" for i in range(500)] + ["pair", "pair"])
    out = shard_documents(docs)
    counts = shards_of(out, 40)
    assert max(counts) - min(counts) <= 1
    # Most texts stay where an emptier ring would put them, so a document more moves few.
    more = {r.doc_id: r.shard for r in shard_documents(docs.unionByName(documents(["extra"], 5000))).collect()}
    moved = sum(more[r.doc_id] != r.shard for r in out.collect())
    assert moved < 0.2 * docs.count()


def plain_ring(keys, nodes, shards):
    """Rows by shard, one by one: groups in ring order to their node's shard while it has room, then what is left walks on."""
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out, left = {}, []
    for cell, key, i in sorted(keys):
        owner = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        if room[nodes[owner][1]]:
            out[i] = nodes[owner][1]
            room[nodes[owner][1]] -= 1
        else:
            left.append((owner, i))
    for owner, i in left:
        while not room[nodes[owner][1]]:
            owner = (owner + 1) % len(nodes)
        out[i] = nodes[owner][1]
        room[nodes[owner][1]] -= 1
    return out


def ring_of(spark, docs, shards, cells=16_384):
    key = F.when(F.col("text").isNull(), F.xxhash64(F.lit("id"), "doc_id")).otherwise(F.xxhash64("text"))
    rows = docs.select(F.pmod(key, F.lit(cells)).alias("c"), key.alias("k"), "doc_id").collect()
    return plain_ring([(r.c, r.k, r.doc_id) for r in rows], ring_nodes(spark, shards, 100, cells), shards)


def test_equals_a_plain_ring(spark, documents):
    texts = ["hot"] * 300 + ["warm"] * 10 + [f"text {i}" for i in range(680)] + [None] * 10
    docs = documents(texts)
    got = {r.doc_id: r.shard for r in shard_documents(docs).collect()}
    want = ring_of(spark, docs, 40)
    # Rows of one text may change places with each other, and texts of one cell where a shard ends.
    assert Counter((texts[i], s) for i, s in got.items() if texts[i]) == Counter((texts[i], s) for i, s in want.items() if texts[i])
    assert len({got[i] for i in range(300, 310)}) == 1  # a hundredth of the rows: whole


def test_movement_with_one_more_shard(documents):
    """With 41 shards each new shard's share must move; what else moves is the bounds' doing and stays limited."""
    docs = documents([f"text {i}" for i in range(2000)])
    a, b = ({r.doc_id: r.shard for r in shard_documents(docs, shards=n).collect()} for n in (40, 41))
    moved = sum(a[i] != b[i] for i in a)
    assert 2000 // 41 <= moved < 0.35 * 2000
    assert sum(s == 40 for s in b.values()) in (48, 49)


def test_copies_of_a_hot_text_without_id_spread(spark):
    docs = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CASE WHEN id < 2000 THEN 'hot' ELSE concat('t', id) END AS text").repartition(6)
    counts = shards_of(shard_documents(docs), 40)
    assert sum(counts) == 3000 and max(counts) - min(counts) <= 1


def test_fill_goes_on_clockwise():
    # Two shards on a ring of four cells; all rows on cell 0, which belongs to shard 0.
    segments = fill({0: 4, 2: 1}, [(0, 0), (1, 1)], 2, 4)
    assert segments == [(0, 0, 3, 0, 0), (0, 3, 4, 1, 0), (2, 0, 1, 1, 1)]


def test_shards_on_odd_rows(odd):
    out = shard_documents(odd, shards=4)
    assert out.count() == odd.count()
    assert rows(out.filter("doc_id = 0"), "size", "text_crc32") == [(16, 0), (16, 0)]
    counts = shards_of(out, 4)
    assert max(counts) - min(counts) <= 1
