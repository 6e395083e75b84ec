"""The whole pipeline against a plain version in Python; only the toxicity verdicts are taken as given."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from reelspan.llm.toxicity import ToxicityModel

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(text):
    """(base rules fail, any rule fails)"""
    t = text or ""
    words = WORD.findall(t)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    base = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return base, base or 10 * sum(c in "#*$%&|<>" for c in t) > sum(map(len, words))


def plain_quality(docs):
    hosts = {}
    for _, text, source in docs:
        if source is not None:
            hosts.setdefault(source, []).append(failures(text)[1])
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    m = f / n
    v = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / n - m * m - m * (1 - m) * len(hosts) / n
    k = 1e6 if v <= 0 else min(1e6, max(1.0, m * (1 - m) / v - 1))
    ok = {h: (sum(x) + m * k) / (len(x) + k) <= 0.5 for h, x in hosts.items()}
    return [d for d in docs if not failures(d[1])[0] and ok.get(d[2], True)]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_duplicates(docs):
    sets, label = [shingles(d[1]) for d in docs], list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i])
    return list(groups.values())


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(50_000)}" for _ in range(n))


def fixture():
    """Rows (id, text, source): junk, a bad host, toxic rows, near copies, repeated and null ids, a long text."""
    rng, out = random.Random(21), []
    for i in range(60):
        out.append((i, prose(rng, rng.randint(25, 120)), f"h{i % 5}"))
    out += [(100 + i, "too short", "spam") for i in range(12)] + [(120, prose(rng, 60), "spam")]
    out += [(130 + i, prose(rng, 30) + " bad", "h1") for i in range(4)]
    a, b = prose(rng, 100), prose(rng, 80)
    out += [(140, a, "h0"), (141, a + " end", "h1"), (142, a, None), (None, a, "h2"), (7, b, "h3"), (7, b, "h3"), (7, prose(rng, 50), "h3"), (None, prose(rng, 40), None), (150, None, "h4"), (151, "", "h4"), (152, "same line again " * 40, "h0")]
    out.append((160, prose(rng, 3000), "h2"))
    rng.shuffle(out)
    return out


def test_run_equals_the_plain_version(spark, tmp_path, monkeypatch):
    def verdicts(docs, model, id_col="doc_id", text_col="text", inside=False):
        return docs.selectExpr(id_col, "0D AS score", f"int({id_col}.text like '% bad%') AS predicted")

    monkeypatch.setattr(corpus_pipeline, "train_toxicity", lambda docs, labels, allowed: ToxicityModel())
    monkeypatch.setattr(corpus_pipeline, "score_toxicity", verdicts)
    rows = fixture()
    table = spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _row_number string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [d for d in plain_quality(rows) if " bad" not in (d[1] or "")]
    groups = plain_duplicates(left)
    assert len(left) < len(rows) - 15 and any(len(g) >= 4 for g in groups)
    starts = Counter(r.doc_id for r in got if r.start == 0)
    key = lambda i: (i is None, i or 0)
    expected = Counter(min((d[0] for d in g), key=key) for g in groups)
    assert starts == expected

    # The kept row of a group is one of its rows with the least id; ids of tokens as the library gives them.
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    wanted = Counter()
    for g in groups:
        least = min((d[0] for d in g), key=key)
        wanted[least, frozenset(len(library.encode(d[1] or "", add_special_tokens=False).ids) + 1 for d in g if d[0] == least)] += 1
    assert sum(wanted.values()) == sum(starts.values())
    by_id = {d[0]: d[1] for d in left}
    for (doc, total), parts in pieces.items():
        if doc is None or doc == 7:
            continue
        ids = library.encode(by_id[doc], add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == total == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        # Harmonic: a sequence holds pieces of one class, and no more of them than the class allows.
        classes = {1024 // n for _, n in parts}
        assert len(classes) == 1 and len(parts) <= classes.pop()
