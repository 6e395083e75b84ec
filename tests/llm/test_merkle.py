"""The manifest against plain trees in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelspan.llm.merkle import ROOT_TREE, build_manifest, fold, hash_documents, prove_documents

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def proofs(digests, fan):
    """(root, [siblings of each level for each leaf])"""
    nodes, at = list(digests), list(range(len(digests)))
    steps = [[] for _ in digests]
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for k, place in enumerate(at):
            run, own = runs[place // fan], place % fan
            steps[k].append((run[:own], run[own + 1 :]))
            at[k] = place // fan
        nodes = [h(*r) for r in runs]
    return nodes[0], steps


def folded(digest, steps):
    for left, right in steps:
        digest = h(*left, digest, *right)
    return digest


def plain(rows, fan=16):
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[1]].append(r)
    order = sorted(hosts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        hosts[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = proofs([leaf(r) for r in hosts[s]], fan)
    root, tops = proofs([trees[s][0] for s in order], fan)
    out = []
    for s, top in zip(order, tops):
        for r, steps in zip(hosts[s], trees[s][1]):
            steps = steps + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], r[4] and r[4].translate({c: c + 32 for c in range(65, 91)}))) if tampered else leaf(r)
            up = folded(now, steps)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[d for a, b in steps for d in a + b]), up, up == root))
    return sorted(out, key=str)


def got(spark, rows, fan=16, extra=False):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        docs = docs.withColumns({"leaf": F.lit("x"), "root": F.lit(1), "path": F.lit("y"), "lo": F.lit(7), "tree": F.lit("z")})
    out = prove_documents(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fan=fan)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def fixture():
    rng = random.Random(5)
    rows = []
    for i in range(330):
        source = rng.choice(["hot"] * 12 + ["b", "B", "é", "", None, f"h{i % 9}"])
        text = rng.choice([None, "", "Plain Text", "no capitals", "ÉCOLE", "x" * 50_000 + "Y"])
        rows.append((rng.choice([i, i, i, None, 7]), source, rng.choice(["en", None, ""]), rng.choice([None, len(text or "")]), text))
    return rows + rows[:5] * 3 + [(1000, "alone", "en", 3, "One")]


@pytest.mark.parametrize("fan", [16, 3])
def test_equals_plain_trees(spark, fan):
    rows = fixture()
    expected = plain(rows, fan)
    assert got(spark, rows, fan) == expected
    assert {r[-1] for r in expected} == {True, False}


def test_few_rows_and_none(spark):
    assert got(spark, []) == []
    one = [(5, "s", None, None, "Abc")]
    assert got(spark, one, extra=True) == plain(one)
    many = [(i, f"s{i:03}", "en", 1, "T") for i in range(40)]  # a host for each row
    assert got(spark, many) == plain(many)
    assert got(spark, [(i, "s", "en", 1, "T") for i in range(17)]) == plain([(i, "s", "en", 1, "T") for i in range(17)])  # a last run of one


def test_intervals_nest_and_nodes_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, "s" if i % 3 else f"t{i % 7}", "en", i, f"Text {i}") for i in range(600)], DOCS)
    manifest = build_manifest(hash_documents(docs))
    nodes = manifest.nodes.collect()
    for a in nodes:
        parents = [b for b in nodes if b.tree == a.tree and b.level == a.level + 1 and b.lo <= a.lo and a.hi <= b.hi]
        assert len(parents) == (1 if any(b.tree == a.tree and b.level > a.level for b in nodes) else 0)
    assert len([n for n in nodes if n.tree == ROOT_TREE]) == 1
    rows = manifest.leaves.select("*", fold(F.col("path"), F.col("leaf")).alias("up")).collect()
    assert len(rows) == 600 and all(r.up == r.root for r in rows)
