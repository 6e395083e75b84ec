"""Merkle manifest of a dataset, with nested-interval labels.

Leaves are rows; the rows of a host form a tree in which every ``fan`` consecutive nodes have
a parent, and the hosts' roots form one more tree. A node's label is the interval [lo, hi] of
leaf ranks that it covers, so an ancestor is a node whose interval contains another's, and a
node's siblings are what its parent's interval holds besides its own.

Levels have widths fan, fan^2, ...; a node's bucket on a level is lo div width, which its only
ancestor there shares. So ancestors are attached by an equi-join on (tree, bucket) with
containment of intervals as its condition, one level after the other from the top; each level
is ``fan`` times smaller than the one below, and a bucket has at most ``fan`` rows on either
side. Ranks come from a range partitioning, whatever part of the rows one host has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import materialise, ranked

FAN = 16
#: Steps from a node up to the root: what stands left and right of it under each ancestor.
PATH = "array<struct<left:string,right:string>>"
ROOT_TREE = ""


def sha(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(column: Column) -> Column:
    """A value as ``length:value``, the length in UTF-8 bytes; null is ``-``."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, ascii_uppercase, ascii_lowercase)


def step(children: Column, lo: Column, hi: Column) -> Column:
    """The siblings of [lo, hi] among ``children``: the rest of their parent's interval, on its left and on its right."""
    side = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda x: x.digest), "")
    return F.struct(side(lambda x: x.hi < lo).alias("left"), side(lambda x: x.lo > hi).alias("right"))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: sha(x.left, acc, x.right))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings, level by level upwards, left to right."""
    return sha(F.array_join(F.transform(path, lambda x: F.concat(x.left, x.right)), ""))


@dataclass
class Forest:
    """Levels above the leaves, each (tree, lo, hi, n, digest, children), and the roots (tree, digest)."""

    levels: list[DataFrame]
    roots: DataFrame
    fan: int

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, digest) of every node above the leaves."""
        parts = [level.select("tree", F.lit(k).alias("level"), "lo", "hi", "digest") for k, level in enumerate(self.levels, 1)]
        out = parts[0] if parts else self.roots.select("tree", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), "digest").limit(0)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """Leaves' payloads with digest, path (a step for each ancestor) and what ``above`` has: (tree, path), the steps above each tree's root, and other columns."""
        # A tree's top family starts from what is above; families below are contained in exactly one of the level above.
        more = [c for c in above.columns if c not in ("tree", "path")]
        kept = ["tree", "lo", "hi", "n", "children", *more]
        reached: DataFrame | None = None
        for k in range(len(self.levels), 0, -1):
            families, width = self.levels[k - 1], self.fan**k
            here = families.filter(F.col("n") <= width).join(above, "tree").select(*kept, "path")
            if reached is not None:
                bucket = F.expr(f"lo div {width * self.fan}").alias("bucket")
                parents = reached.select("tree", bucket, F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("children").alias("family"), F.col("path").alias("up"), *more)
                inside = (F.col("plo") <= F.col("lo")) & (F.col("hi") <= F.col("phi"))
                path = F.concat(F.array(step(F.col("family"), F.col("lo"), F.col("hi"))), F.col("up"))
                inner = families.filter(F.col("n") > width).select("*", bucket).join(parents, ["tree", "bucket"]).filter(inside)
                here = inner.select(*kept, path.alias("path")).unionByName(here)
            reached = materialise(here, "merkle-paths") if k > 1 else here
        own = F.concat(F.array(step(F.col("children"), F.col("leaf.lo"), F.col("leaf.hi"))), F.col("path"))
        # A tree of one leaf has no step: the leaf is its root.
        return reached.withColumn("leaf", F.explode("children")).select("leaf.payload", "leaf.digest", F.when(F.col("n") == 1, F.col("path")).otherwise(own).alias("path"), *more)


def grow(leaves: DataFrame, fan: int) -> Forest:
    """Parents of every ``fan`` consecutive nodes, level by level, until each tree has one node.

    ``leaves``: (tree, lo, hi, n, digest, payload). A tree of one leaf gets a family of that leaf, whose digest is the leaf's own.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, width = [], fan
    below = leaves
    while True:
        own = ["payload"] if not levels else []
        children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", *own))).alias("children")
        # At most fan rows of a bucket on the level below.
        up = below.groupBy("tree", F.expr(f"lo div {width}").alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"), children)
        digest = F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(sha(F.array_join(F.transform("children", lambda x: x.digest), "")))
        levels.append(materialise(up.select("tree", "lo", "hi", "n", digest.alias("digest"), "children"), "merkle-level"))
        if width >= most:
            break
        below, width = levels[-1].filter(F.col("n") > width).drop("children"), width * fan
    tops = [level.filter(F.col("n") <= fan**k).select("tree", "digest") for k, level in enumerate(levels, 1)]
    roots = tops[0]
    for part in tops[1:]:
        roots = roots.unionByName(part)
    return Forest(levels, roots, fan)


@dataclass
class Manifest:
    """``leaves``: the payload's columns, digest, path, subroot and root of every row; ``nodes``: (tree, level, lo, hi, digest) of hosts' trees and of the tree of roots, whose name is ROOT_TREE."""

    leaves: DataFrame
    nodes: DataFrame


def build_manifest(rows: DataFrame, id_col: str = "doc_id", host_col: str = "source", digest_col: str = "leaf", fan: int = FAN) -> Manifest:
    """Merkle trees of the hosts' rows and of the hosts.

    Leaves of a host ascend by id (null first, equal ids by digest); hosts by name (the null host first,
    then bytewise). Every ``fan`` consecutive nodes, and the fewer or single last ones, become their hash. A host of one row
    has that row's digest as its root. Other columns of ``rows`` go along as they are. No rows give no leaves and no nodes.
    """
    key = F.when(F.col(f"`{host_col}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")))
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    given = materialise(rows.select(key.alias("tree"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{digest_col}`").alias("digest"), payload.alias("payload")), "merkle-leaves")
    leaves = materialise(ranked(given, [F.col("id"), F.col("digest")]).drop("id"), "merkle-ranks")
    hosts = grow(leaves, fan)
    subroots = materialise(hosts.roots, "merkle-subroots")
    tops = materialise(ranked(subroots.select(F.lit(ROOT_TREE).alias("tree"), F.col("tree").alias("host"), "digest"), [F.col("host")]), "merkle-tops")
    joint = grow(tops.select("tree", "lo", "hi", "n", "digest", F.struct("host").alias("payload")), fan)
    root = joint.roots.first()  # one row, or none
    no_steps = subroots.sparkSession.range(1).select(F.lit(ROOT_TREE).alias("tree"), F.array().cast(PATH).alias("path"))
    above = joint.paths(no_steps).select(F.col("payload.host").alias("tree"), F.col("digest").alias("subroot"), "path")
    found = hosts.paths(materialise(above, "merkle-above"))
    return Manifest(found.select("payload.*", "path", "subroot", F.lit(root.digest if root else None).cast("string").alias("root")), joint.nodes().unionByName(hosts.nodes()))


def hash_documents(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """(id, host fields..., leaf, tampered_leaf): the digest of each row's ``fields``, and where ``tampered`` holds that of the row with the text's A-Z lower-cased, else null.

    A null field and an empty one differ; a null text can't be tampered with.
    """
    whole = sha(*[framed(F.col(f"`{c}`")) for c in fields])
    changed = sha(*[framed(lower_ascii(F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`")) for c in fields])
    kept = [F.col(f"`{c}`") for c in fields if c != text_col]
    mark = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    return docs.select(*kept, whole.alias("leaf"), F.when(mark, changed).alias("tampered_leaf"))


def prove_documents(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", tampered: Column | None = None, fan: int = FAN) -> DataFrame:
    """Every row's proof against the manifest of the untampered rows.

    Returns ``id_col``, leaf, subroot, root, proof_sha256 (digest of its siblings up to the root), folded_root
    (from the row's tampered digest, else its own, and the siblings) and verified (folded_root equals
    root). Rows are leaves each, repeated ones too; null ids come first in their host, null hosts form
    a tree of their own; null and empty texts hash apart; texts are hashed whole; ``tampered`` null
    counts as false. Columns other than ``fields`` are ignored. No rows give no rows.
    """
    hashed = hash_documents(docs, fields, id_col, text_col, tampered).select(F.col(f"`{id_col}`"), F.col(f"`{host_col}`"), "leaf", "tampered_leaf")
    leaves = build_manifest(hashed, id_col, host_col, "leaf", fan).leaves
    folded = leaves.withColumn("folded_root", fold(F.col("path"), F.coalesce("tampered_leaf", "leaf")))
    return folded.select(F.col(f"`{id_col}`"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
