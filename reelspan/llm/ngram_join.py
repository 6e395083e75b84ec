"""Exact n-gram Jaccard self-join by a count-vector R-tree.

Shingles are hashed into groups. With one set of groups, a document's group counts are a
point; the sum of the lesser coordinates of two points is never below the overlap of their
sets, so R-tree boxes and points that can't reach the needed overlap are cut off, and what
remains is verified on the sets themselves.

Points are brought together by a second set of groups. Two sets of at most b shingles that
are similar enough differ in at most D = 2 b (1 - t) / (1 + t) shingles. Dealt into more than
D groups, some group has the same shingles in both: its content is a cell that both fall in.
(E groups are added, so that the document's empty groups, up to E, need no cells.) Every
cell is split into blocks of bounded size, each with an R-tree of its own.

Links are looked for twice, so that a group of near copies doesn't give all its pairs. First,
leaders: the least point of a block takes every point that its bound lets through, the
least of the rest does the same, and only these pairs are verified. Then, with the
components of those links, points that aren't in the component of their cell's least
point search the trees again for points of other components. Pairs that are left out are
connected already.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import lean, materialise, plain_columns, sub_batches
from reelspan.llm.components import connected_components

#: Groups of the count vectors, sizes of one size class (greatest over least), points of a block and of a tree node.
GROUPS, CLASS_RATIO, BLOCK, FAN = 256, 1.5, 4096, 16
#: Bits of the filter that keeps texts from being shuffled in vain.
FILTER_BITS = 1 << 26
#: Cells of up to so many members are named by their members, so that equal ones fall together.
NAMED = 64
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words make one shingle, none make none."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out + codes[k : k + n])
    return np.unique(out)


def set_id(hashes: np.ndarray) -> int:
    """64-bit name of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def count_vector(hashes: np.ndarray) -> bytes:
    """Group counts in the least number of bytes that holds them all."""
    counts = np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype("u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def read_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // GROUPS}")


class Cells:
    """Cells of a set for a similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.classes: dict[int, tuple[int, int]] = {}

    def size_class(self, n: int) -> int:
        return int(math.log(max(n, 1)) / math.log(CLASS_RATIO) + 1e-9)

    def groups(self, size_class: int) -> tuple[int, int]:
        """(groups, of which extra) for pairs whose larger set is of this class."""
        if size_class not in self.classes:
            least, most = CLASS_RATIO**size_class, int(CLASS_RATIO ** (size_class + 1)) + 1
            least *= self.num / self.den
            apart = 2 * most * (self.den - self.num) // (self.den + self.num)
            extra = 1
            while True:
                empty = (apart + 1 + extra) * math.exp(-least / (apart + 1 + extra))
                if extra >= empty + 4 * math.sqrt(empty) or extra > apart:
                    break
                extra += 1
            self.classes[size_class] = apart + 1 + extra, extra
        return self.classes[size_class]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Names of the cells that a set falls in; equal sets need none, so some have none."""
        n = len(hashes)
        if n == 0:
            return np.zeros(0, dtype=np.int64)
        out = []
        first, last = self.size_class(n), self.size_class(n * self.den // self.num)
        content = mix(hashes ^ M2)
        for c in range(first, last + 1):
            m, extra = self.groups(c)
            # A group is a range of hash values, so it is a run of the sorted hashes.
            edges = (np.arange(m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
            starts = np.searchsorted(hashes, edges)
            ends = np.append(starts[1:], n)
            full = np.flatnonzero(ends > starts)
            sums = np.add.reduceat(content, starts[full])
            out.append(mix(sums + (full.astype(np.uint64) + np.uint64(c << 32)) * M1 + (ends - starts)[full].astype(np.uint64)))
            if m - len(full) > extra:
                out.append(mix(np.array([c], dtype=np.uint64) * M2))
        return np.concatenate(out).view(np.int64)


class CountTree:
    """R-tree over count vectors; a node keeps the greatest count of each group and the least size below it."""

    def __init__(self, points: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.points, self.sizes = points, points.sum(axis=1)
        order = np.argsort(self.sizes, kind="stable")
        slab = FAN * FAN
        for a in range(0, len(order), slab):  # tiles: by size, then by the coordinate that spreads most
            part = order[a : a + slab]
            order[a : a + slab] = part[np.argsort(points[part, np.argmax(np.ptp(points[part], axis=0))], kind="stable")]
        self.order = order
        most, least = points[order], self.sizes[order]
        self.levels = []
        while len(most) > 1:
            starts = np.arange(0, len(most), FAN)
            most, least = np.maximum.reduceat(most, starts, axis=0), np.minimum.reduceat(least, starts)
            self.levels.append((most, least))

    def reachable(self, most: np.ndarray, least: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Whether summed coordinate minima reach the overlap that the sizes need."""
        return (self.num + self.den) * np.minimum(most, point).sum(axis=1) >= self.num * (least + point.sum())

    def search(self, point: np.ndarray) -> np.ndarray:
        """Indices of the points whose bound lets them be similar to ``point``."""
        at = np.zeros(1, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            most, least = self.levels[depth]
            at = at[self.reachable(most[at], least[at], point)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
            at = at[at < below]
        at = self.order[at]
        return at[self.reachable(self.points[at], self.sizes[at], point)]


def leader_pairs(points: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """(leader, follower) positions: every point follows the first leader whose bound lets it through."""
    if len(points) < 2:
        return []
    tree, free, out = CountTree(points, num, den), np.ones(len(points), dtype=bool), []
    for i in range(len(points)):
        if free[i]:
            free[i] = False
            found = tree.search(points[i])
            found = found[free[found]]
            free[found] = False
            out.extend((i, j) for j in found.tolist())
    return out


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets overlap enough."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return den * shared >= num * (len(a) + len(b) - shared)


def batch(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups of consecutive rows with equal leading integer columns; a group must fit in memory."""
    here, gathered = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([np.asarray(b.column(c)) for c in range(keys)], axis=1)
        starts = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
        for x, y in zip([0, *starts], [*starts, b.num_rows]):
            group = tuple(k[x].tolist())
            if group != here and gathered:
                yield here, gathered
                gathered = []
            here = group
            gathered.append(b.slice(x, y - x))
    if gathered:
        yield here, gathered


def ints(parts: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.concatenate([np.asarray(p.column(column)) for p in parts])


def vectors(parts: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.stack([read_counts(v) for p in parts for v in p.column(column).to_pylist()]).astype(np.int32)


# -- the passes over documents -------------------------------------------------------


def describe(docs: DataFrame, words: int, id_col: str) -> DataFrame:
    """(``id_col``, n_shingles, sid, counts) per document; sid and counts are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sids, counts = [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(text, words)
                sizes.append(len(h))
                sids.append(set_id(h) if len(h) else None)
                counts.append(count_vector(h) if len(h) else None)
            yield batch([id_col, "n_shingles", "sid", "counts"], b.column(0), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(counts, pa.binary()))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(lean(run), f"`{id_col}` {kind}, n_shingles bigint, sid bigint, counts binary")


def cell_rows(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(cell, sid) for every cell of every set; a task names a set's cells once while it remembers the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = Cells(num, den), set()
        for b in batches:
            names, sids, held = [], [], 0
            for text in b.column(1).to_pylist():
                h = shingle_hashes(text, words)
                sid = set_id(h)
                if sid in seen or not len(h):
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                names.append(cells.of(h))
                sids.append(np.full(len(names[-1]), sid, dtype=np.int64))
                held += len(names[-1])
                if held > 500_000:
                    yield batch(["cell", "sid"], pa.array(np.concatenate(names)), pa.array(np.concatenate(sids)))
                    names, sids, held = [], [], 0
            if names:
                yield batch(["cell", "sid"], pa.array(np.concatenate(names)), pa.array(np.concatenate(sids)))

    return docs.mapInArrow(lean(run), "cell bigint, sid bigint")


def id_bits(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the hashes of some ids: FILTER_BITS bits, however many ids there are."""
    pages = ids.select(bit_of(column).alias("at")).groupBy(F.expr("at div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in pages.collect():  # FILTER_BITS / 32768 pages at most
        out[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def bit_of(column: str) -> Column:
    """Place of an id in the bitmap of id_bits."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def with_bit(b: pa.RecordBatch, at: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch whose bit (at ``at``) is set."""
    return b.filter(pa.array(((bits[at >> 3] >> (at & 7)) & 1).astype(bool)))


def perhaps_among(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows whose id is among ``ids``, and a few others, without a shuffle of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(id_bits(ids, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield with_bit(b, np.asarray(b.column(2)), shared.value).select([0, 1])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, bit_of(id_col).alias("_at")).mapInArrow(lean(run), f"`{id_col}` {kind}, `{text_col}` string")


def set_rows(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(sid, hashes) of the documents whose id is among ``ids``, and of a few others, in one pass that moves no text."""
    shared = docs.sparkSession.sparkContext.broadcast(id_bits(ids, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = with_bit(b, np.asarray(b.column(1)), shared.value).column(0).to_pylist()
            for start, end in sub_batches(texts):
                sets = [h for h in (shingle_hashes(t, words) for t in texts[start:end]) if len(h)]
                yield batch(["sid", "hashes"], pa.array([set_id(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()))

    return docs.select(text_col, bit_of(id_col).alias("_at")).mapInArrow(lean(run), "sid bigint, hashes binary")


# -- cells ----------------------------------------------------------------------------


def shared_cells(rows: DataFrame) -> DataFrame:
    """Cells with two different sets or more; cells with the same few members become one.

    Rows arrive sorted, and a long cell passes through in pieces, so nothing grows with a
    cell's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the open cell's rows, while it may still be short
        last, long_cell, named = None, False, set()

        def close() -> list[np.ndarray]:
            members = np.concatenate(held)[:, 1] if held else np.zeros(0, dtype=np.int64)
            if long_cell or len(members) < 2:
                return []
            name = set_id(members.view(np.uint64))
            if name in named:
                return []
            if len(named) > 200_000:
                named.clear()
            named.add(name)
            return [np.stack([np.full(len(members), name), members], axis=1)]

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], axis=1)
            keep = np.ones(len(rows), dtype=bool)
            keep[1:] = np.any(rows[1:] != rows[:-1], axis=1)
            if last is not None and (rows[0] == last).all():
                keep[0] = False
            rows = rows[keep]
            if not len(rows):
                continue
            out = []
            starts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            edges = [0, *starts.tolist(), len(rows)]
            sizes = np.diff(edges)
            for k, (x, y) in enumerate(zip(edges, edges[1:])):
                if k and sizes[k] == 1 and k < len(sizes) - 1:
                    if k == 1:
                        out += close()
                        held, long_cell = [], False
                    continue  # a cell of its own, opened and closed here
                if last is None or rows[x, 0] != last[0] or k:
                    out += close()
                    held, long_cell = [], False
                if long_cell:
                    out.append(rows[x:y])
                else:
                    held.append(rows[x:y])
                    if sum(map(len, held)) > NAMED:
                        out += held
                        held, long_cell = [], True
            last = rows[-1]
            if out:
                both = np.concatenate(out)
                yield batch(["cell", "sid"], pa.array(both[:, 0]), pa.array(both[:, 1]))
        if out := close():
            yield batch(["cell", "sid"], pa.array(out[0][:, 0]), pa.array(out[0][:, 1]))

    sorted_rows = rows.repartition("cell").sortWithinPartitions("cell", "sid")
    return sorted_rows.mapInArrow(lean(run), "cell bigint, sid bigint").distinct()


def in_blocks(members: DataFrame) -> DataFrame:
    """Adds block to (cell, sid, ...): a cell's rows are dealt so that blocks have about BLOCK of them.

    Only cells of more than BLOCK members are counted out; the least member of such a cell
    is in all its blocks.
    """
    sizes = members.groupBy("cell").agg(F.count("*").alias("k"), F.min("sid").alias("center"))
    blocks = F.expr(f"1 + (k - 1) div {BLOCK}")
    dealt = members.join(sizes, "cell").withColumn("blocks", blocks)
    own = F.array(F.pmod(F.xxhash64("sid"), F.col("blocks")))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return dealt.withColumn("block", F.explode(F.when(F.col("sid") == F.col("center"), everywhere).otherwise(own))).drop("k", "blocks")


def first_pairs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of leaders and followers in every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, parts in runs(batches, 2):
            sids, points = ints(parts, 2), vectors(parts, 3)
            for i, j in leader_pairs(points, num, den):
                a.append(int(sids[i]))
                b.append(int(sids[j]))
            if len(a) > 100_000:
                yield batch(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))
                a, b = [], []
        yield batch(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    # The cell's least member comes first in every block, being the least of all.
    rows = placed.select("cell", "block", "sid", "counts").repartition("cell", "block").sortWithinPartitions("cell", "block", "sid")
    pairs = rows.mapInArrow(lean(run), "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def second_pairs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs across components that the bound lets through, from rows (cell, block, sid, counts, label, center, main).

    Members outside their cell's main component search all blocks of the cell.
    """
    members = placed.select("cell", "block", F.lit(0).alias("kind"), "sid", "counts", "label")
    strays = placed.filter("label <> main").select("cell", "sid", "counts", "label").distinct()
    blocks = placed.select("cell", "block").distinct()
    travel = strays.join(blocks, "cell").select("cell", "block", F.lit(1).alias("kind"), "sid", "counts", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sids, labels, here = None, None, None, None
        for (cell, block, kind), parts in chunks(batches):
            if kind == 0:
                if (cell, block) != here:
                    here, sids, labels, points = (cell, block), ints(parts, 3), ints(parts, 5), vectors(parts, 4)
                    tree = CountTree(points, num, den)
                continue
            if (cell, block) != here:
                continue
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for sid, label, point in zip(ints(parts, 3).tolist(), ints(parts, 5).tolist(), vectors(parts, 4)):
                found = tree.search(point)
                found = found[labels[found] != label]
                a.append(np.full(len(found), sid, dtype=np.int64))
                b.append(sids[found])
            yield batch(["a", "b"], pa.array(np.concatenate(a)), pa.array(np.concatenate(b)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        """Runs whose members come whole, and whose strays come a batch at a time."""
        here, gathered = None, []
        for b in batches:
            for group, parts in runs(iter([b]), 3):
                if group != here and gathered:
                    yield here, gathered
                    gathered = []
                here = group
                if group[2] == 1:
                    yield group, parts
                else:
                    gathered += parts
        if gathered:
            yield here, gathered

    rows = members.unionByName(travel).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "sid")
    pairs = rows.mapInArrow(lean(run), "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [
                similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), num, den)
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            yield batch(["a", "b"], b.column(0), b.column(1)).filter(pa.array(ok, pa.bool_()))

    # The member's set joins first; a leader with many followers then meets them in a join that can be split.
    of_b = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("set_b"))
    of_a = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("set_a"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least num / den on word shingles.

    Returns ``id_col``, n_shingles and component_id, one row per row of the input. Words are
    runs of anything but the six ASCII white-space characters, A-Z lower-cased. A document with
    fewer words than a shingle has one shingle, its whole sequence; one with no words, or a null
    text, has none and is linked with nothing. component_id is the least id reachable by
    links, the row's own included; equal sets are linked. Rows that repeat an id are each linked
    by their own text. A row whose id is null is linked like any other, and its component_id is null
    only if no row with an id is reachable. Other columns are ignored. No rows give no rows. Shingles
    and sets are told apart by 64-bit hashes.
    """
    source = plain_columns(docs, (id_col, text_col))
    described = materialise(describe(source, words, id_col), "shingles")
    members = materialise(shared_cells(cell_rows(source, words, num, den)), "cells")
    # One document stands for each set that shares a cell.
    wanted = members.select("sid").distinct()
    firsts = described.filter(F.col("sid").isNotNull()).groupBy("sid").agg(F.min(id_col).alias(id_col), F.first("counts").alias("counts"))
    points = materialise(firsts.join(wanted, "sid", "left_semi"), "points")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets that are paired; a set comes from the document of least id that has it."""
        ends = materialise(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "ends")
        named = points.join(ends, "sid", "left_semi").select(id_col)
        # The semi-join drops what the bitmap let through in vain.
        own = set_rows(source, named, words, id_col, text_col).join(ends, "sid", "left_semi")
        return materialise(own.dropDuplicates(["sid"]), "sets")

    def with_counts(rows: DataFrame) -> DataFrame:
        return rows.join(points.select("sid", "counts"), "sid")

    placed = materialise(in_blocks(members), "blocks")
    pairs = materialise(first_pairs(with_counts(placed), num, den), "pairs")
    links = materialise(verified(pairs, sets_of(pairs), num, den), "links")
    labels = materialise(connected_components(links), "labels")
    labelled = placed.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mains = labelled.filter(F.col("sid") == F.col("center")).select("cell", F.col("label").alias("main")).distinct()
    labelled = materialise(labelled.join(mains, "cell"), "labelled")
    split = materialise(labelled.filter("label <> main").select("cell").distinct(), "split")  # cells of several components
    if not split.isEmpty():
        searched = with_counts(labelled.join(split, "cell", "left_semi"))
        more = materialise(second_pairs(searched, num, den).join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = materialise(verified(more, sets_of(more), num, den), "links")
        if not more.isEmpty():
            labels = materialise(connected_components(links.unionByName(more)), "labels")
    # Back from sets to documents.
    least = described.filter(F.col("sid").isNotNull()).groupBy("sid").agg(F.min(id_col).alias("first"))
    least = least.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    by_label = least.groupBy("label").agg(F.min("first").alias("component_id"))
    by_set = least.join(by_label, "label").select("sid", "component_id")
    return described.join(by_set, "sid", "left").select(id_col, "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id"))
