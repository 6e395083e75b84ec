"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

Every match of the pre-tokeniser's pattern is a row of byte positions. A segment
tree over the positions holds, at each node, the least ``rank * width + position``
below it, so its root names the leftmost pair of lowest rank. A merge writes three
leaves (the merged pair, its left neighbour and the position that died) and
repairs their paths: logarithmic work. Many matches of like length are merged in
step, one numpy operation for all of them; long matches have a tree of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspan.llm.common import kept, lean, plain_columns, sub_batches
from reelspan.llm.text_chunks import KEPT_CHARS, ChunkMemo

#: Matches longer than this many bytes are merged one by one.
LONGEST_IN_STEP = 256
NONE = np.int64(1) << 62


class Vocabulary:
    """Ranks of a tiktoken file, and the rank of every pair of tokens that merges."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.token = {r: t for t, r in self.rank.items()}
        self.text_of_id = {r: str(r) for r in self.token}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pair: dict[tuple[int, int], int] = {}
        for token, merged in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left, right] = merged
        keys = np.array([(a << 32) | b for a, b in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array(list(self.pair.values()), dtype=np.int64)[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two don't merge or either is missing (-1)."""
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_rank[at], NONE)

    # -- one match ---------------------------------------------------------------

    def merge_alone(self, piece: bytes) -> list[int]:
        """Ids of one long match; each merge costs a few paths of its segment tree."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        ids = [int(self.byte_id[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        pair = self.pair
        for i in range(n - 1):
            rank = pair.get((ids[i], ids[i + 1]))
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(position: int, value: int) -> None:
            node = width + position
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        def score(position: int) -> int:
            right = after[position]
            rank = pair.get((ids[position], ids[right])) if right < n else None
            return none if rank is None else rank * width + position

        while tree[1] != none:
            merged, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], ids[gone] = merged, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, score(at))
            if before[at] >= 0:
                put(before[at], score(before[at]))
        return [i for i in ids if i >= 0]

    # -- many matches in step ------------------------------------------------------

    def merge_in_step(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of matches of at most ``width`` bytes (a power of two), merged side by side."""
        rows = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((rows, width + 1), -1, dtype=np.int64)  # the last column stays "no token"
        ids[:, :width][inside] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (rows, 1))
        after[:, :width] = np.where(np.arange(1, width + 1) < lengths[:, None], np.arange(1, width + 1), width)
        before = np.tile(np.arange(-1, width), (rows, 1))  # -1 is the last column again
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width)
        tree[:, width:] = np.where(ranks == NONE, NONE, ranks * width + np.arange(width))
        for level in range(width.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            merged, at = np.divmod(tree[live, 1], width)
            gone = after[live, at]
            ids[live, at] = merged
            ids[live, gone] = -1
            right = after[live, gone]
            after[live, at] = right
            before[live, right] = at
            left = before[live, at]
            tree[live, width + gone] = NONE
            here = self.pair_ranks(merged, ids[live, right])
            tree[live, width + at] = np.where(here == NONE, NONE, here * width + at)
            there = self.pair_ranks(ids[live, left], merged)
            tree[live, width + np.where(left < 0, at, left)] = np.where(
                left < 0, tree[live, width + at], np.where(there == NONE, NONE, there * width + left)
            )
            for leaf in (gone, at, np.where(left < 0, at, left)):
                node = (width + leaf) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] != NONE]
        kept = ids[:, :width] >= 0
        flat, ends = ids[:, :width][kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each match; a match that is a token stays whole."""
        out: list[list[int] | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif not piece:
                out[i] = []
            elif len(piece) > LONGEST_IN_STEP:
                out[i] = self.merge_alone(piece)
            else:
                classes.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in classes.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                for i, ids in zip(some, self.merge_in_step([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join([self.token[i] for i in ids])


class Codec:
    """Encodes and decodes texts; what distinct parts of text give is kept, up to a bound."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.matches = regex.compile(pattern).findall
        self.seen: dict[str, tuple[int, str, bytes]] = {}
        self.memo = ChunkMemo(self._parts, self.matches, cap=300_000)

    def _parts(self, parts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of ids, their text, their decoded bytes) of each part."""
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        cut = list(map(self.matches, parts))
        new = [m for m in {m for ms in cut for m in ms} if m not in seen]
        token, name = self.vocabulary.token, self.vocabulary.text_of_id
        for m, ids in zip(new, self.vocabulary.encode_pieces([m.encode() for m in new])):
            if len(ids) == 1:
                seen[m] = 1, name[ids[0]], token[ids[0]]
            else:
                seen[m] = len(ids), " ".join([name[i] for i in ids]), b"".join([token[i] for i in ids])
        out = []
        for ms in cut:
            if len(ms) == 1:
                out.append(seen[ms[0]])
            else:
                several = [seen[m] for m in ms]
                out.append((sum([x[0] for x in several]), " ".join([x[1] for x in several]), b"".join([x[2] for x in several])))
        for m in new:
            if len(m) > KEPT_CHARS:
                del seen[m]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.memo.batch([text])[0] if part[0] for i in part[1].split(" ")]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, sha-256 of the ids' text, sha-256 of the decoded bytes) of each text."""
        out = []
        for parts in self.memo.batch(texts):
            counts, names, decoded = zip(*parts) if parts else ((), (), ())
            ids = " ".join(names)
            out.append((sum(counts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()))
        return out


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return kept("codec", (path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: (``id_col``, n_tokens, ids array<int>, decoded binary).

    A null text counts as empty and has no ids; repeated rows come out as often as they go in;
    columns other than the two named are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in sub_batches(texts):
                ids = [own.encode(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([own.vocabulary.decode(x) for x in ids], pa.binary()),
                    ],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return plain_columns(docs, (id_col, text_col)).mapInArrow(lean(run, "codec"), f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the encoding and of its decoding: (``id_col``, n_tokens, ids_sha256, decoded_sha256).

    Same cases as :func:`encode_documents`; the ids themselves don't leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [r for a, b in sub_batches(texts) for r in own.digests(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return plain_columns(docs, (id_col, text_col)).mapInArrow(lean(run, "codec"), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
