"""Harmonic packing of tokenised documents into sequences of bounded length.

Class j holds the pieces that are longer than ``capacity / (j + 1)`` and no longer than
``capacity / j``; each of its sequences takes j pieces, whatever they are, so no bin has
to know what another holds. Documents may be cut, so they are cut where it costs least:
whole sequences first, then pieces of exactly 1/2, 1/4 and 1/8 of the capacity, whose
classes fill without a gap, and a tail below 1/8, whose class wastes a ninth at most.

Every class is dealt into buckets by a hash of the document, each filled by a worker of
its own. A class has one bucket per 512 pieces (or per 8 sequences, if that is more),
so the one unfilled sequence that a bucket may leave stays a small share.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.llm.common import kept, lean, materialise, plain_columns, sub_batches
from reelspan.llm.text_chunks import ChunkMemo

PIECES_SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Pieces of a class that make it worth another bucket, and sequences likewise.
BUCKET_PIECES, BUCKET_SEQUENCES = 512, 8


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class IdEncoder:
    """Texts to little-endian unsigned 32-bit ids, as the tokenizers library gives them for a byte-level BPE file.

    That library spends most of its time on what it returns besides ids. So distinct parts of
    texts go to tiktoken, with the file's own vocabulary as ranks, which gives the same ids
    (tests compare them); texts that hold a special token's string go to tokenizers itself.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        alphabet = byte_alphabet()
        ranks = {bytes([alphabet[c] for c in t]): i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.separator = self.bpe.encode_ordinary("\r")[0]
        self.memo = ChunkMemo(self._ids, regex.compile(pattern).findall)

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each part. Parts are encoded in one call, a carriage return after each.

        It is a match of its own between parts that have none, nor white space at an end
        besides one leading space; other parts are encoded one by one.
        """
        together, alone = [], []
        for i, p in enumerate(parts):
            inner = p[1:] if p[:1] == " " else p
            (alone if not inner or "\r" in p or inner[0].isspace() or inner[-1].isspace() else together).append(i)
        out: list[bytes] = [b""] * len(parts)
        for at in range(0, len(together), 4096):
            some = together[at : at + 4096]
            ids = np.asarray(self.bpe.encode_ordinary("\r".join([parts[i] for i in some]) + "\r"), "<u4")
            ends = np.flatnonzero(ids == self.separator)
            if len(ends) != len(some):
                alone += some
                continue
            raw, start = ids.tobytes(), 0
            for i, end in zip(some, (4 * ends).tolist()):
                out[i] = raw[start:end]
                start = end + 4
        for i in alone:
            out[i] = np.asarray(self.bpe.encode_ordinary(parts[i]), "<u4").tobytes()
        return out

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a text that holds a special token's string is encoded in one go."""
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        parts = self.memo.batch(["" if i in whole else t for i, t in enumerate(texts)])
        return [self._whole(texts[i]) if i in whole else b"".join(p) for i, p in enumerate(parts)]


def encoder(path: str, pattern: str) -> IdEncoder:
    """One encoder for each Python worker and vocabulary."""
    return kept("encoder", (path, pattern), lambda: IdEncoder(path, pattern))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    full, rest = divmod(n, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    at = full * capacity
    for part in (capacity // 2, capacity // 4, capacity // 8):
        if part and rest >= part:
            out.append((at, part))
            at, rest = at + part, rest - part
    while rest > 0:  # below 1/8 of the capacity, unless that is tiny or odd
        out.append((at, min(rest, max(1, capacity // 8))))
        at, rest = at + out[-1][1], rest - out[-1][1]
    return out


def cut_documents(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of each document: ``id_col``, start, length, ids_crc32, doc_tokens."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in sub_batches(texts):
                at, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(own.encode(texts[a:b]), a):
                    ids += end
                    n = len(ids) // 4
                    for s, m in cuts(n, capacity):
                        at.append(i)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + m)]))
                        total.append(n)
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *numbers],
                    names=[id_col, "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return plain_columns(docs, (id_col, text_col)).mapInArrow(lean(run, "encoder"), f"`{id_col}` {kind}, {PIECES_SCHEMA}")


def fill_sequences(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Place pieces (any rows with ``id_col``, start and length) into sequences.

    Adds sequence_id and offset. The number of pieces of each class is counted first: one
    row per class, ``capacity`` rows at most, which is what gets broadcast.
    """
    j = F.expr(f"{capacity} div length")
    sized = pieces.withColumn("_class", j)
    buckets = sized.groupBy("_class").count().select(
        "_class",
        F.greatest(F.lit(1), F.expr(f"count div greatest({BUCKET_PIECES}, {BUCKET_SEQUENCES} * _class)")).alias("_buckets"),
    )
    # By the row number where there is one, so that pieces of one id, or of none, fall into all buckets.
    number = [c for c in ("_row",) if c in pieces.columns]
    dealt = sized.join(F.broadcast(buckets), "_class").withColumn("_hash", F.xxhash64(id_col, "start", *number))
    dealt = dealt.withColumn("_bucket", F.pmod(F.col("_hash"), F.col("_buckets")))
    group = Window.partitionBy("_class", "_bucket")
    ranked = dealt.withColumn("_rank", F.row_number().over(group.orderBy("_hash", id_col, "start")) - 1)
    ranked = ranked.withColumn("_bin", F.expr("_rank div _class"))
    before = Window.partitionBy("_class", "_bucket", "_bin").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    # A bucket has under 2 * max(512, 8 j) pieces on average, so 2^20 bins leave ample room.
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn(
        "sequence_id", (F.col("_class") * F.lit(1 << 51) + F.col("_bucket") * F.lit(1 << 20) + F.col("_bin")).cast("long")
    )


def pack_documents(
    docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise, cut and pack every document.

    Returns one row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Each document's ids are followed by ``end_id``, so a null or empty text is one
    piece of one token, and a long text is as many pieces as it takes. Repeated rows are
    packed as often as they occur; ties in the order within a bucket are between equal
    rows. Other columns of the input are ignored. No rows give no rows.
    """
    pieces = materialise(cut_documents(docs, path, pattern, capacity, end_id, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    placed = fill_sequences(pieces, capacity, id_col)
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
