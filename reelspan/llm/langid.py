"""Language of texts by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes, which are the network's sequences. A forward and a
backward layer of gated units read each window; their joint state labels every byte with
a distribution over languages, and a document's distribution is the mean over all its
bytes. Training is plain numpy: back-propagation through time, and Adam.

Arrays hold units before windows, (units, windows), so that every step works on long rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.llm.common import lean, materialise, plain_columns, sub_batches
from reelspan.llm.ngram_join import perhaps_among

STEPS = 64
LETTER = re.compile(r"[^\W\d_]")


class ByteGRU:
    """Weights by name; the leading axis of the recurrent ones is direction (forward, backward)."""

    def __init__(self, languages: list[str], units: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        draw = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        self.w = {
            "x": draw(2, 3 * units, 256, by=0.3),
            "u": draw(2, 3 * units, units, by=1 / np.sqrt(units)),
            "b": np.zeros((2, units, 1), np.float32),
            "o": draw(2, len(languages), units, by=0.3),
            "c": np.zeros((len(languages), 1), np.float32),
        }

    def read(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (direction, step, unit, window) for bytes (step, window), and what training needs."""
        steps, width = data.shape
        k, w = self.units, self.w
        x0, x1 = w["x"]
        h = np.zeros((2, k, width), np.float32)
        states = np.empty((2, steps, k, width), np.float32)
        kept, g = [], np.empty((2, 3 * k, width), np.float32)
        for t in range(steps):
            before = h
            if keep:
                g = np.empty_like(g)
            np.matmul(w["u"], h, out=g)
            first, second = np.take(x0, data[t], axis=1), np.take(x1, data[steps - 1 - t], axis=1)
            zr = g[:, : 2 * k]
            zr[0] += first[: 2 * k]
            zr[1] += second[: 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c = g[:, 2 * k :]
            c += w["b"]
            n = c * zr[:, k:]
            n[0] += first[2 * k :]
            n[1] += second[2 * k :]
            np.tanh(n, out=n)
            h = before - n
            h *= zr[:, :k]
            h += n
            if keep:
                kept.append((before, zr, c, n))
            states[0, t], states[1, steps - 1 - t] = h[0], h[1]
        return states, kept

    def label(self, states: np.ndarray) -> np.ndarray:
        """Distribution over languages at every position: (step, language, window)."""
        out = np.matmul(self.w["o"][0], states[0]) + np.matmul(self.w["o"][1], states[1]) + self.w["c"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradient(self, data: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean cross entropy of all positions of windows (step, window)."""
        steps, width = data.shape
        k, w = self.units, self.w
        states, kept = self.read(data, keep=True)
        p = self.label(states)
        real = (data > 0).astype(np.float32)
        real /= max(1.0, real.sum())
        loss = -float((np.log(p[:, target, np.arange(width)] + 1e-9) * real).sum())
        p[:, target, np.arange(width)] -= 1
        p *= real[:, None, :]
        grad = {"c": p.sum(axis=(0, 2))[:, None], "o": np.stack([np.einsum("tlw,tkw->lk", p, states[d]) for d in (0, 1)])}
        into = np.stack([np.matmul(w["o"][d].T, p) for d in (0, 1)])
        into[1] = into[1, ::-1]  # in the order in which the backward layer reads
        back = np.zeros((2, k, width), np.float32)
        grad["u"], grad["b"] = np.zeros_like(w["u"]), np.zeros_like(w["b"])
        drive = np.empty((2, steps, 3 * k, width), np.float32)
        for t in range(steps - 1, -1, -1):
            before, zr, c, n = kept[t]
            z, r = zr[:, :k], zr[:, k:]
            dh = back + into[:, t]
            da = dh * (1 - z) * (1 - n * n)
            dg = np.concatenate([dh * (before - n) * z * (1 - z), da * c * r * (1 - r), da * r], axis=1)
            drive[:, t, : 2 * k], drive[:, t, 2 * k :] = dg[:, : 2 * k], da
            grad["u"] += np.matmul(dg, before.transpose(0, 2, 1))
            grad["b"] += dg[:, 2 * k :].sum(axis=2, keepdims=True)
            back = dh * z + np.matmul(w["u"].transpose(0, 2, 1), dg)
        grad["x"] = np.zeros_like(w["x"])
        for d, bytes_read in enumerate((data, data[::-1])):
            flat = bytes_read.ravel()
            order = np.argsort(flat, kind="stable")
            columns = drive[d].transpose(1, 0, 2).reshape(3 * k, -1)[:, order]
            found, starts = np.unique(flat[order], return_index=True)
            grad["x"][d][:, found] = np.add.reduceat(columns, starts, axis=1)
        return grad, loss

    def fit(self, windows: np.ndarray, targets: np.ndarray, steps: int = 400, width: int = 128, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on random batches of windows (window, step)."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(v) for n, v in self.w.items()}
        second = {n: np.zeros_like(v) for n, v in self.w.items()}
        for i in range(1, steps + 1):
            at = rng.integers(0, len(windows), width)
            grad, _ = self.gradient(np.ascontiguousarray(windows[at].T), targets[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                self.w[name] -= now * (first[name] / (1 - 0.9**i)) / (np.sqrt(second[name] / (1 - 0.999**i)) + 1e-8)

    def pooled(self, texts: list[bytes], width: int = 2048) -> np.ndarray:
        """Mean distribution over all bytes of each text (one row per text); texts mustn't be empty."""
        counts = np.array([-(-len(t) // STEPS) for t in texts])
        data = np.frombuffer(b"".join(t + b"\0" * (-len(t) % STEPS) for t in texts), dtype=np.uint8).reshape(-1, STEPS)
        sums = np.empty((len(data), len(self.languages)), np.float64)
        for a in range(0, len(data), width):
            part = np.ascontiguousarray(data[a : a + width].T)
            labels = self.label(self.read(part)[0])
            sums[a : a + width] = np.einsum("tlw,tw->wl", labels, (part > 0).astype(np.float32))
        totals = np.add.reduceat(sums, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        return totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-12)


def sample_windows(docs: DataFrame, allowed: Column, per_language: int, per_document: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """(language, window) of a bounded sample, the same for the same rows.

    Ids are taken first, by a hash, at most ``per_language`` of each language; only their texts
    travel, one text for an id that repeats. Windows are equally spaced over the whole of each
    text. Rows without an id are not sampled.
    """
    rows = plain_columns(docs.filter(allowed & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), (id_col, text_col, lang_col))
    rows = rows.withColumn(lang_col, F.col(lang_col).cast("string"))
    by_hash = Window.partitionBy(lang_col).orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), id_col)
    ids = rows.select(id_col, lang_col).withColumn("_place", F.row_number().over(by_hash)).filter(F.col("_place") <= per_language)
    ids = materialise(ids.groupBy(id_col).agg(F.min(F.struct("_place", lang_col)).alias("_l")).select(id_col, f"_l.{lang_col}", "_l._place"), "sampled")
    texts = perhaps_among(rows.select(id_col, text_col), ids, id_col, text_col).join(ids, id_col)
    taken = texts.groupBy(id_col, lang_col, "_place").agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col))).alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, at, data = [], [], [], []
            for text, lang, place in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                raw = text.encode()
                if not LETTER.search(text):
                    continue
                starts = np.unique(np.linspace(0, max(0, len(raw) - STEPS), per_document).astype(int)).tolist()
                for s in starts:
                    langs.append(lang)
                    places.append(place)
                    at.append(s)
                    data.append(raw[s : s + STEPS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(places, pa.int32()), pa.array(at, pa.int32()), pa.array(data, pa.binary())],
                names=["lang", "place", "at", "data"],
            )

    found = taken.select(id_col, text_col, lang_col, "_place")
    # per_language * per_document windows of STEPS bytes for each language.
    return [(r.lang, bytes(r.data)) for r in found.mapInArrow(lean(run), "lang string, place int, at int, data binary").orderBy("lang", "place", "at", "data").collect()]


def train_language_model(
    docs: DataFrame,
    allowed: Column,
    per_language: int = 400,
    per_document: int = 8,
    units: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> ByteGRU | None:
    """Fit on at most ``per_language`` documents of each language among the rows that are ``allowed``; None without any.

    Documents are taken by a hash of the id (ties by the id), windows equally spaced over each whole text.
    Rows with a null id, text or language, and texts without a letter, teach nothing; an id that repeats
    counts once, with its text of least hash and, if it has several languages, one of them. Other columns are ignored.
    """
    sample = sample_windows(docs, allowed, per_language, per_document, id_col, text_col, lang_col)
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    windows = np.frombuffer(b"".join(w.ljust(STEPS, b"\0") for _, w in sample), dtype=np.uint8).reshape(-1, STEPS)
    targets = np.array([languages.index(lang) for lang, _ in sample])
    # Languages weigh alike, whatever the sample holds of each.
    rng, each = np.random.default_rng(5), max(np.bincount(targets))
    at = np.concatenate([rng.choice(np.flatnonzero(targets == k), each) for k in range(len(languages))])
    model = ByteGRU(languages, units)
    model.fit(windows[at], targets[at])
    return model


def predict_language(docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) for every row, from its whole text.

    ``und`` and 0 where the text is null or has no letter, or where nothing could be learned; ties
    between languages go to the first by name. Repeated rows get equal results; other columns
    are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for a, b in sub_batches(texts):
                at = [i for i in range(a, b) if own and texts[i] and LETTER.search(texts[i])]
                if at:
                    pooled = own.pooled([texts[i].encode() for i in at])
                    for i, row in zip(at, pooled):
                        k = int(row.argmax())
                        names[i], scores[i] = own.languages[k], float(row[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return plain_columns(docs, (id_col, text_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, lang_pred string, score double")
