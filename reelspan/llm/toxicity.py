"""Toxicity of texts by a convolutional network over hashed word embeddings.

A word's embedding is the sum of the embeddings of its hash and of the hashes of its first
four, five and six letters. Filters one, two and three words wide run over the whole text; the
greatest response of each goes through a rectifier to a logistic unit. Training is plain
numpy, with Adagrad; only the words under a filter's greatest response get gradients.

One cut doesn't fit all languages. A naive Bayes over the same hashes guesses a text's
language (never the column), and the score is the logistic of the response minus the cut
of the guessed language, so that 0.5 is the cut everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.llm.common import lean, materialise, plain_columns, sub_arrays
from reelspan.llm.ngram_join import bit_of, id_bits, with_bit

WORD = re.compile(r"[^\W\d_]+")
TABLE = 1 << 17
EMBED, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
#: Positives and negatives that a language needs for a cut of its own.
OWN_CUT = 15
#: Bins to a unit of response, and the greatest response told apart; place of a cut in its gap where fitted texts decide.
BINS, MOST_RESPONSE, FITTED_SHARE = 256, 64, 0.4


def features(word: str) -> list[int]:
    """Buckets of a word: itself, and its first letters where it has more."""
    import xxhash

    out = [xxhash.xxh3_64_intdigest(word) % TABLE]
    return out + [xxhash.xxh3_64_intdigest(f"{k}:{word[:k]}") % TABLE for k in PREFIXES if len(word) >= k]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Corpus:
    """Texts to learn from: word numbers per text, and every word's buckets. Words themselves are kept once."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.texts: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        self.texts.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)], dtype=np.int32))

    def close(self) -> None:
        """Work out the buckets: a row per word, and one of zeros (bucket TABLE) for the blank."""
        self.blank = len(self.numbers)
        self.parts = np.full((self.blank + 1, 1 + len(PREFIXES)), TABLE, dtype=np.int32)
        for i, w in enumerate(self.numbers):
            found = features(w)
            self.parts[i, : len(found)] = found
        self.numbers = {}

    def padded(self, d: int) -> np.ndarray:
        """A text's word numbers and the blanks after them; windows start on a word, or on the first blank of a wordless text."""
        words = self.texts[d]
        return np.concatenate([words, np.full(max(WIDTHS) - (len(words) > 0), self.blank, dtype=np.int32)])


class ToxicityModel:
    """Embeddings, filters, output weights, and the cut of each language."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.normal(size=(TABLE, EMBED)) * 0.05).astype(np.float32)
        self.filters = [(rng.normal(size=(w, EMBED, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.output = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
        self.offset = np.float32(0)
        self.languages: list[str] = []
        self.language_table = np.zeros((TABLE, 0), np.float32)
        self.cuts: dict[str, float] = {}
        self.cut = 0.0

    # -- training -----------------------------------------------------------------

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each filter's greatest response over a padded text's embeddings, and that response with its bias."""
        n = len(x) - max(WIDTHS) + 1
        tops, pooled = [], []
        for f in self.filters:
            response = sum(x[j : j + n] @ f[j] for j in range(len(f)))
            tops.append(response.argmax(axis=0))
            pooled.append(response[tops[-1], np.arange(FILTERS)])
        return tops, np.concatenate(pooled) + self.bias

    def fit(self, corpus: Corpus, labels: np.ndarray, epochs: int = 5, width: int = 32, rate: float = 0.05, seed: int = 13) -> None:
        texts, parts, most = corpus.texts, corpus.parts, 1 + len(PREFIXES)
        # The first embedding dimension starts from each bucket's smoothed log odds, and every filter starts by looking at it.
        odds = np.zeros((2, TABLE + 1))
        for words, y in zip(texts, labels):
            odds[int(y), np.unique(parts[np.unique(words)])] += 1
        n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        embedding = np.vstack([self.embedding, np.zeros((1, EMBED), np.float32)])
        start = np.log((odds[1] + 0.5) / (n1 + 1)) - np.log((odds[0] + 0.5) / (n0 + 1))
        embedding[:, 0] = np.where(odds.sum(axis=0) >= 3, start * 0.2, 0)
        embedding[TABLE] = 0
        for f in self.filters:
            f[:, 0, :] += 1.0 / len(f)
        seen = np.full_like(embedding, 1e-3)
        dense = [*self.filters, self.bias, self.output]
        sums = [np.full_like(d, 1e-3) for d in dense]
        offset_sum = 1e-3
        rng = np.random.default_rng(seed)
        balanced = [np.flatnonzero(labels == y) for y in (0, 1)]
        for _ in range(epochs):
            order = np.concatenate([rng.permutation(balanced[0]), rng.choice(balanced[1], max(len(balanced[0]), len(balanced[1])))])
            rng.shuffle(order)
            for a in range(0, len(order), width):
                some = order[a : a + width]
                grads = [np.zeros_like(d) for d in dense]
                offset_grad, rows_at, rows_grad = 0.0, [], []
                for d in some:
                    idx = corpus.padded(d)
                    x = embedding[parts[idx]].sum(axis=1)
                    tops, pre = self.forward(x)
                    hidden = np.maximum(pre, 0)
                    p = 1 / (1 + np.exp(-np.clip(hidden @ self.output + self.offset, -30, 30)))
                    delta = (p - labels[d]) / len(some)
                    grads[-1] += delta * hidden
                    offset_grad += delta
                    through = delta * self.output * (pre > 0)
                    grads[-2] += through
                    for k, f in enumerate(self.filters):
                        g = through[k * FILTERS : (k + 1) * FILTERS]
                        for j in range(len(f)):
                            grads[k][j] += (x[tops[k] + j] * g[:, None]).T
                            rows_at.append(idx[tops[k] + j])
                            rows_grad.append((f[j] * g).T)
                for d, g, s in zip(dense, grads, sums):
                    s += g * g
                    d -= (rate * g / np.sqrt(s)).astype(np.float32)
                offset_sum += offset_grad**2
                self.offset -= np.float32(rate * offset_grad / np.sqrt(offset_sum))
                at, g = parts[np.concatenate(rows_at)], np.concatenate(rows_grad)
                total = np.zeros((at.size, EMBED), np.float32)
                total[:] = np.repeat(g, most, axis=0)
                touched, where = np.unique(at.ravel(), return_inverse=True)
                summed = np.zeros((len(touched), EMBED), np.float32)
                np.add.at(summed, where, total)
                seen[touched] += summed**2
                embedding[touched] -= rate * summed / np.sqrt(seen[touched])
                embedding[TABLE] = 0
        self.embedding = embedding[:TABLE]

    def fit_languages(self, corpus: Corpus, langs: list[str | None]) -> None:
        """Naive Bayes log probabilities of word buckets by language."""
        self.languages = sorted({x for x in langs if x is not None})
        counts = np.full((TABLE, len(self.languages)), 0.1, dtype=np.float32)
        for words, lang in zip(corpus.texts, langs):
            if lang is not None:
                np.add.at(counts, (corpus.parts[np.unique(words), 0], self.languages.index(lang)), 1)
        logs = np.log(counts / counts.sum(axis=0))
        self.language_table = logs - logs.mean(axis=1, keepdims=True) if self.languages else counts

    def set_cuts(self, counts: Iterable[tuple[int, int, int, bool, int]]) -> None:
        """Cuts that separate labelled texts best (F1), for all texts and for each guessed language.

        ``counts``: (index of the guessed language or -1, label, response's bin, fitted, texts).
        Texts that were not fitted on decide wherever there are OWN_CUT of each label, else all.
        """
        table = np.array(list(counts), dtype=np.int64).reshape(-1, 5)
        found = enough_of(table)
        self.cut = cut_of_counts(table if found is None else found)
        for k, lang in enumerate(self.languages):
            own = enough_of(table[table[:, 0] == k])
            if own is not None:
                self.cuts[lang] = cut_of_counts(own)


def enough_of(table: np.ndarray) -> np.ndarray | None:
    """The rows not fitted on if they have OWN_CUT texts of each label, else all if those have, else None."""
    for rows in (table[table[:, 3] == 0], table):
        if all(rows[rows[:, 1] == y, 4].sum() >= OWN_CUT for y in (0, 1)):
            return rows
    return None


def cut_of_counts(table: np.ndarray) -> float:
    """The best cut of binned responses; the middle of the gap unless it rests on texts that were fitted on."""
    responses = (table[:, 2] + 0.5) / BINS
    return best_cut(responses, table[:, 1], table[:, 4], FITTED_SHARE if table[:, 3].any() else 0.5)


def best_cut(response: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, share: float = FITTED_SHARE) -> float:
    """A cut in the gap that gives the highest F1 (the widest among equals), ``share`` of the way up.

    ``weights`` are the texts that each response stands for. Texts that were not learned from
    respond less than those that were, the toxic ones most.
    """
    order = np.argsort(-response, kind="stable")
    r, y = response[order], labels[order].astype(float)
    n = np.ones(len(r)) if weights is None else weights[order].astype(float)
    hits, taken = np.cumsum(y * n), np.cumsum(n)
    f1 = 2 * hits / (taken + max(1.0, (y * n).sum()))
    below = np.append(r[1:], r[-1] - 1)
    f1 = np.where(r > below, f1, -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((r - below)[best])]
    return float(share * r[k] + (1 - share) * below[k])


class Scorer:
    """Applies a model; what each distinct word adds to every filter is kept, up to a bound."""

    CAP = 60_000

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.project = np.concatenate([np.concatenate(list(f), axis=1) for f in model.filters], axis=1)  # EMBED x (sum of widths * FILTERS)
        self.columns = self.project.shape[1]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((self.CAP * 2, self.columns), np.float32)
        self.tongue = np.zeros((self.CAP * 2, len(self.model.languages)), np.float32)

    def add(self, words: list[str]) -> None:
        parts = [features(w) for w in words]
        flat = np.array([p for ps in parts for p in ps], dtype=np.int64)
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        embedded = np.add.reduceat(self.model.embedding[flat], starts, axis=0)
        first = 1 + len(self.index)  # row 0 is the blank
        need = first + len(words)
        if need > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros((need, self.columns), np.float32)])
            self.tongue = np.vstack([self.tongue, np.zeros((need, self.tongue.shape[1]), np.float32)])
        self.rows[first:need] = embedded @ self.project
        self.tongue[first:need] = self.model.language_table[flat[starts]]
        self.index.update(zip(words, range(first, need)))

    def respond(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Response of the output unit, and the guessed language's index (-1: none), of each text's words."""
        out, guess = np.empty(len(docs)), np.empty(len(docs), dtype=np.int64)
        for a, b in word_batches(docs):
            out[a:b], guess[a:b] = self._respond(docs[a:b])
        return out, guess

    def _respond(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.CAP:
            self.clear()
        new = [w for w in set().union(*docs) if w not in self.index]
        if new:
            self.add(new)
        m, blanks = self.model, [0] * (max(WIDTHS) - 1)
        idx: list[int] = []
        starts = []
        for words in docs:
            starts.append(len(idx))
            idx.extend(map(self.index.__getitem__, words))
            if not words:
                idx.append(0)
            idx += blanks  # windows never span two texts
        at = np.array(idx)
        rows = self.rows[at]
        pooled, column = [], 0
        for w in WIDTHS:
            response = rows[:, column : column + FILTERS].copy()
            for j in range(1, w):
                response[:-j] += rows[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
            # Windows that start on a blank are left out.
            starts_on_blank = at == 0
            response[starts_on_blank] = -np.inf
            response[np.array(starts)[[not d for d in docs]]] = 0
            pooled.append(np.maximum.reduceat(response, starts, axis=0))
            column += w * FILTERS
        hidden = np.maximum(np.concatenate(pooled, axis=1) + m.bias, 0)
        votes = np.add.reduceat(self.tongue[at], starts, axis=0)
        guess = votes.argmax(axis=1) if votes.shape[1] else np.full(len(docs), -1)
        guess[[not d for d in docs]] = -1
        return hidden @ m.output + m.offset, guess

    def scores(self, docs: list[list[str]]) -> np.ndarray:
        response, guess = self.respond(docs)
        cuts = np.array([self.model.cuts.get(x, self.model.cut) for x in self.model.languages] + [self.model.cut])
        return 1 / (1 + np.exp(-np.clip(response - cuts[guess], -30, 30)))


def word_batches(docs: list[list[str]], limit: int = 50_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, words in enumerate(docs):
        size += len(words) + 2
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(docs):
        yield start, len(docs)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    positives: int = 1500,
    negatives: int = 3000,
    most_chars: int = 32_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
) -> ToxicityModel | None:
    """Fit on a bounded sample of labelled rows, at most so many of each label and so many characters for each, taken by a hash of the id.

    ``allowed`` is a condition on the id. Labels without a document don't count; an id with several
    labels has the greatest, one with several texts is fitted on one of them. The cuts are then set
    on all labelled rows. Languages only name the groups whose cuts are set. None when
    nothing is labelled; with one label only, every text gets that label's side of the cut.
    """
    by_hash = F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity"))
    known = plain_columns(labels, (id_col, label_col)).filter(allowed & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    present = plain_columns(docs, (id_col,)).distinct()
    known = materialise(known.join(present, id_col, "left_semi"), "labelled")
    taken = None
    for value, most in ((1, positives), (0, negatives)):
        some = known.filter(F.col(label_col) == value).orderBy(by_hash, id_col).limit(most)
        taken = some if taken is None else taken.unionByName(some)
    # positives + negatives rows and twice most_chars characters at most
    wanted = plain_columns(docs, (id_col, text_col, lang_col)).withColumn(lang_col, F.col(lang_col).cast("string"))
    one = F.min_by(F.struct(text_col, lang_col), F.struct(F.xxhash64(text_col), F.col(text_col), F.col(lang_col))).alias("_row")
    single = wanted.join(F.broadcast(taken), id_col).groupBy(id_col, label_col).agg(one).select(id_col, f"_row.{text_col}", f"_row.{lang_col}", label_col)
    so_far = Window.partitionBy(label_col).orderBy(by_hash, id_col).rowsBetween(Window.unboundedPreceding, 0)
    fitting = single.withColumn("_chars", F.sum(F.coalesce(F.length(text_col), F.lit(0))).over(so_far)).filter(F.col("_chars") <= most_chars).drop("_chars")
    rows = sorted(fitting.collect(), key=lambda r: (str(r[0]), r[1] or ""))
    if not rows:
        return None
    langs, y, corpus = [r[2] for r in rows], np.array([r[3] for r in rows]), Corpus()
    while rows:
        corpus.add(rows.pop(0)[1])
    corpus.close()
    model = ToxicityModel()
    model.fit_languages(corpus, langs)
    if 0 < y.sum() < len(y):
        model.fit(corpus, y)
        del corpus
        model.set_cuts(response_counts(docs, known, taken, model, id_col, text_col, label_col))
    else:
        model.cut = -1.0 if y.sum() else 1.0
        model.output[:] = 0
    return model


def response_counts(docs: DataFrame, known: DataFrame, taken: DataFrame, model: ToxicityModel, id_col: str, text_col: str, label_col: str) -> list[tuple]:
    """Texts by guessed language, label, bin of the response and whether fitted on, over every labelled row.

    A row per combination that occurs, whatever the number of texts.
    """
    # Labelled texts are picked by a bitmap in the same Python task that scores them.
    shared, bits = docs.sparkSession.sparkContext.broadcast(model), docs.sparkSession.sparkContext.broadcast(id_bits(known, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            batch = with_bit(batch, np.asarray(batch.column(2)), bits.value)
            texts = batch.column(1)
            response, guess = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for a, b in sub_arrays(texts):
                response[a:b], guess[a:b] = scorer.respond([words_of(t) for t in texts.slice(a, b - a).to_pylist()])
            bins = np.floor(np.clip(response, -MOST_RESPONSE, MOST_RESPONSE) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(guess), pa.array(bins)], names=[id_col, "guess", "bin"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col, bit_of(id_col).alias("_at")).mapInArrow(lean(run), f"`{id_col}` {kind}, guess bigint, bin bigint")
    fitted = F.broadcast(taken.select(id_col, F.lit(1).alias("fitted")))
    rows = scored.join(known, id_col).join(fitted, id_col, "left")
    label, was = F.col(label_col).cast("long").alias("label"), F.coalesce("fitted", F.lit(0)).alias("fitted")
    return [tuple(r) for r in rows.groupBy("guess", label, "bin", was).count().select("guess", "label", "bin", "fitted", "count").collect()]


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", inside: bool = False) -> DataFrame:
    """(``id_col``, score, predicted) for every row, from its whole text.

    ``inside``: the text is a field of the struct ``id_col``, so a whole row goes along and its text is sent once.

    A null or wordless text has the response of a blank text; without a model the score is 0.
    Repeated rows get equal scores; columns other than the two named are ignored; no rows give
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(0).field(text_col) if inside else batch.column(1)
            scores = np.zeros(len(texts))
            for a, b in sub_arrays(texts):
                if scorer:
                    scores[a:b] = scorer.scores([words_of(t) for t in texts.slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = plain_columns(docs, (id_col,) if inside else (id_col, text_col))
    return wanted.mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int")
