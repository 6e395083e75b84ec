"""Personal data in texts, and terms that reveal it, on DataFrame functions alone.

Protected entities are what four patterns find: addresses of mail and of machines, card numbers
that pass Luhn's check, phone numbers. A term is revealing when the corpus shows it next to
one entity and hardly anywhere else; then taking the entity out of a text doesn't hide it.

Co-occurrence. Protected spans cut a text into segments. The NEAR words that follow an entity,
and those before the next, occur with it. An occurrence is counted by its context, the word
before and the word after: copies of a text, and passages that texts share, bring the same
contexts again and so count once. With n(c, t) contexts of term t next to entity c and n(t)
contexts of t in the whole corpus, p(c | t) is estimated as n(c, t) / (n(t) + 1), so that one
sighting proves nothing. The pointwise mutual information of c and t is log2 p(c | t) - log2 p(c),
and what t leaves unsaid of c's information content -log2 p(c) is -log2 p(c | t) bits. A
term that leaves less than one bit is generalised, to the kind of thing it is; one that leaves less
than REMOVED_BITS is removed.

Terms are looked for in three steps: pairs next to entities (few rows a span), terms that can
still pass by their contexts next to entities alone, and only those terms' occurrences in all
texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import materialise, plain_columns
from reelspan.llm.license_scan import held

#: Words on either side of an entity that occur with it; bits left below which a term is generalised, and removed.
NEAR, GENERALISED_BITS, REMOVED_BITS = 8, 1.0, -math.log2(0.9)
KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
#: Equal in what they find to the plain forms, but never tried again inside a run that has failed or given back once taken.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter ones are no cards
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text needs for a pattern to find anything.
SIGNS = ("@", ".", "", "+")
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_'-]*+"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
#: Sums of array elements start anew after so many.
SUM_BLOCK = 32
SPANS = "array<struct<kind:int,start:int,end:int,entity:string>>"


def indexes(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running_sums(numbers: str) -> Column:
    """Sums of the first 1, 2, ... elements of an array column; work is about SUM_BLOCK / 2 additions an element."""
    block = lambda i: F.floor(i / SUM_BLOCK).cast("int")
    part = lambda a, size: F.aggregate(F.slice(numbers, a + 1, size), F.lit(0), lambda s, x: s + x)
    blocks = F.transform(indexes(block(F.size(numbers) - 1) + 1), lambda b: part(b * SUM_BLOCK, F.lit(SUM_BLOCK)))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    # One element, so that the sums of the blocks are worked out once.
    return F.transform(F.array(before), lambda b: F.transform(indexes(F.size(numbers)), lambda i: F.get(b, block(i)) + part(block(i) * SUM_BLOCK, i - block(i) * SUM_BLOCK + 1)))[0]


def starts_of(hits: str, gaps: str) -> Column:
    """What running_sums takes to give the places of ``hits``: each gap, with the length of the hit before it."""
    return F.transform(indexes(F.size(hits)), lambda i: F.get(gaps, i) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a number of at most 19 digits."""
    padded = F.lpad(digits, CARD_DIGITS[1], "0")
    total = F.lit(0)
    for i in range(CARD_DIGITS[1]):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if (CARD_DIGITS[1] - 1 - i) % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: int, hit: Column) -> Column:
    """Whether a match is what its pattern is for."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, "[.]"), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    n, (least, most) = F.length(digits_of(hit)), CARD_DIGITS if kind == 2 else PHONE_DIGITS
    fits = (n >= least) & (n <= most)
    return F.when(fits, luhn(digits_of(hit))).otherwise(False) if kind == 2 else fits


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (id, key, text) with spans: kind (a place in KINDS), start, end and entity of every valid match, by kind and start.

    Matches of a kind are the pattern's, leftmost first and without overlap; those that aren't valid are dropped
    and nothing is tried in their place.
    """
    none, kinds = F.array().cast("array<string>"), range(len(PATTERNS))
    signed = [F.contains("text", F.lit(sign)) & (F.col("text").rlike("[0-9]") if k else F.lit(True)) for k, sign in enumerate(SIGNS)]
    hits = [F.when(signed[k], F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"h{k}") for k in kinds]
    out = docs.withColumn("hits", held(F.struct(*hits))).select("id", "key", "text", "hits.*")
    gaps = [F.when(F.size(f"h{k}") > 0, F.transform(F.split("text", PATTERNS[k], -1), lambda x: F.length(x))).alias(f"g{k}") for k in kinds]
    out = out.withColumn("gaps", held(F.struct(*gaps))).select("*", "gaps.*").drop("gaps")
    out = out.withColumn("steps", held(F.struct(*[starts_of(f"h{k}", f"g{k}").alias(f"l{k}") for k in kinds]))).select("*", "steps.*")
    out = out.withColumn("starts", held(F.struct(*[running_sums(f"l{k}").alias(f"s{k}") for k in kinds]))).select("id", "key", "text", *[f"h{k}" for k in kinds], "starts.*")

    def of_kind(k: int) -> Column:
        def span(i: Column) -> Column:
            hit, start = F.get(f"h{k}", i), F.get(f"s{k}", i)
            entity = F.concat(F.lit(f"{k}:"), digits_of(hit) if k > 1 else F.lower(hit))
            return F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), entity.alias("entity"), valid(k, hit).alias("ok"))

        return F.transform(F.filter(F.transform(indexes(F.size(f"h{k}")), span), lambda x: x.ok), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.entity.alias("entity")))

    return out.select("id", "key", "text", held(F.concat(*[of_kind(k) for k in kinds]).cast(SPANS)).alias("spans"))


def segments(spanned: DataFrame) -> DataFrame:
    """(key, start, before, after, words, places): the stretches of text between protected spans, the entities beside them, their words and where these start."""
    order = F.sort_array(F.transform("spans", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.entity.alias("entity"))))
    out = spanned.select("key", "text", held(order).alias("spans"))
    # A span may lie inside another: what counts is the furthest end so far.
    ends = F.aggregate("spans", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x.end))))
    out = out.select("key", "text", "spans", held(ends).alias("ends"))
    k = F.size("spans")
    cut = lambda i: F.struct(
        F.get("ends", i).alias("start"), F.coalesce(F.get("spans", i)["start"], F.length("text")).alias("end"), F.get("spans", i - 1)["entity"].alias("before"), F.get("spans", i)["entity"].alias("after")
    )
    cuts = F.filter(F.transform(F.sequence(F.lit(0), k), cut), lambda x: x.start < x.end)
    out = out.select("key", "text", F.inline(cuts)).select("key", "start", "before", "after", F.expr("substring(text, start + 1, end - start)").alias("text"))
    out = out.select("*", held(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    out = out.select("*", held(F.transform(F.split("text", WORD, -1), lambda x: F.length(x))).alias("gaps")).drop("text")
    out = out.select("*", held(starts_of("words", "gaps")).alias("steps")).drop("gaps")
    return out.select("key", "start", "before", "after", "words", held(running_sums("steps")).alias("places"))


def context(before: Column, after: Column) -> Column:
    return F.xxhash64(F.coalesce(before, F.lit("")), F.lit(0), F.coalesce(after, F.lit("")))


def neighbours(cut: DataFrame) -> DataFrame:
    """(entity, term, context) of the words next to entities, each once."""
    n = F.size("words")
    row = lambda side: lambda i: F.struct(F.col(side).alias("entity"), F.lower(F.get("words", i)).alias("term"), context(F.get("words", i - 1), F.get("words", i + 1)).alias("context"))
    first = F.when(F.col("before").isNotNull(), F.transform(indexes(F.least(n, F.lit(NEAR))), row("before")))
    last = F.when(F.col("after").isNotNull(), F.transform(F.filter(indexes(n), lambda i: i >= n - NEAR), row("after")))
    none = F.array().cast("array<struct<entity:string,term:string,context:bigint>>")
    return cut.select(F.inline(F.concat(F.coalesce(first, none), F.coalesce(last, none)))).distinct()


def occurrences(cut: DataFrame) -> DataFrame:
    """(key, term, context, start, end) of every word outside protected spans."""
    blank = F.array(F.lit("")).cast("array<string>")
    n = F.size("words")
    before, after = F.concat(blank, F.slice("words", 1, n)), F.concat(F.slice("words", 2, n), blank)
    rows = cut.filter(n > 0).select("key", F.col("start").alias("first"), F.inline(F.arrays_zip("words", F.slice(before, 1, n).alias("p"), after.alias("q"), "places")))
    start = F.col("first") + F.col("places")
    return rows.select("key", F.lower("words").alias("term"), context(F.col("p"), F.col("q")).alias("context"), start.alias("start"), (start + F.length("words")).alias("end"))


def passes(near: str, every: str) -> Column:
    """-log2 p(c | t) is below GENERALISED_BITS, by whole numbers."""
    return 2 * F.col(near) > F.col(every) + 1


def revealing_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (term, entity, near, everywhere, bits, removed) that reveal an entity of ``docs`` (id, key, text), and the occurrences of terms that might have.

    Of several entities a term goes with the one that it is found next to most, then with the least.
    """
    pairs = materialise(neighbours(segments(with_spans(docs).filter(F.size("spans") > 0))), "near")
    beside = pairs.groupBy("entity", "term").agg(F.count("*").alias("near"))
    # The number of contexts next to any entity bounds that of all from below.
    least = pairs.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("least"))
    best = beside.groupBy("term").agg(F.max(F.struct("near")).alias("most"), F.min_by("entity", F.struct((-F.col("near")).alias("a"), F.col("entity").alias("b"))).alias("entity"))
    best = best.select("term", "entity", F.col("most.near").alias("near"))
    candidates = materialise(best.join(least, "term").filter(passes("near", "least")).drop("least"), "candidates")
    if candidates.isEmpty():
        none = candidates.select("term", "entity", "near", F.col("near").alias("everywhere"), F.lit(0.0).alias("bits"), F.lit(False).alias("removed"))
        return none, docs.select("key", F.lit("").alias("term"), F.lit(0).cast("bigint").alias("context"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    # Sent to every task where it is small enough for Spark's own limit, else both sides are shuffled by term.
    found = materialise(occurrences(segments(with_spans(docs))).join(candidates.select("term"), "term", "left_semi"), "occurrences")
    every = found.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("everywhere"))
    share = F.col("near") / (F.col("everywhere") + 1)
    terms = candidates.join(every, "term").filter(passes("near", "everywhere"))
    # In whole numbers, as bits are rounded.
    terms = terms.select("term", "entity", "near", "everywhere", (-F.log2(share)).alias("bits"), (10 * F.col("near") >= 9 * (F.col("everywhere") + 1)).alias("removed"))
    return materialise(terms, "terms"), found


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): rows of one key have the same id and text, so they get the same spans."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return plain_columns(docs, (id_col, text_col)).select(F.col(f"`{id_col}`").alias("id"), F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.md5(text)).alias("key"), text.alias("text"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, spans) of every row: protected spans, and those of revealing terms, by kind and start.

    A null text is empty and has no spans; texts are searched whole. Rows that are equal in id and text have
    equal spans and add no co-occurrence; rows with a null id are told apart by their text. Ties between entities
    that a term might reveal go to the least. Other columns are ignored; no rows give no rows.
    """
    rows = keyed(docs, id_col, text_col)
    terms, found = revealing_terms(rows)
    base = materialise(with_spans(rows).drop("text"), "spans")
    kind = F.when(F.col("removed"), KINDS.index("removed")).otherwise(KINDS.index("generalised"))
    marked = found.join(terms.select("term", "entity", "removed"), "term").select("key", F.struct(kind.alias("kind"), "start", "end", "entity").alias("span")).distinct()
    by_key = marked.groupBy("key").agg(F.sort_array(F.collect_list("span")).alias("more"))  # at most a text's words
    return base.join(by_key, "key", "left").select("id", "key", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).cast(SPANS).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find_personal_data`` by numbers: ``id_col``, how many spans of each protected kind, their digest, and all spans as text."""
    found = find_personal_data(docs, id_col, text_col)
    number = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("bigint")
    base = F.filter("spans", lambda x: x.kind < len(PATTERNS))
    return found.select(F.col("id").alias(id_col), *[number(k).alias(f"n_{KINDS[k]}") for k in range(len(PATTERNS))], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, text) with protected data and revealing terms taken out; as many rows as ``docs`` has, null texts as empty ones.

    Protected spans become their kind in brackets, removed terms ``[removed]``; a generalised term becomes ``[number]`` if
    it starts with a digit, ``[name]`` if with a capital, else ``[word]``. Of spans that overlap the first stays, the longer of
    those that start together, and what it leaves of the others goes with it.
    """
    found = find_personal_data(docs, id_col, text_col).select("key", "spans").dropDuplicates(["key"])
    rows = keyed(docs, id_col, text_col).join(found, "key", "left")
    order = F.sort_array(F.transform("spans", lambda x: F.struct(x.start.alias("start"), (-x.end).alias("back"), x.kind.alias("kind"))))
    rows = rows.select("id", "text", held(order).alias("spans"))
    ends = F.aggregate("spans", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), -x.back))))
    rows = rows.select("*", held(ends).alias("ends"))
    between = lambda a, b: F.when(b > a, F.substring(F.col("text"), a + 1, b - a)).otherwise("")

    def piece(i: Column) -> Column:
        x = F.get("spans", i)
        first = F.substring(F.col("text"), x["start"] + 1, F.lit(1))
        shape = F.when(first.rlike(r"\p{N}"), "[number]").when(first.rlike(r"\p{Lu}"), "[name]").otherwise("[word]")
        label = F.when(x["kind"] == KINDS.index("generalised"), shape).otherwise(F.concat(F.lit("["), F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), F.lit("]")))
        # A span that begins inside another adds nothing.
        return F.concat(between(F.get("ends", i), x["start"]), F.when(x["start"] >= F.get("ends", i), label).otherwise(""))

    last = between(F.element_at("ends", -1), F.length("text"))
    return rows.select(F.col("id").alias(id_col), F.concat(F.array_join(F.transform(indexes(F.size("spans")), piece), ""), last).alias(text_col))
