"""Ordered packing: cues, paragraphs, text chunks, speech windows.

These folds look back on their own decisions. Each recording is first cut into islands at
places where the fold starts afresh anyway (a change of speaker, a long pause), so that
the arrays which the higher-order functions fold stay short. Islands of paragraphs and windows
that are long all the same (``FOLD_ROWS``) are segmented by search and pointer doubling instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.format import srt_time, timestamp_ms
from reelspan.functions.text import let, strip, wrap_at_most
from reelspan.operators.greedy import next_beyond, numbered_segments, reached
from reelspan.schemas import WORDS
from reelspan.shared import materialise

# Fixed values: (least, most ms of a cue, pause that may be joined, characters, lines) per density.
DENSITIES = {
    "longa": (30_000, 60_000, 4000, 600, 15),
    "equilibrada": (5000, 8000, 2000, 84, 2),
    "curta": (1000, 2000, 800, 60, 2),
}
DEFAULT_DENSITY = "equilibrada"
SLIVER_MS, SLIVER_GAP_MS, LINE = 400, 800, 42
#: Rows of an island up to which its fold may sit in one row.
FOLD_ROWS = 4096
CUE = f"struct<st:bigint,en:bigint,text:string,words:{WORDS}>"
PIECE = "struct<st:bigint,en:bigint,text:string>"


def resolve_density(name: str | None) -> str:
    return name if name in DENSITIES else DEFAULT_DENSITY


def budget(speaker: Column, most: int | Column) -> Column:
    """Characters left beside the label '[speaker] ', 20 at least."""
    return F.when(F.coalesce(speaker, F.lit("")) == "", F.lit(most)).otherwise(F.greatest(F.lit(20), F.lit(most) - (F.length(speaker) + 3)))


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def fold_rows(items: Column, joins, joined, kind: str = CUE) -> Column:
    """Left fold of an array of cues: while ``joins(open, next)``, the open cue becomes ``joined(open, next)``."""
    zero = F.struct(empty(kind).alias("d"), null(kind).alias("c"))

    def step(z: Column, x: Column) -> Column:
        return (
            F.when(z.c.isNull(), F.struct(z.d.alias("d"), x.alias("c")))
            .when(joins(z.c, x), F.struct(z.d.alias("d"), joined(z.c, x).alias("c")))
            .otherwise(F.struct(F.concat(z.d, F.array(z.c)).alias("d"), x.alias("c")))
        )

    return F.aggregate(items, zero, step, lambda z: F.when(z.c.isNull(), z.d).otherwise(F.concat(z.d, F.array(z.c))))


def cue(st: Column, en: Column, text: Column, words: Column) -> Column:
    return F.struct(st.alias("st"), en.alias("en"), text.alias("text"), words.alias("words")).cast(CUE)


def together(a: Column, b: Column, en: Column) -> Column:
    """Two cues as one; texts of cues are stripped and not empty, so what joins them is too."""
    return cue(a.st, en, F.concat(a.text, F.lit(" "), b.text), F.concat(a.words, b.words))


def split_by_words(c: Column, most_ms: int | Column, room: Column) -> Column:
    """Pieces of a cue cut at word times; each starts with its first word and ends with its last."""
    words = F.transform(c.words, lambda w: F.struct(w.st.alias("st"), w.en.alias("en"), strip(w.word).alias("text")))
    run = "struct<at:int,n:int>"
    zero = F.struct(empty(run).alias("d"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("size"), null("bigint").alias("st"))

    def pieces(v: Column) -> Column:
        def step(z: Column, w: Column) -> Column:
            size = F.length(w.text) + 1
            full = (w.en - z.st > v.most) | (z["size"] + size > v.room)
            return (
                F.when(z.n == 0, F.struct(z.d.alias("d"), z["at"].alias("at"), F.lit(1).alias("n"), size.alias("size"), w.st.alias("st")))
                .when(full, F.struct(F.concat(z.d, F.array(_run(z, run))).alias("d"), (z["at"] + z.n).alias("at"), F.lit(1).alias("n"), size.alias("size"), w.st.alias("st")))
                .otherwise(F.struct(z.d.alias("d"), z["at"].alias("at"), (z.n + 1).alias("n"), (z["size"] + size).alias("size"), z.st.alias("st")))
            )

        def piece(r: Column) -> Column:
            return let(_part(v.words, r), lambda p: _piece(p[0].st, F.element_at(p, -1).en, F.array_join(F.transform(p, lambda w: w.text), " ")))

        return F.transform(F.aggregate(v.words, zero, step, lambda z: F.concat(z.d, F.array(_run(z, run)))), piece)

    return let(F.struct(words.alias("words"), F.lit(most_ms).alias("most"), room.alias("room")), pieces)


def split_evenly(c: Column, most_ms: int | Column, room: Column) -> Column:
    """Pieces of a cue without word times: by characters and by words at the cue's own pace, timed by words."""
    words = F.filter(F.split(strip(c.text), "\\s+"), lambda w: w != "")
    length = F.greatest(F.lit(0).cast("bigint"), c.en - c.st)
    run = "struct<at:int,n:int>"
    zero = F.struct(empty(run).alias("d"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def pieces(v: Column) -> Column:
        def step(z: Column, w: Column) -> Column:
            size = F.length(w) + 1
            return (
                F.when(z.n == 0, F.struct(z.d.alias("d"), z["at"].alias("at"), F.lit(1).alias("n"), size.alias("size")))
                .when((z["size"] + size > v.room) | (z.n >= v.pace), F.struct(F.concat(z.d, F.array(_run(z, run))).alias("d"), (z["at"] + z.n).alias("at"), F.lit(1).alias("n"), size.alias("size")))
                .otherwise(F.struct(z.d.alias("d"), z["at"].alias("at"), (z.n + 1).alias("n"), (z["size"] + size).alias("size")))
            )

        def piece(r: Column) -> Column:
            return _piece(_until(c, v.length, r["at"], v.total), _until(c, v.length, r["at"] + r.n, v.total), F.array_join(_part(v.words, r), " "))

        runs = F.aggregate(v.words, zero, step, lambda z: F.when(z.n == 0, z.d).otherwise(F.concat(z.d, F.array(_run(z, run)))))
        return let(runs, lambda r: F.when(F.size(r) > 1, F.transform(r, piece)).otherwise(F.array(_piece(c.st, c.en, c.text))))

    def paced(v: Column) -> Column:
        total = F.size(v.words)
        pace = F.when(v.length > 0, F.greatest(F.lit(1).cast("bigint"), F.floor(v.most * total / v.length).cast("bigint"))).otherwise(total.cast("bigint"))
        return let(F.struct(v.words.alias("words"), v.length.alias("length"), v.room.alias("room"), total.alias("total"), pace.alias("pace")), pieces)

    return let(F.struct(words.alias("words"), length.alias("length"), F.lit(most_ms).alias("most"), room.alias("room")), paced)


def _run(z: Column, kind: str) -> Column:
    return F.struct(z["at"].alias("at"), z.n.alias("n")).cast(kind)


def _part(words: Column, run: Column) -> Column:
    """The words of a run, looked up one by one: a slice would read the whole array for each run."""
    return F.transform(F.sequence(run["at"] + 1, run["at"] + run.n), lambda i: F.element_at(words, i))


def _piece(st: Column, en: Column, text: Column) -> Column:
    return F.struct(st.alias("st"), en.alias("en"), text.alias("text")).cast(PIECE)


def _until(c: Column, length: Column, used: Column, total: Column) -> Column:
    return F.when(used >= total, c.en).otherwise(c.st + F.floor(length * used / total).cast("bigint"))


def density_values(density: str | Column | None) -> tuple[Column, ...]:
    """The five settings of a density, or of a column of densities; unknown and null ones get the default's."""
    if not isinstance(density, Column):
        return tuple(F.lit(x) for x in DENSITIES[resolve_density(density)])
    known = F.when(density.isin(*DENSITIES), density).otherwise(DEFAULT_DENSITY)
    return tuple(F.create_map(*[F.lit(x) for name, values in DENSITIES.items() for x in (name, values[k])])[known] for k in range(5))


def build_cues(segments: DataFrame, density: str | Column | None = None, rec: str = "rec_id") -> DataFrame:
    """Subtitle cues (rec, cue_no, st, en, text, speaker) of segments (rec, seg_id, st, en, text, speaker, words).

    Short neighbours are joined, long cues cut (at word times where there are any), and
    slivers given back to the cue before. ``words`` is an array in list order, or absent.
    ``density`` may be a column of the segments that is the same for all of a recording.
    """
    name = density if isinstance(density, Column) else F.lit(resolve_density(density))
    least_ms, most_ms, gap, chars, _ = density_values(F.col("_density") if isinstance(density, Column) else density)
    words = F.coalesce(F.filter("words", lambda w: strip(w.word) != ""), F.array().cast(WORDS)) if "words" in segments.columns else F.array().cast(WORDS)
    speaker = F.col("speaker") if "speaker" in segments.columns else null("string")
    rows = segments.filter(strip("text") != "").select(rec, "seg_id", "st", "en", strip("text").alias("text"), speaker.alias("speaker"), words.alias("words"), name.alias("_density"))
    rows = rows.withColumn("_end", F.greatest(F.col("en"), F.coalesce(F.array_max(F.transform("words", lambda w: w.en)), F.col("en"))))
    order = Window.partitionBy(rec).orderBy("seg_id")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) | (F.col("st") > before + gap), 1).otherwise(0)
    cut = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = cut.groupBy(rec, "_island", "speaker", "_density").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seg_id", cue(F.col("st"), F.col("en"), F.col("text"), F.col("words")).alias("c")))), lambda x: x.c).alias("cues")
    )
    room = budget(F.col("speaker"), chars)
    length = lambda c: F.greatest(F.lit(0).cast("bigint"), c.en - c.st)
    short = lambda a, b: (length(a) < least_ms) & (b.st - a.en <= gap) & (b.en - a.st <= most_ms) & (F.length(a.text) + F.length(b.text) + 1 <= room)
    joined = islands.withColumn("cues", fold_rows(F.col("cues"), short, lambda a, b: together(a, b, b.en)))
    one = joined.select(rec, "_island", "speaker", "_density", F.posexplode("cues").alias("_p", "c"))
    fits = (length(F.col("c")) <= most_ms) & (F.length("c.text") <= room)
    whole = F.array(_piece(F.col("c.st"), F.col("c.en"), F.col("c.text")))
    pieces = F.when(fits, whole).when(F.size("c.words") > 0, split_by_words(F.col("c"), most_ms, room)).otherwise(split_evenly(F.col("c"), most_ms, room))
    back = one.select(rec, "_island", "speaker", "_p", pieces.alias("pieces")).groupBy(rec, "_island", "speaker").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_p", "pieces"))), lambda x: x.pieces)).alias("cues")
    )
    sliver = lambda a, b: (length(b) < SLIVER_MS) & (b.st - a.en <= SLIVER_GAP_MS)
    merged = fold_rows(F.filter("cues", lambda c: strip(c.text) != ""), sliver, lambda a, b: _piece(a.st, F.greatest(a.en, b.en), F.concat(a.text, F.lit(" "), b.text)), PIECE)
    final = back.select(rec, "_island", "speaker", F.posexplode(merged).alias("_p", "c"))
    number = F.row_number().over(Window.partitionBy(rec).orderBy("_island", "_p"))
    return final.select(rec, number.alias("cue_no"), F.col("c.st").alias("st"), F.col("c.en").alias("en"), F.col("c.text").alias("text"), "speaker")


def cue_blocks(cues: DataFrame, density: str | None = None, with_speaker: bool = True, vtt: bool = False) -> DataFrame:
    """Adds ``block``: number, times and wrapped text of each cue."""
    label = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("["), F.col("speaker"), F.lit("] "))).otherwise(F.lit(""))
    text = F.concat(label, strip("text")) if with_speaker else strip("text")
    lines = DENSITIES[resolve_density(density)][4]
    time = timestamp_ms if vtt else srt_time
    return cues.withColumn("_text", text).withColumn(
        "block",
        F.concat(F.col("cue_no").cast("string"), F.lit("\n"), time("st"), F.lit(" --> "), time("en"), F.lit("\n"), F.array_join(wrap_at_most("_text", LINE, lines), "\n"), F.lit("\n")),
    ).drop("_text")


def subtitle_text(cues: DataFrame, density: str | None = None, with_speaker: bool = True, vtt: bool = False, rec: str = "rec_id") -> DataFrame:
    """(rec, n_cues, content): the whole SRT or WebVTT text of each recording."""
    blocks = cue_blocks(cues, density, with_speaker, vtt).groupBy(rec).agg(F.sort_array(F.collect_list(F.struct("cue_no", "block"))).alias("b"))
    body = F.array_join(F.transform("b", lambda x: x.block), "\n")
    return blocks.select(rec, F.size("b").alias("n_cues"), (F.concat(F.lit("WEBVTT\n\n"), body) if vtt else body).alias("content"))


def by_length(islands: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of islands of at most FOLD_ROWS rows, and those of longer ones, None without any."""
    sized = islands.withColumn("_rows", F.count("*").over(Window.partitionBy(*group)))
    most = islands.groupBy(*group).count().agg(F.max("count")).first()[0]
    if (most or 0) <= FOLD_ROWS:
        return islands, None
    return sized.filter(F.col("_rows") <= FOLD_ROWS).drop("_rows"), sized.filter(F.col("_rows") > FOLD_ROWS).drop("_rows")


def greedy_rows(rows: DataFrame, group: list[str], at: str, reach: str, limit: str, on: int) -> DataFrame:
    """``rows`` with ``_seg`` (the ``at`` of its segment's first row): a segment's next starts ``on`` rows after the first whose ``reach`` is over its first row's ``limit``."""
    last = rows.groupBy(*group).agg(F.max(at).alias("_last"), F.min(at).alias("_first"))
    jumps = next_beyond(rows, group, at, reach, limit).join(last, group).withColumn("nxt", F.col("nxt") + on)
    jumps = jumps.select(*group, at, F.when(F.col("nxt") <= F.col("_last"), F.col("nxt")).alias("nxt"))
    return numbered_segments(rows, group, at, reached(jumps, last.select(*group, F.col("_first").alias(at)), group, at))


def paragraphs(segments: DataFrame, gap_ms: int = 1500, most_chars: int = 700, rec: str = "rec_id") -> DataFrame:
    """(rec, par_no, st, en, text): running text, broken at long pauses or once a paragraph has over ``most_chars``."""
    rows = segments.filter(strip("text") != "").select(rec, "seg_id", "st", "en", strip("text").alias("text"))
    order = Window.partitionBy(rec).orderBy("seg_id")
    new = F.when(F.col("st") - F.lag("en").over(order) > gap_ms, 1).otherwise(0)
    cut = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    group = [rec, "_island"]
    short, long = by_length(cut, group)
    kind = "struct<st:bigint,en:bigint,text:string,n:int>"
    piece = lambda st, en, text, n: F.struct(st.alias("st"), en.alias("en"), text.alias("text"), n.alias("n")).cast(kind)
    islands = short.groupBy(*group).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seg_id", "st", "en", "text"))), lambda x: piece(x.st, x.en, x.text, F.length(x.text))
        ).alias("parts")
    )
    folded = fold_rows(F.col("parts"), lambda a, b: a.n <= most_chars, lambda a, b: piece(a.st, b.en, F.concat(a.text, F.lit(" "), b.text), a.n + b.n), kind)
    rows = islands.select(*group, F.posexplode(folded).alias("_p", "p")).select(*group, F.col("_p").cast("bigint").alias("_p"), "p.st", "p.en", "p.text")
    if long is not None:
        within = Window.partitionBy(*group).orderBy("seg_id")
        sums = long.withColumn("_at", F.row_number().over(within).cast("bigint")).withColumn("_reach", F.sum(F.length("text")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        # A paragraph ends with the row that takes it over the limit.
        sums = materialise(sums.withColumn("_limit", F.col("_reach") - F.length("text") + most_chars), "paragraph-rows")
        joined = greedy_rows(sums, group, "_at", "_reach", "_limit", 1).groupBy(*group, "_seg").agg(
            F.min_by("st", "_at").alias("st"), F.max_by("en", "_at").alias("en"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "text"))), lambda x: x.text), " ").alias("text")
        )
        rows = rows.unionByName(joined.withColumnRenamed("_seg", "_p"))
    number = F.row_number().over(Window.partitionBy(rec).orderBy("_island", "_p"))
    return rows.select(rec, number.alias("par_no"), "st", "en", "text")


def text_chunks(texts: DataFrame, size: int = 9000, key: str = "rec_id", text: str = "text", clean: Callable[[Column], Column] = strip, blank: bool = False) -> DataFrame:
    """(key, chunk_no, chunk): pieces of at most ``size`` characters, cut after the last '. ' of the second half.

    ``clean`` strips the pieces of a text that is cut; with ``blank``, those of which nothing is left are kept.
    The fold's state is the position reached; a cut always moves on by more than size / 2.
    """
    length, half = F.length(text), size // 2
    zero = F.struct(empty("string").alias("d"), F.lit(0).alias("at"))

    def step(z: Column, _: Column) -> Column:
        end = F.least(length, z["at"] + size)
        tail = F.substring(F.col(text), z["at"] + half + 1, end - z["at"] - half)
        back = F.instr(F.reverse(tail), " .")
        cut = F.when((end < length) & (back > 0), end - back).otherwise(end)
        piece = clean(F.substring(F.col(text), z["at"] + 1, cut - z["at"]))
        return F.when(z["at"] >= length, z).otherwise(F.struct(F.concat(z.d, F.array(piece)).alias("d"), cut.alias("at")))

    steps = F.sequence(F.lit(1), F.ceil(2 * length / size).cast("int") + 1)
    folded = F.aggregate(steps, zero, step, lambda z: z.d if blank else F.filter(z.d, lambda c: c != ""))
    chunks = F.when(length <= size, F.array(text)).otherwise(folded)
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(chunks).alias("_p", "chunk"))
    return rows.select(key, (F.col("_p") + 1).alias("chunk_no"), "chunk")


def pack_windows(spans: DataFrame, most_ms: int = 30_000, gap_ms: int = 1000, rec: str = "rec_id") -> DataFrame:
    """(rec, win_no, st, en): spans cut at 30 s, then joined while the pause is under 1 s and the whole fits 30 s."""
    cut = spans.filter("en > st").select(rec, F.explode(F.transform(F.sequence(F.col("st"), F.col("en") - 1, F.lit(most_ms).cast("bigint")), lambda a: F.struct(a.alias("st"), F.least(a + most_ms, F.col("en")).alias("en")))).alias("s")).select(rec, "s.st", "s.en")
    order = Window.partitionBy(rec).orderBy("st", "en")
    new = F.when(F.col("st") - F.lag("en").over(order) >= gap_ms, 1).otherwise(0)
    kind, group = "struct<st:bigint,en:bigint>", [rec, "_island"]
    cut = cut.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    short, long = by_length(cut, group)
    islands = short.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("st", "en"))).alias("s"))
    span = lambda st, en: F.struct(st.alias("st"), en.alias("en")).cast(kind)
    folded = fold_rows(F.col("s"), lambda a, b: (b.st - a.en < gap_ms) & (b.en - a.st <= most_ms), lambda a, b: span(a.st, b.en), kind)
    rows = islands.select(rec, F.inline(folded))
    if long is not None:
        within = Window.partitionBy(*group).orderBy("st", "en")
        # No span is longer than a window, so none that starts earlier ends beyond a row's limit, and the furthest end so far serves as reach.
        ends = long.withColumn("_at", F.row_number().over(within).cast("bigint")).withColumn("_reach", F.max("en").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        ends = materialise(ends.withColumn("_limit", F.col("st") + most_ms), "window-rows")
        joined = greedy_rows(ends, group, "_at", "_reach", "_limit", 0).groupBy(*group, "_seg").agg(F.min_by("st", "_at").alias("st"), F.max_by("en", "_at").alias("en"))
        rows = rows.unionByName(joined.select(rec, "st", "en"))
    return rows.select(rec, F.row_number().over(Window.partitionBy(rec).orderBy("st")).alias("win_no"), "st", "en")


def tile_windows(recordings: DataFrame, most_ms: int = 30_000, rec: str = "rec_id") -> DataFrame:
    """Fixed tiling of [0, duration]."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("duration") - 1, F.lit(most_ms).cast("bigint"))
    rows = recordings.filter("duration > 0").select(rec, "duration", F.posexplode(starts).alias("_p", "st"))
    return rows.select(rec, (F.col("_p") + 1).alias("win_no"), "st", F.least(F.col("st") + most_ms, "duration").alias("en"))


def batches(rows: DataFrame, size: int, order: str, key: str, rec: str = "rec_id") -> DataFrame:
    """(rec, batch_no, items): items in order, ``size`` to a batch."""
    number = F.row_number().over(Window.partitionBy(rec).orderBy(order)) - 1
    dealt = rows.withColumn("_n", number).withColumn("batch_no", F.expr(f"_n div {size}"))
    return dealt.groupBy(rec, "batch_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", key))), lambda x: x[key]).alias("items"))


def frame_times(recordings: DataFrame, every_s: int, rec: str = "rec_id") -> DataFrame:
    """One row per sampled frame time, every ``every_s`` seconds (1 at least) from 0."""
    step = F.lit(max(1, every_s) * 1000).cast("bigint")
    return recordings.filter("duration > 0").select(rec, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("duration") - 1, step)).alias("at"))
