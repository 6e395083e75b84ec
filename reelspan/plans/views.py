"""Views of the driver's tables as recordings, segments, turns, runs and events, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.functions.text import TOKEN, token_count, tokens

DAY = 86_400_000
STAGE_OF = {"signup": "extract", "view": "vad", "click": "asr", "purchase": "align", "error": "diarize"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").withColumn("ms", ms)
    return rows.select(
        F.expr(f"ms div {DAY}").alias("rec_id"), "event_id", "user_id", "event_type",
        (F.col("ms") % DAY).alias("st"), (F.col("ms") % DAY + F.round(F.col("value") * 10000).cast("bigint")).alias("en"),
    )


def seg_ev(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter(F.col("event_type").isin("click", "purchase", "signup")).select("rec_id", F.col("event_id").alias("seg_id"), "st", "en", F.col("event_type").alias("text"))


def sil_ev(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter("event_type = 'error'").select("rec_id", F.col("event_id").alias("sil_id"), "st", "en")


def turn_ev(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).filter("event_type = 'view'")
    return rows.select("rec_id", F.col("event_id").alias("turn_idx"), "st", "en", F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("speaker"))


def rec_ev(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("rec_id").distinct().withColumn("duration", F.lit(DAY).cast("bigint"))


def seg_conv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("dur", token_count("text") * 400 + 200).withColumn("pause", F.when(F.col("turn") % 3 == 2, 2500).otherwise(300))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    st = F.coalesce(F.sum(F.col("dur") + F.col("pause")).over(before), F.lit(0)).cast("bigint")
    return rows.select(F.col("conv_id").alias("rec_id"), F.col("turn").cast("bigint").alias("seg_id"), st.alias("st"), (st + F.col("dur")).alias("en"), "text", F.col("role").alias("speaker"))


def word_conv(spark: SparkSession, d: str) -> DataFrame:
    rows = seg_conv(spark, d).select("rec_id", "seg_id", F.col("st").alias("_st"), F.posexplode(tokens("text")).alias("word_idx", "word"))
    st = F.col("_st") + 400 * F.col("word_idx")
    return rows.select("rec_id", "seg_id", "word_idx", st.alias("st"), (st + 400).alias("en"), "word")


def seg_words(spark: SparkSession, d: str) -> DataFrame:
    """Segments of conversations, those of odd turns with their words."""
    words = F.transform(tokens("text"), lambda w, i: F.struct(w.alias("word"), (F.col("st") + 400 * i).alias("st"), (F.col("st") + 400 * i + 400).alias("en"), F.lit(None).cast("double").alias("probability")))
    return seg_conv(spark, d).withColumn("words", F.when(F.col("seg_id") % 2 == 1, words))


def chunk_emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("rec_id"), (F.col("vec_id") % 10).cast("int").alias("idx"), "embedding")


def hist_ord(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("finished_at"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"),
        ((F.col("o_orderkey") % 100) / 100).alias("coverage"), (F.col("o_custkey") % 90).alias("gap_seconds"), (F.col("o_orderkey") % 3).alias("failures"),
        (-(F.col("o_custkey") % 100) / 100).alias("confidence"), ((F.col("o_orderkey") % 50) / 10).alias("speed"),
    )


def bench_li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linestatus").alias("engine"), F.col("l_quantity").cast("double").alias("speed"), F.col("l_shipdate").alias("measured_at"), "l_orderkey", "l_linenumber")


def prog_ev(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Events as progress of jobs; ``events``: the same table read in another way."""
    stage = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])[F.col("event_type")]
    return (table(spark, d, "events") if events is None else events).select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", stage.alias("stage"), (F.col("value") / 500).alias("fraction"))


def ledger_ev(spark: SparkSession, d: str) -> DataFrame:
    rows = prog_ev(spark, d)
    return rows.select(F.col("job").alias("job_key"), "stage", F.col("ts").alias("saved_at"), "seq", F.when(F.col("seq") % 2 == 0, "a").otherwise("b").alias("diarize_key"))


def inv_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").cast("bigint").alias("length"))


_EV = f"SELECT epoch_us(ts)//1000//{DAY} AS rec_id, event_id, user_id, event_type, epoch_us(ts)//1000%{DAY} AS st, epoch_us(ts)//1000%{DAY}+CAST(round(value*10000) AS BIGINT) AS en FROM events"
_STAGE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STAGE_OF.items()) + " END"
_N = "len(regexp_extract_all(text, '" + TOKEN.replace("\\\\", "\\").replace("'", "''") + "'))"

#: The same views for DuckDB; a query's oracle starts with those that it names.
SQL = {
    "ev": _EV,
    "seg_ev": "SELECT rec_id, event_id AS seg_id, st, en, event_type AS text FROM ev WHERE event_type IN ('click','purchase','signup')",
    "sil_ev": "SELECT rec_id, event_id AS sil_id, st, en FROM ev WHERE event_type='error'",
    "turn_ev": "SELECT rec_id, event_id AS turn_idx, st, en, 'S'||CAST(user_id%4 AS VARCHAR) AS speaker FROM ev WHERE event_type='view'",
    "rec_ev": f"SELECT DISTINCT rec_id, CAST({DAY} AS BIGINT) AS duration FROM ev",
    "seg_conv": f"""SELECT conv_id AS rec_id, CAST(turn AS BIGINT) AS seg_id, CAST(b AS BIGINT) AS st, CAST(b+dur AS BIGINT) AS en, text, role AS speaker FROM (
  SELECT *, coalesce(sum(dur+pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM (
    SELECT *, {_N}*400+200 AS dur, CASE WHEN turn%3=2 THEN 2500 ELSE 300 END AS pause FROM conversations))""",
    "word_conv": f"""SELECT rec_id, seg_id, i AS word_idx, st+400*i AS st, st+400*i+400 AS en, toks[i+1] AS word FROM (
  SELECT rec_id, seg_id, st, toks, unnest(range(len(toks))) AS i FROM (SELECT *, regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}') AS toks FROM seg_conv))""",
    "hist_ord": """SELECT o_orderkey AS run_id, o_orderdate AS finished_at, CASE WHEN o_orderstatus='P' THEN 'error' ELSE 'ok' END AS status, (o_orderkey%100)/100 AS coverage,
  o_custkey%90 AS gap_seconds, o_orderkey%3 AS failures, -(o_custkey%100)/100 AS confidence, (o_orderkey%50)/10 AS speed FROM orders""",
    "bench_li": "SELECT l_suppkey AS k, l_linestatus AS engine, CAST(l_quantity AS DOUBLE) AS speed, l_shipdate AS measured_at, l_orderkey, l_linenumber FROM lineitem",
    "prog_ev": f"SELECT user_id AS job, event_id AS seq, ts, {_STAGE} AS stage, value/500 AS fraction FROM events",
    "ledger_ev": "SELECT job AS job_key, stage, ts AS saved_at, seq, CASE WHEN seq%2=0 THEN 'a' ELSE 'b' END AS diarize_key FROM prog_ev",
    "inv_pages": "SELECT url AS path, CAST(length(html) AS BIGINT) AS length FROM pages",
    "merged": """SELECT rec_id, min(st) AS st, max(en) AS en FROM (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN st > max(en) OVER (PARTITION BY rec_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM seg_ev WHERE en>st)) GROUP BY rec_id, island""",
    "gaps": f"""SELECT rec_id, a AS st, b AS en FROM (SELECT rec_id, coalesce(lag(en) OVER (PARTITION BY rec_id ORDER BY st),0) AS a, least(st,{DAY}) AS b FROM merged
  UNION ALL SELECT rec_id, max(en), {DAY} FROM merged GROUP BY rec_id) WHERE b>a AND b-a>=1500""",
}


def with_views(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body
