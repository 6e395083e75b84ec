import random

import duckdb
import pytest
from pyspark.sql import functions as F

from reelspan.functions.format import fixed
from reelspan.plans import catalogue, catalogue_files  # noqa: F401


@pytest.mark.parametrize("decimals", [0, 1, 2, 3])
def test_decimals_follow_the_binary_value(spark, decimals):
    rng = random.Random(decimals)
    values = [k / 10000 * 100 for k in range(0, 10001, 5)] + [rng.uniform(-2000, 2000) for _ in range(500)] + [k / 16 for k in range(200)] + [0.125 + 2**-55, 99.99, 999.999, 5e-324, 1e11 + 0.25]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), decimals).alias("t")).collect()
    assert [(v, t) for v, t in found if t != f"{v:.{decimals}f}"] == []


def test_cards_round_as_the_sql(spark, tmp_path):
    # Found by the reviewer's rows: shares such as 96.55 %, whose binary value is under the half.
    turns = [(r, t, "user" if t % 2 else "assistant", " ".join(["ha"] * (40 + (7 * r + 11 * t) % 61))) for r in range(400) for t in range(2 + r % 7)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT rec_id, card FROM ({catalogue.ORACLES['job_cards']})").fetchall()
    found = catalogue.QUERIES["job_cards"](spark, str(tmp_path)).select("rec_id", "card").collect()
    assert sorted(want) == sorted(tuple(r) for r in found)


def test_chunks_are_stripped_as_in_the_sql(spark, tmp_path):
    texts = ["a" * 8990 + ". \n\t" + "b" * 9000, "\n" + "c" * 9100 + "\n", " " * 9000 + "d" * 10, "\t" * 18100, "　" + "e" * 9005, "", None, " kept ", ("f" * 4400 + ". \n") * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, chunk_no, chunk FROM ({catalogue.ORACLES['text_chunks']})").fetchall()
    found = catalogue.QUERIES["text_chunks"](spark, str(tmp_path)).select("doc_id", "chunk_no", "chunk").collect()
    assert sorted(want) == sorted(tuple(r) for r in found)
