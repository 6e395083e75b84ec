import duckdb
import pytest

from reelspan.plans import catalogue, catalogue_files, catalogue_streams  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = ("orders", "documents", "labels", "conversations", "events", "pages", "lineitem", "embeddings")


def counted(found):
    out = {}
    for r in found:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


@pytest.fixture(scope="module")
def by_sql(spark):
    """Rows that a query's SQL gives, from the same rows that Spark reads."""
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, spark.read.parquet(f"{DIR}/{t}.parquet").toArrow())

    def run(name):
        return con.execute(catalogue.ORACLES[name]).fetchall()

    run.con = con
    return run


def test_files_of_every_run_are_looked_up(spark, by_sql):
    found = [tuple(r) for r in catalogue.QUERIES["latest_file_lookup"](spark, DIR).collect()]
    runs = spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey").collect()
    assert {p for p, _ in found} == {f"run/{r[0] // 4}{s}" for r in runs for s in (".report.txt", ".transcript.txt")} and len(found) == 2 * len(runs)
    hits = sum(n.startswith(("ok", "error")) for _, n in found)
    assert 0 < hits < len(found)
    assert counted(found) == counted(by_sql("latest_file_lookup"))


def test_cues_of_all_segments_keep_their_tokens(spark, by_sql):
    found = catalogue.QUERIES["cue_token_invariance"](spark, DIR).collect()
    assert counted(found) == counted(by_sql("cue_token_invariance"))


def test_whole_listings_are_compared(spark, by_sql, tmp_path):
    assert counted(catalogue.QUERIES["listing_diff"](spark, DIR).collect()) == counted(by_sql("listing_diff"))
    # Odd and even ids on either side; 5 and 6 have vanished, 7 and 8 are new.
    for name, ids in (("documents", (1, 2, 5, 6)), ("labels", (1, 2, 7, 8))):
        spark.createDataFrame([(i,) for i in ids], "doc_id bigint").write.parquet(f"{tmp_path}/{name}.parquet")
    found = {tuple(r) for r in catalogue.QUERIES["listing_diff"](spark, str(tmp_path)).collect()}
    assert found == {(5, "gone"), (6, "gone"), (7, "new"), (8, "new")}


def rounded(rows):
    return counted(tuple(round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, list) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_their_sql(spark, by_sql, name):
    df = catalogue.QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    con = by_sql(name)
    found = df.select(*[f"`{c}`" for c in order]).collect()
    columns = [c[0] for c in by_sql.con.description]
    assert sorted(columns) == order
    assert rounded(found) == rounded([tuple(r[columns.index(c)] for c in order) for r in con])
