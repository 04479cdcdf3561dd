import json
import os

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tastemark.session import cut, shared_folder
from tastemark.sources import readers, writers

# one query of each kind; tests/check_queries.py runs them all
CHECKED = [
    "scan_json_lines", "equal_slices", "select_restaurants", "deviation_columns", "origin_distances", "split_by_user_time",
    "user_knn_cards", "combine_max", "ranking_metrics", "k_sweep_users", "item_tfidf", "highlight_phrases",
]


def test_json_array_and_bad_lines(spark, tmp_path):
    rows = [{"review_id": "r1", "user_id": "u", "business_id": "b", "stars": 4, "text": "x\ny", "date": "2019-02-03", "useful": 1, "funny": 0, "cool": 0}]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    got = readers.json_array(spark, str(tmp_path / "array.json"), readers.REVIEW).first()
    assert (got.review_id, got.stars, got.text, str(got.date)) == ("r1", 4.0, "x\ny", "2019-02-03")
    (tmp_path / "lines.json").write_text(json.dumps(rows[0]) + "\nbroken\n")
    assert readers.read_reviews(spark, str(tmp_path / "lines.json")).first().review_stars == 4.0
    assert readers.read_reviews(spark, str(tmp_path / "lines.json")).count() == 1
    bad = readers.json_lines(spark, str(tmp_path / "lines.json"), readers.REVIEW, keep_bad=True)
    assert [r[readers.BAD_LINE] for r in bad.collect() if r[readers.BAD_LINE]] == ["broken"]


def test_csv_round_trip_keeps_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, "plain")], "id long, text string")
    writers.write_csv(df, str(tmp_path / "c"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "c"), schema, multi_line=True).collect())) == sorted(map(tuple, df.collect()))
    plan = readers.csv(spark, str(tmp_path / "c"), schema, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_run_tables_and_slices(spark, tmp_path):
    writers.write_run({"a": spark.range(3), "b": spark.range(5)}, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "b")).count() == 5
    writers.write_slices(spark.range(25), ["id"], 4, str(tmp_path / "s"))
    assert sorted(d for d in os.listdir(tmp_path / "s") if d.startswith("slice")) == [f"slice={i}" for i in range(5)]


def test_cut_writes_to_the_shared_folder(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.inputFiles()[0].split("cut-")[0].rstrip("/").endswith(shared_folder(spark).rstrip("/"))
    assert df.agg(F.sum("x")).first()[0] == 90


def test_filters_and_columns_reach_the_scan(spark, sf):
    from tastemark.plans import fixtures

    plan = fixtures.cells(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_ranked_lists_are_cut_before_the_shuffle(spark):
    from tastemark.operators import knn

    scores = spark.createDataFrame([(1, 2, 0.5)], "user_id long, item_id long, score double")
    plan = knn.top_k(scores, None, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_entry_has_rows_and_a_stable_schema(spark):
    a, b = entry.entry(spark), entry.entry(spark)
    assert a.schema == b.schema and a.limit(1).count() == 1


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) is None


class _Fake:
    """A session without a shared folder, local or not."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self


def test_only_a_local_session_gets_a_temporary_folder():
    assert shared_folder(_Fake("local[2]")) == shared_folder(_Fake("local[2]"))
    with pytest.raises(RuntimeError):
        shared_folder(_Fake("spark://host:7077"))
