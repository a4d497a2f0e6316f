"""Queries on tables that the test data has no like of: large, skewed or with large keys."""

from collections import Counter
from datetime import datetime

import duckdb
import pytest
from foliolith.operators import relational as R
from foliolith.plans import registry
from pyspark.sql import functions as F

AT = datetime(2024, 1, 1)
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp"
LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
PAIRED = ["j12_visible_notifications", "j13_can_read", "j16_free_chairs", "j3_actor_role", "k15_fan_out", "q6_visible_events", "w6_allowed_actions", "w8_review_visibility", "x12_issue_view", "x19_chair_notices", "x24_assignable", "x26_can_edit", "x26_managers"]


def exchanged(spark, since):
    """Rows written to shuffles by stages from the given id on, and the next stage's id."""
    sc, none = spark.sparkContext, spark.sparkContext._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() >= since), 1 + max((x.stageId() for x in stages), default=-1)


def same_as_sql(spark, folder, name):
    """Whether a query on the tables in ``folder`` gives what its SQL gives."""
    got = registry.queries()[name](spark, str(folder))
    cols = sorted(got.columns)
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}/*.parquet'")
    r = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = Counter(tuple(str(x[names.index(n)]) for n in cols) for x in r.fetchall())
    assert Counter(tuple(map(str, x)) for x in got.select(*cols).collect()) == want and want


def test_second_page_starts_at_the_median(spark, tmp_path):
    n = 1_000_003
    o = spark.range(n).select((F.col("id") * 7919 % n * 3).alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.timestamp_seconds(F.col("id") * 7919 % n).alias("o_orderdate"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    same_as_sql(spark, tmp_path, "o6_second_page")


@pytest.mark.parametrize("few", [1, 7, 1000])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    for values in ([], [None], [5], [1, 2], [3, 1, 2, None], [4] * 50 + [9], list(range(200)), [1] * 3 + [2] * 90 + [3] * 4):
        want = sorted(v for v in values if v is not None)
        for share in (0.0, 0.5, 0.97, 1.0):
            rank = max(1, -int(-share * len(want) // 1)) if want else 0
            assert R.quantile_disc(spark.createDataFrame([(v,) for v in values], "v int"), "v", share) == (want[rank - 1] if want else None)


def lines(spark, folder, rows):
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")


def test_fresh_reviews_are_new_among_large_ids(spark, tmp_path):
    lines(spark, tmp_path, [(k, 1, 1, n, 5.0, "N", "O") for k in (1, 2, 5_000_001, 5_000_002) for n in (1, 2)])
    same_as_sql(spark, tmp_path, "x15_save_reviews")


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """1200 papers of a conference with 200 chairs: 240,000 pairs of both, of 16,000 rows."""
    d = tmp_path_factory.mktemp("crowd")
    k = F.col("id")
    spark.range(10_000).select(k.alias("c_custkey"), F.lit(5).alias("c_nationkey"), (k % 7 - 1.5).alias("c_acctbal")).write.parquet(f"{d}/customer.parquet")
    who = F.when(k % 4 == 0, k % 40 * 50).otherwise(k * 7 % 10_000)
    spark.range(1200).select(k.alias("o_orderkey"), who.alias("o_custkey"), F.element_at(F.split(F.lit("O,F,P"), ","), (k % 3 + 1).cast("int")).alias("o_orderstatus"), F.lit(AT).alias("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    li = spark.range(4800).select((k % 1200).alias("l_orderkey"), (k * 31 % 200).alias("l_partkey"), (k * 50 % 1000).alias("l_suppkey"), (k / 1200 + 1).cast("int").alias("l_linenumber"), (k * 13 % 50 + 1).cast("double").alias("l_quantity"),
        F.element_at(F.split(F.lit("R,A,N"), ","), (k % 3 + 1).cast("int")).alias("l_returnflag"), F.element_at(F.split(F.lit("O,F"), ","), (k * 7 % 11 % 2 + 1).cast("int")).alias("l_linestatus"))
    li.unionByName(li.filter("l_orderkey % 5 = 0")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(3000).select(k.alias("event_id"), F.lit(AT).alias("ts"), (k % 1500).alias("user_id"), F.lit("view").alias("event_type")).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", PAIRED)
def test_chairs_are_not_exchanged_by_paper(spark, crowd, name):
    since = exchanged(spark, 0)[1]
    same_as_sql(spark, crowd, name)
    assert exchanged(spark, since)[0] < 150_000


def test_facts_meet_as_whole_texts(spark, tmp_path):
    k = F.col("id")
    spark.range(3000).select(k.alias("p_partkey"), F.concat(F.lit("n"), k).alias("p_name"), (k % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    since = exchanged(spark, 0)[1]
    df = registry.queries()["v3_facts"](spark, str(tmp_path))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    same_as_sql(spark, tmp_path, "v3_facts")
    assert exchanged(spark, since)[0] < 10_000
