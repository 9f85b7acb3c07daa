"""Player tables: shared folds against the features joined one by one."""

import datetime
import re
from collections import Counter

from tidemark.operators.assemble import assemble
from tidemark.plans import q_assemblies as A
from tidemark.plans.testbed import Tables


def folder(spark, path, twice):
    """Outings with null dates and prices and players without a role; ``twice`` repeats some."""
    day = datetime.date(1994, 11, 1)
    customers = [(i, i % 3, "BUILDING" if i % 4 else None) for i in range(12)]
    orders = [(k, k * 7 % 12, day + datetime.timedelta(days=k * 11 % 500) if k % 13 else None, float(k * 37 % 900) if k % 9 else None) for k in range(160)]
    if twice:
        orders += [orders[5], orders[13], (20, 20 * 7 % 12, day, 12.5), (None, 3, day, 8.0), (None, 3, day, 8.0)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return Tables(spark, str(path))


def one_by_one(t):
    t = t.once("outings")
    spine = t.outings.select("match_id", "player", "team", "period", "position")
    return assemble(spine, t, A.PLAYER_FEATURES, ["match_id", "player"])


def same(got, want):
    assert got.dtypes == want.dtypes
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_equal_to_features_joined_one_by_one(spark, tmp_path):
    t = folder(spark, tmp_path, False)
    same(A.player_table(t), one_by_one(t))


def test_repeated_outings_meet_as_in_a_join(spark, tmp_path):
    t = folder(spark, tmp_path, True)
    same(A.player_table(t), one_by_one(t))


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_features_by_player_share_their_shuffles(spark, tmp_path):
    t = folder(spark, tmp_path, False)
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # as on large tables
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert 2 * shuffles(A.player_table(t)) < shuffles(one_by_one(t))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
