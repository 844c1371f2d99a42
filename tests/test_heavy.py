from collections import Counter

from pyspark.sql import functions as F

from symloom.operators.heavy import distinct_per_key, heavy_keys, joined_states, key_states, roll_up
from tests.conftest import as_set

SCHEMA = "kind string, target long, source long, n long"
DATA = [("a", 1, i % 7, 99) for i in range(300)] + [("b", i, i, 99) for i in range(100)] + [(None, 1, 1, 99)] * 5 + [("a", None, 1, 99)] * 5


def states(df):
    return key_states(df, [F.col("kind"), F.col("target")], {"s": F.col("source")})


def test_heavy_keys_count_all_rows_and_report_no_null_key(rows):
    df = rows(DATA, SCHEMA)
    assert as_set(heavy_keys(states(df), 100, ["kind", "target"]).select("kind", "target")) == {("a", 1)}
    assert as_set(heavy_keys(states(df), 410, ["kind", "target"]).select("kind", "target")) == {("a", 1)} | {("b", i) for i in range(100)}


def test_states_over_a_join_equal_the_join(rows):
    left, right = rows(DATA, SCHEMA), rows([(1, 10), (1, 20), (2, 5), (2, None), (None, 1), (500, 1)], "target long, line long")
    got = joined_states(states(left), key_states(right, [F.col("target")], {"l": F.col("line")}), "target", ["s"], ["l"])
    plain = left.join(right, "target").groupBy("kind", "target").agg(F.count(F.lit(1)).alias("c"), F.sum("source").alias("s"), F.sum("line").alias("l"))
    cols = ["kind", "target", "n_joined", "joined_s", "joined_l"]
    assert as_set(got.select(*cols)) == as_set(plain)
    by_kind = {r.kind: r.n_joined for r in roll_up(got, ["kind"], ["n_joined"]).collect()}
    assert by_kind == {r[0]: r[1] for r in left.join(right, "target").groupBy("kind").count().collect()}


def test_distinct_per_key(rows):
    got = {(r.kind, r.target): r.n_distinct for r in distinct_per_key(rows(DATA, SCHEMA), ["kind", "target"], "source").collect()}
    want = Counter((k, t) for k, t, _ in {(k, t, s) for k, t, s, _ in DATA})
    assert got == dict(want)


def test_empty(spark):
    assert heavy_keys(states(spark.createDataFrame([], SCHEMA)), 100, ["kind", "target"]).collect() == []


def test_keys_without_a_partner_stay_if_asked(rows):
    left, right = rows(DATA, SCHEMA), rows([(1, 10), (1, 20)], "target long, line long")
    got = joined_states(states(left), key_states(right, [F.col("target")], {"l": F.col("line")}), "target", ["s"], ["l"], keep_lost=True)
    assert {(r.kind, r.target): r.n for r in got.collect()} == {(r.kind, r.target): r.n for r in states(left).collect()}
    assert {(r.n_joined, r.joined_s, r.joined_l) for r in got.where("target <> 1").collect()} == {(0, 0, 0)}
    assert as_set(heavy_keys(got, 100, ["kind", "target"], states(left)).select("kind", "target", "n_joined")) == {("a", 1, 600)}
