"""Hot keys, ordering, sources, streams and edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar import session
from lodestar.functions import columns as fn
from lodestar.operators import aggregates as agg
from lodestar.operators import features as fe
from lodestar.operators import networks as net
from lodestar.operators import ordered, windows
from lodestar.operators import relational as rel
from lodestar.sources import files, jdbc
from lodestar.streaming import windows as st


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds more than a third of the rows."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": np.where(rng.random(600) < 0.4, 0, rng.integers(1, 20, 600)), "t": rng.integers(0, 90, 600),
                        "id": np.arange(600), "v": rng.integers(0, 50, 600)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_and_neighbours(hot, parts):
    pdf, df = hot
    df = df.repartition(parts)
    want = pdf.sort_values(["k", "t", "id"])
    g = want.groupby("k")
    want = want.assign(run=g.v.cumsum(), prev=g.v.shift(1), nxt=g.v.shift(-1)).set_index("id")
    got = ordered.running_sums(df, ["k"], ["t", "id"], {"run": F.col("v")}).toPandas().set_index("id")
    assert (got.run.sort_index() == want.run.sort_index()).all()
    got = ordered.neighbours(df, ["k"], ["t", "id"], {"prev": "v"}, {"nxt": "v"}).toPandas().set_index("id")
    for c in ("prev", "nxt"):
        pd.testing.assert_series_equal(got[c].sort_index(), want[c].sort_index(), check_dtype=False)


def test_no_range_holds_a_hot_key(hot):
    pdf, df = hot
    ranges = ordered.Ranges(df, ["k"], ["t", "id"])
    sizes = [r["count"] for r in ranges.number(df, "c").groupBy("c").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.4 * 600 / 8
    spread = {r.k for r in ranges.spread(df).select("k").distinct().collect()}
    assert 0 in spread and len(spread) < 9


@pytest.mark.parametrize("order", [["t", "id"], [ordered.desc("t"), "id"], [ordered.desc("t"), ordered.desc("id")]])
@pytest.mark.parametrize("hot_key", [True, False])
def test_one_tie_is_spread_over_ranges(spark, order, hot_key):
    """A text that nearly all rows of a key share, nulls and descending order; against a sort in Python."""
    rng = np.random.default_rng(7)
    rows = [(None if hot_key and i % 50 else "ab"[i % 2], [None, "x", "y", "same"][0 if x < 0.03 else 1 if x < 0.06 else 2 if x < 0.1 else 3],
             int(i), int(v)) for i, (x, v) in enumerate(zip(rng.random(800), rng.integers(0, 9, 800)))]
    rng.shuffle(rows)
    rows = [(k, t, int(i), int(v)) for k, t, i, v in rows]
    df = spark.createDataFrame(rows, "k string, t string, id int, v int").repartition(3)
    down = [isinstance(o, ordered.desc) for o in order]
    key = sorted(rows, key=lambda r: -r[2] if down[1] else r[2])
    key.sort(key=lambda r: (r[1] is not None, r[1] or ""), reverse=down[0])
    run, prev, nxt, last = {}, {}, {}, {}
    for k, _, i, v in key:
        j, before = last.get(k, (None, None))
        run[i], prev[i], nxt[i] = run.get(j, 0) + v, before, None
        if j is not None:
            nxt[j] = v
        last[k] = (i, v)
    got = ordered.running_sums(df, ["k"], order, {"run": F.col("v")})
    assert {r.id: r.run for r in got.collect()} == run
    got = ordered.running_sums(df, ["k"], order, {"run": F.col("v")}, before=True)
    assert {r.id: r.run + r.v for r in got.collect()} == run
    got = {r.id: (r.p, r.n) for r in ordered.neighbours(df, ["k"], order, {"p": "v"}, {"n": "v"}).collect()}
    assert got == {i: (prev[i], nxt[i]) for i in run}
    sizes = ordered.Ranges(df, ["k"], order).number(df, "c").groupBy("c").count()
    assert sizes.agg(F.max("count")).first()[0] < 1.4 * 800 / 8


def test_plans_do_not_grow_with_the_ranges(spark, hot):
    _, df = hot
    plans, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = ordered.neighbours(df, ["k"], ["t", "id"], {"p": "v"})
            plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert abs(len(plans[0]) - len(plans[1])) < 0.02 * len(plans[0])


def test_rows_are_shuffled_once(spark):
    """The rows of an ordered query meet one hash exchange; what is carried is narrow."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts", "value")
    out = ordered.neighbours(rows, ["user_id"], ["ts", "event_id"], {"p": "value"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning(user_id" in line and "__c" in line]
    assert len(wide) == 2  # the rows, and the last row of each hot (key, range)
    assert plan.count("WindowGroupLimit") == 2


def test_exact_quantiles(hot):
    pdf, df = hot
    got = ordered.quantiles(df, "v", {"a": 0.25, "b": 0.9}, by=["k"]).toPandas().set_index("k").sort_index()
    assert np.allclose(got.a, pdf.groupby("k").v.quantile(0.25)) and np.allclose(got.b, pdf.groupby("k").v.quantile(0.9))
    assert ordered.order_statistic(df, "v", 0.9, "x").first().x == np.sort(pdf.v)[int(np.ceil(0.9 * 600)) - 1]


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    got = agg.with_group_agg(df, ["k"], [F.sum("v").alias("s")]).collect()
    assert sorted((r.v, r.s) for r in got) == [(1, 3), (2, 3), (3, 3)]


def test_group_limit_reaches_below_the_shuffle(hot):
    plan = rel.first_per_key(hot[1], ["k"], [F.col("t"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_frequency_rank_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert {r.value: r["rank"] for r in windows.frequency_rank(df, ["x"]).collect()} == {"c": 1, "a": 2, "b": 3}


def test_splits_do_not_depend_on_partitions(hot):
    _, df = hot
    a = fe.assign_fold(df, "id", 4).select("id", "fold").toPandas().set_index("id").sort_index()
    b = fe.assign_fold(df.repartition(5, "v"), "id", 4).select("id", "fold").toPandas().set_index("id").sort_index()
    assert (a == b).all().all() and set(a.fold.value_counts()) == {150}


def test_one_hot_takes_all_levels(spark):
    out = fe.one_hot(spark.range(1200).select(F.col("id").cast("string").alias("x")), ["x"], drop_first=False)
    assert len(out.columns) == 1200 and {sum(r) for r in out.limit(5).collect()} == {1}


def test_decay_keeps_all_ties_without_enough_renewals(spark):
    rows = [("a", "b", dt.date(2000, 1, 1)), ("a", "b", dt.date(2001, 1, 1)), ("a", "c", dt.date(1990, 1, 1))]
    links = spark.createDataFrame(rows, "x string, y string, d date")
    out = net.decay_ties(links, "x", "y", "d", F.lit(dt.date(2001, 1, 2)))
    assert out.count() == 3


def test_dates_and_text(spark):
    df = spark.createDataFrame([("3/4/85",), ("3/4/12",), ("1999/12/31",), ("bad",)], "s string")
    got = [r[0] for r in df.select(fn.parse_mixed_date(F.col("s"))).collect()]
    assert got == [dt.date(1985, 3, 4), dt.date(2012, 3, 4), dt.date(1999, 12, 31), None]
    one = spark.range(1)
    assert one.select(fn.format_thousands(F.lit(1234.45).cast("decimal(10,2)"))).first()[0] == "1,234.5"
    assert one.select(fn.year_from_text(F.lit("12/31/xx"))).first()[0] is None
    assert one.select(fn.safe_ratio(F.lit(1.0), F.lit(0.0))).first()[0] is None
    assert one.select(fn.geo_distance(*map(F.lit, (0.0, 0.0, 0.0, 90.0)))).first()[0] == pytest.approx(fn.EARTH_RADIUS_M * np.pi / 2)
    blank = spark.createDataFrame([("",), ("xay",), ("q",)], "s string")
    assert [r[0] for r in blank.select(rel.match_any(F.col("s"), ["a", "b"])).collect()] == [None, 1, 0]


def test_grid_size_is_checked(spark):
    with pytest.raises(ValueError):
        rel.expand_grid(spark, {"a": range(100), "b": range(100)}, limit=100)


def test_standing_and_movement_advice(spark):
    rows = [("2024-01-01 00:01:00", "sit", 0.0), ("2024-01-01 00:02:00", "stand", 0.0), ("2024-01-01 00:03:00", "sit", 2.0),
            ("2024-01-01 00:16:00", "sit", 9.0), ("2024-01-01 00:31:00", "stand", 10.0), ("2024-01-01 00:46:00", "walk", 30.0)]
    df = spark.createDataFrame(rows, "s string, gt string, x double").withColumn("ts", F.to_timestamp("s"))
    got = [r.recommend_standing for r in windows.standing_advice(df, "ts", "gt", "sit", "stand").orderBy("start").collect()]
    assert got == ["yes", "yes", "no"]
    moved = [r.recommend_moving for r in windows.movement_advice(df, "ts", "gt", ["x"]).orderBy("start").collect()]
    assert moved == ["no", "no", "yes", "no"]


def test_import_options():
    o = jdbc.import_options("jdbc:x", "orders", {"user": "u", "password": "p"}, "id", (0, 99), 4)
    assert o["partitionColumn"] == "id" and o["upperBound"] == "99" and o["numPartitions"] == "4"
    assert "partitionColumn" not in jdbc.import_options("jdbc:x", "orders", {})
    with pytest.raises(ValueError):
        jdbc.import_options("jdbc:x", "orders", {}, "id")


def test_materialize_reads_the_saved_copy(spark):
    path = session.scratch_path(spark, "m")
    assert session.materialize(spark.range(3), path).count() == 3
    assert session.materialize(spark.range(99), path).count() == 3


def test_key_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (None, 3)], "k int, v int")
    assert [tuple(r) for r in files.check_unique(df, ["k"]).collect()] == [(1, 2)]
    parents = spark.createDataFrame([(1,)], "id int")
    assert [r.v for r in files.check_foreign_key(df, parents, "k", "id").collect()] == [9]


def test_adjacency_of_a_hub_is_blocked(spark):
    edges = spark.range(1000).select(F.lit("hub").alias("src"), F.col("id").alias("dst"))
    blocks = files.adjacency(edges, F.col("dst") % 10)
    assert blocks.count() == 10 and blocks.agg(F.max(F.size("dsts"))).first()[0] == 100


@pytest.fixture(scope="module")
def activity(spark, t):
    path = session.scratch_path(spark, "activity")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    t.events.select(ns.alias("Creation_Time"), F.col("event_type").alias("gt"), F.col("value").alias("x")).repartition(6).write.json(path)
    return path, "Creation_Time bigint, gt string, x double"


def stats(df, watermark=None):
    return st.window_stats(st.with_event_time(df, "Creation_Time"), "event_time", "5 minutes", ["gt"],
                           [F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("x")], watermark)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch(spark, activity):
    path, schema = activity
    batch = rows(stats(spark.read.schema(schema).json(path)))
    q = st.start_memory_query(stats(st.stream_json(spark, path, schema, 2)), "activity_stats", session.scratch_path(spark, "ck"))
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    assert rows(spark.table("activity_stats")) == batch
    out = session.scratch_path(spark, "snap")
    q = st.start_snapshot_query(stats(st.stream_json(spark, path, schema, 3)), out, session.scratch_path(spark, "ck"))
    q.awaitTermination()
    st.stop(q)
    assert rows(st.latest_snapshot(spark, out)) == batch


def test_running_query_can_be_drained_and_stopped(spark, activity):
    path, schema = activity
    q = st.start_memory_query(stats(st.stream_json(spark, path, schema, 3)), "polled", session.scratch_path(spark, "ck"), available_now=False)
    assert st.drain(q) >= 1
    assert spark.table("polled").count() > 0
    st.stop(q)
    assert not q.isActive


def test_watermarked_append_emits_closed_windows(spark, activity):
    path, schema = activity
    out = session.scratch_path(spark, "append")
    q = st.start_append_query(stats(st.stream_json(spark, path, schema, 10), "1 minute"), out, session.scratch_path(spark, "ck"))
    q.awaitTermination()
    got, batch = set(rows(spark.read.parquet(out))), set(rows(stats(spark.read.schema(schema).json(path))))
    assert got and got <= batch and len(batch - got) <= 5


@pytest.mark.parametrize("parts", [1, 5])
def test_nulls_in_the_sort_column_come_first(spark, parts):
    rng = np.random.default_rng(4)
    rows = [(int(k), None if x < 0.1 else float(x), i, int(v)) for i, (k, x, v) in enumerate(
        zip(rng.integers(0, 3, 1000), rng.random(1000), rng.integers(0, 9, 1000)))]
    df = spark.createDataFrame(rows, "k int, t double, id int, v int").repartition(parts)
    run, prev, last = {}, {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0.0, r[2])):
        run[i], prev[i] = last.get(k, (0, None))[0] + v, last.get(k, (0, None))[1]
        last[k] = (run[i], v)
    got = ordered.running_sums(df, ["k"], ["t", "id"], {"run": F.col("v")}).collect()
    assert {r.id: r.run for r in got} == run
    got = ordered.neighbours(df, ["k"], ["t", "id"], {"prev": "v"}).collect()
    assert {r.id: r.prev for r in got} == prev


def test_activity_ends_after_the_last_period(spark):
    df = spark.createDataFrame([("a", 2000), ("a", 2001), ("b", 2002), ("c", 2000), ("c", 2002)], "k string, y int")
    got = {r.k: (r.join, r.leave) for r in windows.activity_span(df, "k", "y").collect()}
    assert got == {"a": (1, 3), "b": (3, 3), "c": (1, 3)}
    new = windows.novelty(df, ["k"], "y", 2, "new").collect()
    assert {(r.k, r.y): r.new for r in new} == {("a", 2000): 1, ("a", 2001): 1, ("b", 2002): 1, ("c", 2000): 1, ("c", 2002): 0}


def test_a_restarted_stream_drops_old_state(spark, t):
    from lodestar.plans import stream_queries as sq
    out, (first, second) = sq.restarted(t)
    windows_ = sq.stats(sq.activity(t), "5 minutes").count()
    state = lambda q: q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert first.id == second.id and first.runId != second.runId  # one query, started twice
    assert 0 < state(first) < windows_ / 4 and state(second) == 1  # only the event that is ahead of all is open
    closed = spark.read.parquet(out)
    assert closed.count() == windows_ == closed.select("start", "gt").distinct().count()


def test_sql_functions(spark):
    from lodestar.functions import sql
    sql.register(sql.register(spark))
    rows = spark.sql("select * from contributions(array('a', 'b'), 6D, 3)").collect()
    assert [tuple(r) for r in rows] == [("a", 2.0), ("b", 2.0)]
    assert spark.sql("select * from contributions(cast(array() as array<string>), 1D, 1)").collect() == []
    row = spark.sql("select hhi(2500D + 2500D, 100D) as a, hhi(0D, 0D) as b, hhi(null, 1D) as c").first()
    assert (row.a, row.b, row.c) == (5000.0, None, None)
