"""Queries over file streams. The events table is written as JSON files and streamed."""

from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows, r
from lodestar.plans.registry import query
from lodestar.session import cut_lineage, scratch_path
from lodestar.streaming import windows as st

SCHEMA = "Creation_Time bigint, gt string, x double, y double, z double"
STATS_SQL = """
    select strftime(time_bucket(interval {width} minutes, ts), '%Y-%m-%d %H:%M') as start, event_type as gt,
      count(*)::bigint as n, round(avg(value), 6) as x, round(avg(json_extract_string(props, '$.k')::double), 6) as y,
      round(avg(length(props)::double), 6) as z from events group by 1, 2"""


def activity(t):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return t.events.select(ns.alias("Creation_Time"), F.col("event_type").alias("gt"), F.col("value").alias("x"),
                           F.get_json_object("props", "$.k").cast("double").alias("y"),
                           F.length("props").cast("double").alias("z"))


def activity_files(t):
    path = scratch_path(t.spark, "activity")
    activity(t).repartition(6).write.json(path)
    return path


def stats(rows, width, watermark=None):
    aggs = [n_rows().alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z")]]
    return st.window_stats(st.with_event_time(rows, "Creation_Time"), "event_time", width, ["gt"], aggs, watermark)


def shown(df):
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "gt", "n",
                     *[r(c).alias(c) for c in ("x", "y", "z")])


@query("I1 I2 I3 I4 I5 A10 A11", STATS_SQL.format(width=5))
def streamed_activity_stats(t):
    """Stream of JSON files, complete mode, read back after the last batch."""
    source = activity_files(t)
    out, checkpoint = scratch_path(t.spark, "snapshots"), scratch_path(t.spark, "checkpoint")
    q = st.start_snapshot_query(stats(st.stream_json(t.spark, source, SCHEMA, 2), "5 minutes"), out, checkpoint)
    st.drain(q)
    q.awaitTermination()
    return shown(st.latest_snapshot(t.spark, out))


SLICES = 6


def restarted(t, watermark="12 hours"):
    """Path of closed windows of a watermarked stream that is stopped halfway and started again.

    Slices of time arrive one after the other, as a log does; the first half is
    processed and the query ends, the second half goes on from the checkpoint
    with the state that is left. A last event far ahead lets all windows close.
    """
    source, out, checkpoint = (scratch_path(t.spark, name) for name in ("slices", "closed", "checkpoint"))
    rows = cut_lineage(activity(t))
    ends = rows.agg(F.min("Creation_Time").alias("lo"), (F.max("Creation_Time") + 1).alias("hi")).first()
    cuts = [ends.lo + (ends.hi - ends.lo) * i // SLICES for i in range(SLICES + 1)] if ends.lo is not None else []
    queries = []
    for half in (range(SLICES // 2), range(SLICES // 2, SLICES)):
        for i in half if cuts else ():
            part = rows.filter((F.col("Creation_Time") >= cuts[i]) & (F.col("Creation_Time") < cuts[i + 1]))
            part.write.mode("append").json(source)
        if cuts and half[-1] == SLICES - 1:
            last = t.spark.range(1).select(F.lit(cuts[-1] + 10 ** 16).alias("Creation_Time"), F.lit("end").alias("gt"))
            last.write.mode("append").json(source)
        if cuts:
            q = st.start_append_query(stats(st.stream_json(t.spark, source, SCHEMA, 1000), "5 minutes", watermark), out, checkpoint)
            st.drain(q)
            q.awaitTermination()
            queries.append(q)
    return out, queries


@query("I4 A11 I2 I5", STATS_SQL.format(width=5))
def restarted_activity_stats(t):
    """Append mode with a watermark: every window is written once, when it closes, and its state goes."""
    out, queries = restarted(t)
    closed = t.spark.read.parquet(out) if queries else stats(activity(t), "5 minutes").limit(0)
    return shown(closed.filter("gt <> 'end'"))


@query("I6 I3", STATS_SQL.format(width=15))
def batch_activity_stats(t):
    return shown(stats(activity(t), "15 minutes"))
