"""Admission, readiness and delivery in the order that was asked for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cohorts(arrivals: DataFrame, keys: list[str], budget: int, most: int) -> DataFrame:
    """Cohorts of calls: from a first arrival on until ``most`` calls or ``budget`` after it, then anew.

    The budget isn't restarted by arrivals, so these aren't session windows: a fold in order of arrival.
    arrivals: keys, sample_id, arrival.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, c, opened, n = rows.sort_values(["arrival", "sample_id"]), [], -1, 0, most
        for at in rows["arrival"].tolist():
            if n < most and at <= opened + budget:
                n += 1
            else:
                c, opened, n = c + 1, at, 1
            out.append(c)
        return rows[[*keys, "sample_id", "arrival"]].assign(cohort=out)

    return _grouped(arrivals.select(*keys, "sample_id", "arrival"), keys, run, "cohort int")


def _grouped(rows: DataFrame, keys: list[str], run, more: str) -> DataFrame:
    """A fold per group in one pass over its rows, which come back with further columns."""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*keys).applyInPandas(run, f"{own}, {more}")


def broker_windows(requests: DataFrame, keys: list[str], callers: int, delay: int, saturated_budget: int) -> DataFrame:
    """Windows in which a broker collects requests before it plans them together.

    A window opens with a request and stays open until ``callers`` requests are in or its deadline
    passes: ``delay`` after it opened, or, as long as the store is saturated, the longest of ``delay``,
    ``saturated_budget`` and the store's usual service time. Whether it is saturated is looked at after
    each request. One caller never waits.
    requests: keys, sample_id, arrival, saturated, service. Adds broker_window and opened.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values(["arrival", "sample_id"]), []
        window, opened, n, until = -1, 0, callers, 0
        for at, saturated, service in rows[["arrival", "saturated", "service"]].itertuples(index=False, name=None):
            if n < callers and at < until:
                n += 1
            else:
                window, opened, n = window + 1, at, 1
            until = opened + (max(delay, saturated_budget, service) if saturated else delay)
            out.append((window, opened))
        return rows.assign(broker_window=[w for w, _ in out], opened=[o for _, o in out])

    return _grouped(requests.select(*keys, "sample_id", "arrival", "saturated", "service"), keys, run, "broker_window int, opened long")


def released(batches: DataFrame, keys: list[str], caller: str) -> DataFrame:
    """When each batch goes back to its caller: a caller's only batch as soon as it is ready, others with the window's last.

    batches: keys, caller, batch_id, ready. Adds single and released.
    """
    own = F.count(F.lit(1)).over(W.partitionBy(*keys, caller)) == 1
    last = F.max("ready").over(W.partitionBy(*keys))
    return batches.withColumn("single", own).withColumn("released", F.when(F.col("single"), F.col("ready")).otherwise(last))


def barriers(calls: DataFrame, keys: list[str], marks: DataFrame) -> DataFrame:
    """When each barrier is passed: once every call submitted before it, on every lane, has ended; at once if there is none.

    calls: keys, submitted, ended; marks: keys, barrier, at. Barriers and calls are merged in one order, so no pairs arise.
    """
    both = calls.select(*keys, F.col("submitted").alias("_t"), F.lit(0).alias("_m"), "ended", F.lit(None).cast("long").alias("barrier"))
    both = both.unionByName(marks.select(*keys, F.col("at").alias("_t"), F.lit(1).alias("_m"), F.lit(None).cast("long").alias("ended"), F.col("barrier").cast("long").alias("barrier")))
    upto = W.partitionBy(*keys).orderBy("_t", F.desc("_m"), "barrier").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_e", F.max("ended").over(upto)).filter("_m = 1").select(*keys, "barrier", F.col("_t").alias("at"), F.greatest(F.col("_t"), F.coalesce("_e", F.col("_t"))).alias("passed"))


#: FNV-1a, 64 bits: offset basis and prime. Fixed values.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> int:
    h = FNV_BASIS
    for b in text.encode("utf-8"):
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def lanes(calls: DataFrame, keys: list[str], n_lanes: int) -> DataFrame:
    """Lane of each cohort: of one stream, the stream's hash modulo the lanes; of several, the lanes in turn.

    calls: keys, cohort, video_id; cohorts are counted in their order within ``keys``.
    """

    @F.pandas_udf("int")
    def lane(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fnv1a(v) % n_lanes).astype("int32")

    c = calls.groupBy(*keys, "cohort").agg(F.min("video_id").alias("_v"), (F.min("video_id") == F.max("video_id")).alias("single"), F.count(F.lit(1)).alias("calls"))
    streams = c.filter("single").select("_v").distinct().withColumn("_l", lane("_v"))
    turn = F.sum(F.when(F.col("single"), 0).otherwise(1)).over(W.partitionBy(*keys).orderBy("cohort").rowsBetween(W.unboundedPreceding, 0)) - 1
    return c.withColumn("_t", turn).join(streams, "_v", "left").select(*keys, "cohort", "calls", "single", F.when(F.col("single"), F.col("_l")).otherwise((F.col("_t") % n_lanes).cast("int")).alias("lane"))


def ordered_delivery(batches: DataFrame, keys: list[str]) -> DataFrame:
    """When each batch can be handed over: not before any that was asked for earlier."""
    return batches.withColumn("delivered", F.max("ready").over(W.partitionBy(*keys).orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)))


def ready_groups(groups: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups that are ready as a whole, in order of their first sample, until ``least`` targets are gathered; none if there are too few.

    groups: keys, group_id, first_sample, targets, ready.
    """
    order = W.partitionBy(*keys).orderBy("first_sample", "group_id")
    r = groups.filter("ready").withColumn("_before", F.coalesce(F.sum("targets").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("targets").over(W.partitionBy(*keys)))
    return r.filter((F.col("_before") < least) & (F.col("_all") >= least)).drop("_before", "_all")


def microbatches(records: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return records.withColumn("microbatch", F.floor(at / size).cast("long"))


def occupancy(calls: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Calls open at every moment one begins."""
    ev = calls.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d"), "sample_id").unionByName(calls.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d"), "sample_id"))
    running = F.sum("d").over(W.partitionBy(*keys).orderBy("t", "d", "sample_id").rowsBetween(W.unboundedPreceding, 0))
    return ev.withColumn("open", running).filter("d = 1").select(*keys, "sample_id", "open")
