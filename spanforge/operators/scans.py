"""Catalog scans, lookups and the validation suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["video_id", "gop_id"]


def video_ids(catalog: DataFrame) -> DataFrame:
    return catalog.select("video_id").distinct().orderBy("video_id")


def frame_indices(catalog: DataFrame, video_id: str) -> DataFrame:
    """Distinct frames of one stream in order; an unknown stream is a KeyError."""
    found = catalog.filter(F.col("video_id") == video_id).select("frame_idx").distinct().orderBy("frame_idx")
    if found.isEmpty():
        raise KeyError(video_id)
    return found


def tiers(catalog: DataFrame, stride: int = 4) -> DataFrame:
    """The tiered index: tier 0 the middle keyframe of each stream, tier 1 every ``stride``-th group, tier 2 all keyframes.

    Offsets run through the tiers in order, so each section is contiguous.
    """
    keys = catalog.filter(F.col("frame_type") == "I").select("video_id", "gop_id", "frame_idx", F.col("record_length").alias("length"))
    n = F.count(F.lit(1)).over(W.partitionBy("video_id"))
    at = F.row_number().over(W.partitionBy("video_id").orderBy("gop_id")) - 1
    keys = keys.withColumn("_n", n).withColumn("_at", at)
    parts = [
        keys.filter(F.col("_at") == F.floor(F.col("_n") / 2)).withColumn("tier", F.lit(0)),
        keys.filter(F.col("_at") % stride == 0).withColumn("tier", F.lit(1)),
        keys.withColumn("tier", F.lit(2)),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("_n", "_at")
    # two levels: within a stream and tier, then over one row per stream and tier
    own = W.partitionBy("tier", "video_id").orderBy("gop_id").rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("tier", "video_id").agg(F.sum("length").alias("_t"))
    shift = totals.select("tier", "video_id", (F.sum("_t").over(W.orderBy("tier", "video_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_shift"))
    placed = rows.withColumn("_own", F.sum("length").over(own) - F.col("length")).join(shift, ["tier", "video_id"])
    return placed.select("video_id", "tier", (F.col("_shift") + F.col("_own")).alias("offset"), "length", "frame_idx", "gop_id", F.lit("idr").alias("dependency_kind"))


def nth(index: DataFrame, n: int) -> DataFrame:
    """The n-th record (from 0) of every stream and tier."""
    at = F.row_number().over(W.partitionBy("video_id", "tier").orderBy("offset")) - 1
    return index.withColumn("_at", at).filter(F.col("_at") == n).drop("_at")


def slice_of(index: DataFrame, start: int, count: int) -> DataFrame:
    """Records ``start`` to ``start + count`` of every stream and tier, clipped to the end."""
    at = F.row_number().over(W.partitionBy("video_id", "tier").orderBy("offset")) - 1
    return index.withColumn("nth", at).filter((F.col("nth") >= start) & (F.col("nth") < start + count))


def counts_for(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Records of each asked (video_id, tier); unknown ones have none."""
    n = index.groupBy("video_id", "tier").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(n, ["video_id", "tier"], "left").select("video_id", "tier", F.coalesce("n", F.lit(0)).alias("records"))


def violations(catalog: DataFrame, payload_bytes: int | None = None) -> DataFrame:
    """(record_id, reason) of everything a catalog must not have; empty for a sound one."""
    c = F.col
    rules = {
        "null": F.greatest(*(c(x).isNull().cast("int") for x in ("record_id", "video_id", "frame_idx", "gop_id", "packet_index", "record_offset", "record_length"))) == 1,
        "empty video": c("video_id") == "",
        "negative": (c("frame_idx") < 0) | (c("gop_id") < 0) | (c("record_offset") < 0) | (c("record_id") < 0),
        "empty record": c("record_length") <= 0,
        "overflow": F.try_add("record_offset", "record_length").isNull() & c("record_offset").isNotNull() & c("record_length").isNotNull(),
    }
    if payload_bytes is not None:
        rules["outside payload"] = F.try_add("record_offset", "record_length") > payload_bytes
    single = catalog.select("record_id", F.explode(F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules.items())))).alias("reason"))
    twice = catalog.groupBy("record_id").count().filter("count > 1").select("record_id", F.lit("duplicate id").alias("reason"))
    frames = catalog.groupBy("video_id", "frame_idx").agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_id", F.lit("duplicate frame").alias("reason"))
    before = F.lag("packet_index").over(W.partitionBy("video_id").orderBy("record_offset", "record_id"))
    order = catalog.withColumn("_b", before).filter(c("_b") >= c("packet_index")).select("record_id", F.lit("decode order").alias("reason"))
    return single.unionByName(twice).unionByName(frames).unionByName(order)
