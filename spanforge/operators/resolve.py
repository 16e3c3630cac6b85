"""Target resolution: requests to records, representations and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class UnknownTargets(KeyError):
    """A window asks for records that the catalog lacks."""


def unknown(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    return requests.join(catalog.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")


def resolve(requests: DataFrame, catalog: DataFrame, strict: bool = False) -> DataFrame:
    """Requests with their record; duplicates and positions stay.

    The side to broadcast is left to the planner, which knows sizes. ``strict`` fails
    the call if any target is unknown.
    """
    if strict and (missing := unknown(requests.select("video_id", "frame_idx").distinct(), catalog).first()):
        raise UnknownTargets(f"{missing['video_id']} frame {missing['frame_idx']}")
    return requests.join(catalog, ["video_id", "frame_idx"])


def first_occurrences(targets: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys, "record_id").orderBy("batch_id", "pos")
    return targets.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def round_robin(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The j-th request for a (video_id, tier) gets its candidate j modulo their number.

    asked: request_id, video_id, tier.
    """
    c = index.withColumn("_j", F.row_number().over(W.partitionBy("video_id", "tier").orderBy("offset")) - 1)
    n = index.groupBy("video_id", "tier").agg(F.count(F.lit(1)).alias("_n"))
    q = asked.withColumn("_i", F.row_number().over(W.partitionBy("video_id", "tier").orderBy("request_id")) - 1).join(n, ["video_id", "tier"]).withColumn("_j", (F.col("_i") % F.col("_n")).cast("int"))
    return q.join(c.select("video_id", "tier", "_j", "offset", "length", "frame_idx"), ["video_id", "tier", "_j"]).select("request_id", "video_id", "tier", "offset", "length", "frame_idx")


def tier_record(requests: DataFrame, sizes: DataFrame, gop: int, stride: int, tier: int, clamp: bool) -> DataFrame:
    """Record number of each requested frame in its tier: 0, group / stride or group.

    Beyond the last record: clamped to it, or null (an error for the caller).
    sizes: video_id, records.
    """
    g = F.floor(F.col("frame_idx") / gop)
    at = {0: F.lit(0).cast("long"), 1: F.floor(g / stride), 2: g}[tier]
    both = requests.join(sizes, "video_id")
    inside = F.least(at, F.col("records") - 1) if clamp else F.when(at < F.col("records"), at)
    return both.select("sample_id", "video_id", "frame_idx", inside.cast("long").alias("record_index"))


def modal_gap(index: DataFrame, tier: int, default: int) -> DataFrame:
    """Most frequent positive distance of consecutive frames in a tier; ties: the smallest. One row ``gop_size``."""
    before = F.lag("frame_idx").over(W.partitionBy("video_id").orderBy("frame_idx"))
    steps = index.filter(F.col("tier") == tier).select((F.col("frame_idx") - before).alias("step")).filter("step > 0")
    best = steps.groupBy("step").count().agg(F.max(F.struct("count", (-F.col("step")).alias("s"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.s"), F.lit(default)).cast("long").alias("gop_size"))


def fragments(requests: DataFrame, fragments_: DataFrame, gop: int) -> DataFrame:
    """Fragment of each frame by (stream, frame div gop), with its ordinal inside; unknown ones are null."""
    q = requests.withColumn("gop_id", F.floor(F.col("frame_idx") / gop).cast("long")).withColumn("ordinal", F.col("frame_idx") % gop)
    return q.join(fragments_, ["video_id", "gop_id"], "left")


def route_pairs(requests: DataFrame, materialized: DataFrame) -> DataFrame:
    """Each request to the pair file if its record is there, else to the fallback, with its place in its branch."""
    have = materialized.select("record_id").distinct().withColumn("_have", F.lit(True))
    routed = requests.join(have, "record_id", "left").withColumn("branch", F.when(F.col("_have"), "pair").otherwise("fallback")).drop("_have")
    order = W.partitionBy("window_id", "branch").orderBy("batch_id", "pos")
    return routed.withColumn("branch_pos", (F.row_number().over(order) - 1).cast("long"))


def one_of(records: DataFrame, keys: list[str], record: str, seed: int) -> DataFrame:
    """One record of each key, the same for the same seed: the smallest hash of its id and the seed."""
    place = F.struct(F.md5(F.concat_ws(":", F.col(record).cast("string"), F.lit(str(seed)))), F.col(record))
    return records.groupBy(*keys).agg(F.min_by(record, place).alias(record))
