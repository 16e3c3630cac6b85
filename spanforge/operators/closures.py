"""Dependency closures: which records a target's decoding needs, in decode order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["video_id", "gop_id"]


#: Where a closure's records lie, if the closure says so itself.
PLACE = ["offset", "length", *GROUP]


def hierarchical(catalog: DataFrame, placed: bool = False) -> DataFrame:
    """I: itself. P: I and P up to it. B: I and P up to its right reference, its interval's first B in decode order, itself.

    The join's key is the group: work is the square of a group's size, which the
    format bounds, however many groups a stream has. ``placed`` adds the extent and group of each dependency.
    """
    between = (F.col("frame_type") == "B") & (F.col("packet_index") == F.min(F.when(F.col("frame_type") == "B", F.col("packet_index"))).over(W.partitionBy(*GROUP, "right_ref")))
    marked = catalog.withColumn("_middle", between)
    t = marked.select(*GROUP, F.col("record_id").alias("target_id"), F.col("frame_type").alias("t_type"), F.col("k").alias("t_k"), F.col("right_ref").alias("t_ref"))
    d = marked.select(*GROUP, F.col("record_id").alias("dep_id"), "frame_type", "k", "packet_index", "right_ref", "_middle", F.col("record_offset").alias("offset"), F.col("record_length").alias("length"))
    own = F.col("dep_id") == F.col("target_id")
    anchors = F.col("frame_type") != "B"
    keep = (
        F.when(F.col("t_type") == "I", own)
        .when(F.col("t_type") == "P", anchors & (F.col("k") <= F.col("t_k")))
        .otherwise((anchors & (F.col("k") <= F.col("t_ref"))) | own | (F.col("_middle") & (F.col("right_ref") == F.col("t_ref"))))
    )
    return t.join(d, GROUP).filter(keep).select("target_id", "dep_id", "packet_index", *(PLACE if placed else []))


def chained(catalog: DataFrame) -> DataFrame:
    """Streams of I and P: everything up to the target, as pairs within a group."""
    t = catalog.select(*GROUP, F.col("record_id").alias("target_id"), F.col("packet_index").alias("_at"))
    d = catalog.select(*GROUP, F.col("record_id").alias("dep_id"), "packet_index")
    return t.join(d, GROUP).filter(F.col("packet_index") <= F.col("_at")).select("target_id", "dep_id", "packet_index")


def shared_anchor(catalog: DataFrame) -> DataFrame:
    """Each record needs its group's first and itself."""
    first = F.min(F.struct("packet_index", "record_id")).over(W.partitionBy(*GROUP))
    both = catalog.withColumn("_first", first)
    own = both.select(F.col("record_id").alias("target_id"), F.col("record_id").alias("dep_id"), "packet_index")
    anchor = both.filter(F.col("_first.record_id") != F.col("record_id")).select(F.col("record_id").alias("target_id"), F.col("_first.record_id").alias("dep_id"), F.col("_first.packet_index").alias("packet_index"))
    return own.unionByName(anchor)


def violations(closure: DataFrame, catalog: DataFrame) -> DataFrame:
    """(target_id, reason): no closure, without itself, another group's record, or a place in decode order taken twice."""
    at = catalog.select(F.col("record_id").alias("dep_id"), *(F.col(c).alias(f"d_{c}") for c in GROUP))
    of = catalog.select(F.col("record_id").alias("target_id"), *GROUP)
    edges = of.join(closure, "target_id", "left").join(at, "dep_id", "left")
    seen = edges.groupBy("target_id").agg(
        F.count("dep_id").alias("n"),
        F.count_if(F.col("dep_id") == F.col("target_id")).alias("own"),
        F.count_if(F.col("dep_id").isNotNull() & ~(F.col("d_video_id").eqNullSafe(F.col("video_id")) & F.col("d_gop_id").eqNullSafe(F.col("gop_id")))).alias("other"),
        F.countDistinct("packet_index").alias("places"),
    )
    reason = F.when(F.col("n") == 0, "empty").when(F.col("own") != 1, "without target").when(F.col("other") > 0, "other group").when(F.col("places") != F.col("n"), "decode order")
    return seen.select("target_id", reason.alias("reason")).filter("reason is not null")


def union(targets: DataFrame, closure: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct records the targets (keys, record_id) need, with their extents, by ``keys``.

    Targets are made distinct before the closures are joined. A closure has its records' places from the
    catalog once, however many windows need it, so what windows need goes through one exchange, by ``keys``,
    and is made distinct and planned where it arrives.
    """
    asked = targets.select(*keys, F.col("record_id").alias("target_id")).distinct()
    deps = asked.join(placed(closure, catalog), "target_id")
    return deps.select(*keys, F.col("dep_id").alias("record_id"), "offset", "length", *GROUP, "packet_index").repartition(*keys).distinct()


def placed(closure: DataFrame, catalog: DataFrame) -> DataFrame:
    """A closure with the extent and group of each dependency, and its place in the catalog's decode order."""
    if set(PLACE) <= set(closure.columns):
        return closure
    place = catalog.select(F.col("record_id").alias("dep_id"), F.col("record_offset").alias("offset"), F.col("record_length").alias("length"), *GROUP, "packet_index")
    return closure.select("target_id", "dep_id").join(place, "dep_id")


def without(records: DataFrame, resident: DataFrame, keys: list[str]) -> DataFrame:
    """What must be fetched when the resident records (keys, record_id) are held already."""
    return records.join(resident.select(*keys, "record_id").distinct(), [*keys, "record_id"], "left_anti")


def regions(catalog: DataFrame) -> DataFrame:
    """One contiguous cover a group."""
    return catalog.groupBy(*GROUP).agg(
        F.min("record_offset").alias("region_offset"),
        (F.max(F.col("record_offset") + F.col("record_length")) - F.min("record_offset")).alias("region_length"),
        F.count(F.lit(1)).alias("records"),
    )


def keyframe_prefix(targets: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Per touched group one span over all records up to the furthest target in decode order."""
    furthest = targets.groupBy(*keys, *GROUP).agg(F.max("packet_index").alias("packet_index"))
    return furthest.join(prefixes(catalog), [*GROUP, "packet_index"]).select(*keys, *GROUP, "span_offset", "span_length", "records")


def prefixes(catalog: DataFrame) -> DataFrame:
    """Per record one span over its group's records up to it in decode order: a row a record, whatever is asked for."""
    upto = W.partitionBy(*GROUP).orderBy("packet_index").rangeBetween(W.unboundedPreceding, 0)
    begin, end = F.min("record_offset").over(upto), F.max(F.col("record_offset") + F.col("record_length")).over(upto)
    return catalog.select(*GROUP, "packet_index", begin.alias("span_offset"), (end - begin).alias("span_length"), F.count(F.lit(1)).over(upto).alias("records"))


def display_ordinals(catalog: DataFrame) -> DataFrame:
    """Rank of each record by frame within its group."""
    return catalog.select("record_id", (F.row_number().over(W.partitionBy(*GROUP).orderBy("frame_idx")) - 1).alias("ordinal"))
