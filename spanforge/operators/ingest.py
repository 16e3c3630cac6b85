"""Building catalogs and layouts: ordinals, placement, statistics, page layouts, pair files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["video_id", "gop_id"]


def probe_ordinals(frames: DataFrame) -> DataFrame:
    """Display ordinal of each packet: the rank of its pts in its stream; a pts that repeats is an error row."""
    n = F.count(F.lit(1)).over(W.partitionBy("video_id", "pts"))
    at = F.row_number().over(W.partitionBy("video_id").orderBy("pts")) - 1
    return frames.select("video_id", "record_id", "pts", at.alias("display_ordinal"), (n > 1).alias("duplicate_pts"))


def longest_b_run(catalog: DataFrame) -> DataFrame:
    """Longest run of B records in display order, by stream."""
    order = W.partitionBy("video_id").orderBy("frame_idx")
    runs = catalog.withColumn("_run", F.sum(F.when(F.col("frame_type") == "B", 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    long = runs.groupBy("video_id", "_run").agg(F.count_if(F.col("frame_type") == "B").alias("n"))
    return long.groupBy("video_id").agg(F.max("n").alias("max_b_run"))


def nearest_rank(values: DataFrame, value: str, q: float) -> DataFrame:
    """The element at ceil((n - 1) q) of the ordered values, one row ``value``.

    Values are counted first, so what is ordered is the distinct values and not the rows.
    """
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    total = counts.agg(F.sum("c").alias("n"))
    ranked = counts.withColumn("upto", upto).crossJoin(F.broadcast(total))  # one row
    return ranked.filter(F.col("upto") > F.ceil((F.col("n") - 1) * F.lit(q))).agg(F.min("v").alias("value"))


def build_stats(catalog: DataFrame, closure: DataFrame) -> DataFrame:
    """One row: records by type, groups, and the distribution of closure sizes."""
    sizes = closure.groupBy("target_id").agg(F.count(F.lit(1)).alias("size"))
    kinds = catalog.agg(
        F.count(F.lit(1)).alias("records"),
        *(F.count_if(F.col("frame_type") == t).alias(f"n_{t.lower()}") for t in "IPB"),
        F.countDistinct(*GROUP).alias("gops"),
    )
    spread = sizes.agg(F.round(F.avg("size"), 6).alias("closure_mean"), F.max("size").alias("closure_max"))
    median = nearest_rank(sizes, "size", 0.5).withColumnRenamed("value", "closure_median")
    p95 = nearest_rank(sizes, "size", 0.95).withColumnRenamed("value", "closure_p95")
    return kinds.crossJoin(spread).crossJoin(median).crossJoin(p95)  # one row each


def fused_layout(catalog: DataFrame) -> DataFrame:
    """Each group's first record as anchor, the others as deltas, at running offsets of their own file."""
    order = W.partitionBy(*GROUP).orderBy("packet_index")
    rows = catalog.withColumn("kind", F.when(F.row_number().over(order) == 1, "anchor").otherwise("delta"))
    own = F.sum("record_length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("record_length")
    totals = catalog.groupBy(*GROUP).agg(F.sum("record_length").alias("_t"))
    # one row a group: a second level over streams keeps the global part small
    by_stream = totals.groupBy("video_id").agg(F.sum("_t").alias("_s"))
    stream = by_stream.select("video_id", (F.sum("_s").over(W.orderBy("video_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_base"))
    group = totals.select(*GROUP, (F.sum("_t").over(W.partitionBy("video_id").orderBy("gop_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_shift"))
    placed = rows.withColumn("_own", own).join(group, GROUP).join(stream, "video_id")
    return placed.select("record_id", "video_id", "gop_id", "kind", (F.col("_base") + F.col("_shift") + F.col("_own")).alias("new_offset"), F.col("record_length").alias("length"))


def two_level_layout(catalog: DataFrame, page: int = 4) -> DataFrame:
    """Root (group's first), checkpoint (page's first) and own extent of each record; closure counts the distinct ones."""
    group = W.partitionBy(*GROUP).orderBy("packet_index")
    rows = catalog.withColumn("_at", F.row_number().over(group) - 1).withColumn("page", F.floor(F.col("_at") / page).cast("long"))
    paged = W.partitionBy(*GROUP, "page").orderBy("packet_index")
    root, mark = F.first("record_id").over(group), F.first("record_id").over(paged)
    out = rows.select("record_id", "video_id", "gop_id", "page", root.alias("root_id"), mark.alias("checkpoint_id"), F.first("record_offset").over(group).alias("root_offset"), F.first("record_offset").over(paged).alias("checkpoint_offset"), F.col("record_offset").alias("target_offset"))
    return out.withColumn("closure_size", F.size(F.array_distinct(F.array("root_id", "checkpoint_id", "record_id"))).cast("long"))


def materialize_pairs(samples: DataFrame, payloads: DataFrame) -> DataFrame:
    """Anchor and delta bytes of each sample one after the other, in sample order, with running offsets.

    samples: sample_id, anchor_id, delta_id (null: the anchor alone); payloads: record_id, text.
    """
    a = payloads.select(F.col("record_id").alias("anchor_id"), F.col("text").alias("_a"))
    d = payloads.select(F.col("record_id").alias("delta_id"), F.col("text").alias("_d"))
    both = samples.join(a, "anchor_id").join(d, "delta_id", "left").select("sample_id", "video_id", F.concat("_a", F.coalesce("_d", F.lit(""))).alias("data"))
    sized = both.withColumn("length", F.octet_length("data").cast("long"))
    order = W.partitionBy("video_id").orderBy("sample_id").rowsBetween(W.unboundedPreceding, 0)
    return sized.select("sample_id", "video_id", (F.sum("length").over(order) - F.col("length")).alias("offset"), "length", F.sha2("data", 256).alias("sha256"))


def encode_parameters(catalog: DataFrame, least_gop: int = 8) -> DataFrame:
    """Per stream the group length to encode with (at least ``least_gop``) and whether it has P records."""
    sizes = catalog.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("frame_type") == "P").alias("p"))
    return sizes.groupBy("video_id").agg(F.greatest(F.max("n"), F.lit(least_gop).cast("long")).alias("max_gop"), F.max("p").alias("any_anchor_p"))


def frame_count_check(catalog: DataFrame, most: int) -> DataFrame:
    """Per stream packets and frames, and what is wrong with them."""
    n = catalog.groupBy("video_id").agg(F.count(F.lit(1)).alias("packets"), F.countDistinct("frame_idx").alias("frames"))
    reason = F.when(F.col("packets") == 0, "none").when(F.col("packets") != F.col("frames"), "mismatch").when(F.col("frames") > most, "too many").otherwise("ok")
    return n.withColumn("verdict", reason)


#: Limits of build options: b frames and reference frames, and frames of a group around one anchor. Fixed values.
MOST_B, MOST_REFERENCES, MOST_ANCHORED = 16, 16, 17


def option_problem() -> Column:
    """What is wrong with a row of build options, null if nothing.

    Columns: gop_size, max_b_frames, adaptive, lookahead, reference_frames, policy. Settings of b frames are
    only looked at for hierarchical_b; other policies must leave them at their defaults (7, 0, 0, 1).
    """
    c, b = F.col, F.col("policy") == "hierarchical_b"
    default = (c("max_b_frames") == 7) & (c("adaptive") == 0) & (c("lookahead") == 0) & (c("reference_frames") == 1)
    return (
        F.when(c("gop_size") < 2, "group too small")
        .when(b & (c("max_b_frames") > MOST_B), "too many b frames")
        .when(b & (c("max_b_frames") >= c("gop_size")), "b frames fill the group")
        .when(b & (c("adaptive") > 2), "unknown adaptive mode")
        .when(b & (c("adaptive") > 0) & (c("lookahead") < c("max_b_frames") + 1), "lookahead too short")
        .when(b & ((c("reference_frames") < 1) | (c("reference_frames") > MOST_REFERENCES)), "reference frames out of range")
        .when(~b & ~default, "b settings without their policy")
        .when((c("policy") == "shared_anchor") & (c("gop_size") > MOST_ANCHORED), "group exceeds the anchor limit")
    )


def stored(units: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """Units that a storage policy keeps, with their group: key units (type 5) open one, others (type 1) follow.

    units: keys, position, unit_type. ``idr_only`` keeps key units alone; ``full_gop`` and ``anchor_p`` keep both;
    units before the first key unit are group 0.
    """
    if policy not in ("idr_only", "full_gop", "anchor_p"):
        raise ValueError(f"unknown storage policy {policy}")
    o = W.partitionBy(*keys).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    kept = units.filter(F.col("unit_type").isin([5] if policy == "idr_only" else [1, 5]))
    return kept.withColumn("group", F.sum(F.when(F.col("unit_type") == 5, 1).otherwise(0)).over(o))
