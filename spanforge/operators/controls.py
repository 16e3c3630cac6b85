"""Representations of samples: prefix, anchor and delta, pair; their rules, spans and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def representation_violations(rows: DataFrame) -> DataFrame:
    """(sample_id, representation) whose kinds break the grammar.

    Prefix: all prefix. Normalized: an anchor, then at most one delta. Pair: one pair.
    rows: sample_id, representation, kind, position.
    """
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("position", "kind"))), lambda x: x["kind"])
    g = rows.groupBy("sample_id", "representation").agg(kinds.alias("kinds"))
    good = (
        F.when(F.col("representation") == "prefix", (F.size("kinds") > 0) & F.forall("kinds", lambda k: k == "prefix"))
        .when(F.col("representation") == "normalized", (F.array_join("kinds", ",") == "anchor") | (F.array_join("kinds", ",") == "anchor,delta"))
        .otherwise(F.array_join("kinds", ",") == "pair")
    )
    return g.filter(~good).select("sample_id", "representation", F.array_join("kinds", ",").alias("kinds"))


def normalized_spans(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per anchor group the strictly contiguous span up to each member, and whether it is one.

    records: keys, ordinal, offset, length.
    """
    o = W.partitionBy(*keys).orderBy("ordinal")
    before = F.lag(F.col("offset") + F.col("length")).over(o)
    step = F.col("ordinal") - F.lag("ordinal").over(o)
    broken = F.when(before.isNotNull() & ((before != F.col("offset")) | (step != 1)), 1).otherwise(0)
    upto = o.rowsBetween(W.unboundedPreceding, 0)
    r = records.withColumn("_x", broken)
    return r.select(*keys, "ordinal", F.min("offset").over(upto).alias("span_offset"), F.sum("length").over(upto).alias("span_length"), (F.max("_x").over(upto) == 0).alias("contiguous"))


def anchor_metrics(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct anchors and how often one is used again."""
    return mentions.groupBy(*keys).agg(F.countDistinct("anchor_id").alias("unique_anchors"), (F.count("anchor_id") - F.countDistinct("anchor_id")).alias("anchor_reuse_hits"))


def normalized_layout(turns: DataFrame) -> DataFrame:
    """Anchor groups as regions: cover, members, and the id that a synthetic anchor gets (negative, counting down)."""
    g = turns.groupBy("video_id", "gop_id").agg(F.min("record_offset").alias("region_offset"), (F.max(F.col("record_offset") + F.col("record_length")) - F.min("record_offset")).alias("region_length"), F.count(F.lit(1)).alias("members"), F.min("record_id").alias("anchor_record"))
    return g.withColumn("synthetic_id", -1 - F.col("anchor_record"))


def layout_violations(catalog: DataFrame, regions: DataFrame, closure: DataFrame) -> DataFrame:
    """(record_id, reason): records outside their region, of no region, or with a dependency in another one."""
    both = catalog.join(regions, ["video_id", "gop_id"], "left")
    out = both.filter(F.col("region_offset").isNull()).select("record_id", F.lit("no region").alias("reason"))
    off = both.filter((F.col("record_offset") < F.col("region_offset")) | (F.col("record_offset") + F.col("record_length") > F.col("region_offset") + F.col("region_length"))).select("record_id", F.lit("outside region").alias("reason"))
    place = catalog.select("record_id", "video_id", "gop_id")
    t = closure.join(place.withColumnRenamed("record_id", "target_id"), "target_id").join(place.select(F.col("record_id").alias("dep_id"), F.col("video_id").alias("_v"), F.col("gop_id").alias("_g")), "dep_id")
    across = t.filter((F.col("video_id") != F.col("_v")) | (F.col("gop_id") != F.col("_g"))).select(F.col("target_id").alias("record_id"), F.lit("dependency in another region").alias("reason")).distinct()
    return out.unionByName(off).unionByName(across)
