"""Catalogs of records in display, decode and byte order.

``from_texts`` derives a catalog from a table of texts: a stream is a group, a
frame a text, a group of pictures 16 frames.  Its first frame is I; every fourth
and the last are P; the rest B.  Decode order puts a B's right reference before
it and the middle B of an interval first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import with_index, with_running_sum


def from_texts(texts: DataFrame, stream: str, order: str, payload: str, label: str, gop: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """A catalog over ``texts``; ``keep`` carries further columns along.

    Ranks and offsets are global indexes over range partitions, so a stream that
    holds a third of all rows doesn't land in one task.
    """
    base = texts.select(F.col(stream).alias("video_id"), F.col(order).alias("_order"), F.col(label).alias("class_name"), F.octet_length(F.col(payload)).cast("long").alias("record_length"), *keep)
    shown = with_index(base, ["video_id", "_order"], "_shown")
    sizes = shown.groupBy("video_id").agg(F.count(F.lit(1)).alias("_frames"), F.min("_shown").alias("_first"))
    f = shown.join(sizes, "video_id").withColumn("frame_idx", (F.col("_shown") - F.col("_first")).cast("int"))
    f = f.withColumn("gop_id", F.floor(F.col("frame_idx") / gop).cast("long")).withColumn("k", F.col("frame_idx") % gop)
    f = f.withColumn("k_last", F.least(F.lit(gop - 1).cast("long"), F.col("_frames") - 1 - F.col("gop_id") * gop))
    anchor = (F.col("k") % 4 == 0) | (F.col("k") == F.col("k_last"))
    f = f.withColumn("frame_type", F.when(F.col("k") == 0, "I").when(anchor, "P").otherwise("B"))
    right = F.when(F.col("k") == 0, F.lit(0)).when(anchor, F.col("k")).otherwise(F.least(F.floor(F.col("k") / 4) * 4 + 4, F.col("k_last")))
    f = f.withColumn("right_ref", right.cast("long"))
    f = f.withColumn("_rank", F.when(F.col("frame_type") == "B", F.when(F.col("k") % 4 == 2, 1).otherwise(2)).otherwise(0))
    decode = ["video_id", "gop_id", "right_ref", "_rank", "k"]
    p = with_index(f, decode, "record_id")
    p = p.withColumn("packet_index", (F.col("record_id") - F.col("_first")).cast("int"))
    p = with_running_sum(p, ["record_id"], "record_length", "record_offset")
    return p.select("record_id", "video_id", "class_name", "frame_idx", "gop_id", "packet_index", "frame_type", "record_offset", "record_length", "k", "k_last", "right_ref", *keep)


def chained(turns: DataFrame, stream: str, position: str, payload: str) -> DataFrame:
    """A catalog of short streams: the first record I, all others P, one group a stream."""
    base = turns.select(F.col(stream).cast("long").alias("video_id"), F.col(position).cast("int").alias("frame_idx"), F.octet_length(F.col(payload)).cast("long").alias("record_length"))
    first = F.row_number().over(W.partitionBy("video_id").orderBy("frame_idx")) == 1
    out = with_index(base.withColumn("frame_type", F.when(first, "I").otherwise("P")), ["video_id", "frame_idx"], "record_id")
    out = with_running_sum(out, ["record_id"], "record_length", "record_offset")
    return out.select("record_id", "video_id", "frame_idx", F.lit(0).cast("long").alias("gop_id"), F.col("frame_idx").alias("packet_index"), "frame_type", "record_offset", "record_length")
