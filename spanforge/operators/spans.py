"""Interval algebra over byte extents (record_id, offset, length).

Windows are partitioned by the caller's keys (planning window, object, stream);
nothing is sorted globally.  A gap of ``None`` never merges, not even extents that
overlap; zero merges those that touch or overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def end() -> Column:
    return F.col("offset") + F.col("length")


def _by(keys: list[str], *order: str):
    return W.partitionBy(*keys).orderBy(*order)


def numbered(extents: DataFrame, keys: list[str], gap: int | None | Column) -> DataFrame:
    """``extents`` with ``span``: the number (from 0) of the merged span each belongs to."""
    order = _by(keys, "offset", "record_id")
    if gap is None:
        return extents.withColumn("span", F.row_number().over(order) - 1)
    reach = F.max(end()).over(order.rowsBetween(W.unboundedPreceding, -1))
    limit = gap if isinstance(gap, Column) else F.lit(gap)
    opens = F.when(reach.isNull() | (F.col("offset") > reach + limit), 1).otherwise(0)
    return extents.withColumn("_opens", opens).withColumn("span", (F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("_opens")


def merged(extents: DataFrame, keys: list[str], gap: int | None) -> DataFrame:
    """One row a span: keys, span, span_offset, span_length, records."""
    return _spans(numbered(extents, keys, gap), keys)


def _spans(n: DataFrame, keys: list[str]) -> DataFrame:
    return n.groupBy(*keys, "span").agg(F.min("offset").alias("span_offset"), (F.max(end()) - F.min("offset")).alias("span_length"), F.count(F.lit(1)).alias("records"))


def numbered_capped(extents: DataFrame, keys: list[str], gap: int, cap: int) -> DataFrame:
    """As ``numbered``, but a span may not outgrow ``cap`` bytes; one record above it stands alone.

    Whether a record joins depends on all choices before it, so this is a fold over
    each group's ordered extents; the fold keeps only the open span and one number a record.
    """
    items = F.array_sort(F.collect_list(F.struct("offset", "record_id", "length")))
    zero = F.struct(
        F.array().cast("array<int>").alias("at"), F.lit(-1).alias("span"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("reach")
    )

    def step(x: Column, e: Column) -> Column:
        end = e["offset"] + e["length"]
        joins = (x["span"] >= 0) & (e["offset"] <= x["reach"] + gap) & (F.greatest(x["reach"], end) - x["start"] <= cap)
        number = F.when(joins, x["span"]).otherwise(x["span"] + 1)
        return F.struct(
            F.concat(x["at"], F.array(number)).alias("at"),
            number.alias("span"),
            F.when(joins, x["start"]).otherwise(e["offset"]).alias("start"),
            F.when(joins, F.greatest(x["reach"], end)).otherwise(end).alias("reach"),
        )

    folded = extents.groupBy(*keys).agg(items.alias("items")).withColumn("at", F.aggregate("items", zero, step, lambda x: x["at"]))
    each = folded.select(*keys, F.explode(F.arrays_zip("items", "at")).alias("x"))
    return each.select(*keys, "x.items.record_id", "x.items.offset", "x.items.length", F.col("x.at").alias("span"))


def merged_capped(extents: DataFrame, keys: list[str], gap: int, cap: int) -> DataFrame:
    return _spans(numbered_capped(extents, keys, gap, cap), keys)


def members(n: DataFrame, keys: list[str]) -> DataFrame:
    """Where each record lies in its span."""
    first = F.min("offset").over(W.partitionBy(*keys, "span"))
    return n.withColumn("relative_offset", F.col("offset") - first)


def covered_bytes(extents: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of the union of extents."""
    return islands(reached(extents, keys), keys).select(*keys, F.col("island_bytes").alias("covered_bytes"))


def violations(extents: DataFrame, keys: list[str], empty: bool = False) -> DataFrame:
    """Empty (unless ``empty`` allows it), overflowing or conflicting extents: keys, record_id, reason."""
    bad = extents.select(
        *keys,
        "record_id",
        F.when(F.col("length") < 0 if empty else F.col("length") <= 0, "empty").when(F.try_add("offset", "length").isNull(), "overflow").alias("reason"),
    ).filter("reason is not null")
    twice = extents.groupBy(*keys, "record_id").agg(F.countDistinct("offset", "length").alias("n")).filter("n > 1").select(*keys, "record_id", F.lit("conflict").alias("reason"))
    return bad.unionByName(twice)


def reached(extents: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``reach``: how far the extents before reach. One sort serves islands, gaps and covered bytes."""
    order = _by(keys, "offset", "record_id")
    return extents.withColumn("reach", F.max(end()).over(order.rowsBetween(W.unboundedPreceding, -1)))


def islands(marked: DataFrame, keys: list[str]) -> DataFrame:
    """From ``reached``: islands at gap zero and their bytes, records and the sum of their lengths."""
    opens = F.col("reach").isNull() | (F.col("offset") > F.col("reach"))
    fresh = F.greatest(F.lit(0).cast("long"), end() - F.greatest(F.col("offset"), F.coalesce("reach", "offset")))
    return marked.groupBy(*keys).agg(F.count_if(opens).alias("islands"), F.sum(fresh).alias("island_bytes"), F.count(F.lit(1)).alias("records"), F.sum("length").alias("record_bytes"))


def gaps(marked: DataFrame, keys: list[str], max_gap: int | None = None) -> DataFrame:
    """From ``reached``: positive gaps up to ``max_gap``, with their number, sum and places, by size."""
    gap = F.col("offset") - F.col("reach")
    found = marked.withColumn("gap", gap).filter(F.col("gap") > 0)
    return found.filter(F.col("gap") <= max_gap) if max_gap is not None else found


def threshold_candidates(extents: DataFrame, keys: list[str], max_gap: int | None) -> DataFrame:
    """Ranges and bytes of the plan for each useful threshold: never merge (null), 0, and every gap up to ``max_gap``.

    Raising the threshold past a gap merges exactly what it parts, so ranges and
    bytes are running sums over the distinct gaps: one pass instead of a plan per threshold.
    """
    marked = reached(extents, keys)
    base = islands(marked, keys)
    each = gaps(marked, keys, max_gap).groupBy(*keys, F.col("gap").alias("threshold")).agg(F.count(F.lit(1)).alias("_c"), F.sum("gap").alias("_g"))
    running = _by(keys, "threshold").rowsBetween(W.unboundedPreceding, 0)
    merged_ = each.join(base, keys).select(*keys, "threshold", (F.col("islands") - F.sum("_c").over(running)).alias("ranges"), (F.col("island_bytes") + F.sum("_g").over(running)).alias("bytes"))
    # never merging and merging at zero come from the same row
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    shapes = F.array(
        F.struct(none.alias("threshold"), F.col("records").alias("ranges"), F.col("record_bytes").alias("bytes")),
        F.struct(zero.alias("threshold"), F.col("islands").alias("ranges"), F.col("island_bytes").alias("bytes")),
    )
    ends = base.select(*keys, F.explode(shapes).alias("x")).select(*keys, "x.threshold", "x.ranges", "x.bytes")
    return ends.unionByName(merged_)


def fixed_gap(extents: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Ranges and bytes of the plan that merges up to ``gap``."""
    marked = reached(extents, keys)
    close = gaps(marked, keys, gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.sum("gap").alias("_g"))
    joined = islands(marked, keys).join(close, keys, "left")
    return joined.select(*keys, (F.col("islands") - F.coalesce("_c", F.lit(0))).alias("ranges"), (F.col("island_bytes") + F.coalesce("_g", F.lit(0))).alias("bytes"))


def cut_frontier(extents: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """Ranges and bytes when the k largest gaps are cut, for every k; gaps above ``max_gap`` are always cut."""
    start = fixed_gap(extents, keys, max_gap)
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("gap"), "offset", "record_id"))
    upto = W.partitionBy(*keys).orderBy(F.desc("gap"), "offset", "record_id").rowsBetween(W.unboundedPreceding, 0)
    found = gaps(reached(extents, keys), keys, max_gap).withColumn("cuts", at).withColumn("_g", F.sum("gap").over(upto))
    each = found.join(start, keys).select(*keys, "cuts", (F.col("ranges") + F.col("cuts")).alias("ranges"), (F.col("bytes") - F.col("_g")).alias("bytes"))
    return start.select(*keys, F.lit(0).alias("cuts"), "ranges", "bytes").unionByName(each)


def overlaps(ranges: DataFrame, records: DataFrame, keys: list[str], bucket: int = 1 << 16) -> DataFrame:
    """Pairs of a range (span, span_offset, span_length) and a record that share a byte.

    Both sides are cut into buckets of the address space and joined on them, so this
    is an equi-join; a pair is kept in the bucket where its common part begins.
    """
    cells = lambda off, size: F.explode(F.sequence(F.floor(off / bucket), F.floor((off + size - 1) / bucket)))
    left = ranges.withColumn("_cell", cells(F.col("span_offset"), F.col("span_length")))
    right = records.withColumn("_cell", cells(F.col("offset"), F.col("length")))
    both = left.join(right, [*keys, "_cell"])
    begins = F.greatest("span_offset", "offset")
    meet = (F.col("offset") < F.col("span_offset") + F.col("span_length")) & (F.col("span_offset") < end())
    return both.filter(meet & (F.floor(begins / bucket) == F.col("_cell"))).drop("_cell")


def bound(records: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``records`` with the range (span_offset, span_length; null if none) that holds each whole, borders included.

    Ranges of a key don't touch, so the last that begins no later than a record is the only one that may hold it:
    one sort, and a record without bytes is held where it lies, at a border too.
    """
    own = records.columns
    given = ranges.select(*keys, F.col("span_offset").alias("offset"), F.struct("span_offset", "span_length").alias("_g"))
    both = given.unionByName(records, allowMissingColumns=True)
    last = F.last("_g", ignorenulls=True).over(W.partitionBy(*keys).orderBy("offset", F.col("_g").isNull()).rowsBetween(W.unboundedPreceding, 0))
    held = end() <= F.col("_l.span_offset") + F.col("_l.span_length")
    out = both.withColumn("_l", last).filter("_g is null")
    return out.select(*own, *(F.when(held, F.col(f"_l.{c}")).alias(c) for c in ("span_offset", "span_length")))


def geometry(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Mean (whole) and largest range, address span, and pairs that touch exactly."""
    reach = F.lag(F.col("span_offset") + F.col("span_length")).over(_by(keys, "span_offset", "span"))
    touch = spans.withColumn("_touch", F.when(reach == F.col("span_offset"), 1).otherwise(0))
    return touch.groupBy(*keys).agg(
        F.floor(F.sum("span_length") / F.count(F.lit(1))).cast("long").alias("mean_range_bytes"),
        F.max("span_length").alias("max_range_bytes"),
        (F.max(F.col("span_offset") + F.col("span_length")) - F.min("span_offset")).alias("address_span_bytes"),
        F.sum("_touch").cast("long").alias("contiguous_range_pairs"),
    )


def histogram(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges by size: up to 4, 16, 64, 256 KiB, and above."""
    size, edges = F.col("span_length"), [4096, 16384, 65536, 262144]
    low = [None, *edges]
    parts = [F.count_if((size <= hi if lo is None else (size > lo) & (size <= hi))).alias(f"le_{hi // 1024}k") for lo, hi in zip(low, edges, strict=False)]
    return spans.groupBy(*keys).agg(*parts, F.count_if(size > edges[-1]).alias("above"))


def peak(events: DataFrame, keys: list[str], start: str, end: str, weight: Column | None = None, name: str = "peak") -> DataFrame:
    """Largest total weight of intervals open at once; an end comes before a start at the same time."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    ends = events.select(*keys, F.col(start).alias("_t"), w.alias("_d")).unionByName(events.select(*keys, F.col(end).alias("_t"), (-w).alias("_d")))
    moments = ends.groupBy(*keys, "_t", (F.col("_d") > 0).alias("_opens")).agg(F.sum("_d").alias("_d"))
    running = F.sum("_d").over(W.partitionBy(*keys).orderBy("_t", "_opens").rowsBetween(W.unboundedPreceding, 0))
    return moments.withColumn("_sum", running).groupBy(*keys).agg(F.greatest(F.max("_sum"), F.lit(0).cast("long")).alias(name))


def density(part: Column, size: Column) -> Column:
    """``part / size`` as text that sorts like it, exactly: the whole quotient and 27 digits of the fraction.

    Sizes are below 2**33, so steps stay in 64 bits, and fractions that differ do so before the 27th digit. Of no bytes
    it is above all others.
    """
    size = F.when(size != 0, size)
    whole = lambda a, b: F.call_function("div", a, b)
    rest, out = part.cast("long") % size, [F.lpad(whole(part.cast("long"), size).cast("string"), 19, "0")]
    for _ in range(3):
        scaled = rest * F.lit(10**9)
        out.append(F.lpad(whole(scaled, size).cast("string"), 9, "0"))
        rest = scaled % size
    return F.coalesce(F.concat(*out), F.lit("~"))
