"""Running a chosen plan: fetch spans, cut records out of them, decode, put results back in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ["video_id", "gop_id"]


def _glue(pieces: Column) -> Column:
    """An array of binaries end to end, in one pass (a string here is its bytes, whatever they are)."""
    return F.array_join(F.transform(pieces, lambda x: x.cast("string")), "").cast("binary")


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once (the planner may write a column out wherever it is used, in loops too)."""
    return F.transform(F.array(value), body)[0]


def groups(catalog: DataFrame, closure: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row a group: video_id, gop_id, base, image (its bytes from its first record's to its last's), bytes (their number), closures (target_id, deps in decode order).

    What no record holds is zeros. Closures must stay in their group, as the format has it; one that doesn't is an error.
    """
    place = catalog.select("record_id", *GROUP, F.col("record_offset").alias("offset"), F.col("record_length").alias("length"))
    stored = place.join(payloads.select("record_id", F.col("data").cast("binary").alias("data")), "record_id")
    parts = F.array_sort(F.collect_list(F.struct("offset", "record_id", "data")))
    g = stored.groupBy(*GROUP).agg(F.min("offset").alias("base"), F.filter(parts, lambda x: x["offset"].isNotNull() & x["data"].isNotNull()).alias("parts"))

    def filled(x: Column, i: Column) -> Column:
        """A record after the bytes that no record holds, as zeros."""
        before = F.get(F.col("parts"), i - 1)
        since = F.coalesce(before["offset"] + F.octet_length(before["data"]), F.col("base"))
        return F.concat(F.repeat(F.lit("\0"), (x["offset"] - since).cast("int")).cast("binary"), x["data"])

    images = g.select(*GROUP, "base", _glue(F.transform("parts", filled)).alias("image"))
    of = catalog.select(F.col("record_id").alias("target_id"), *GROUP)
    deps = closure.select("target_id", "dep_id", "packet_index").join(of, "target_id").groupBy(*GROUP, "target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("packet_index", "dep_id"))), lambda x: x["dep_id"]).alias("deps"))
    ids = catalog.groupBy(*GROUP).agg(F.collect_list("record_id").alias("_ids"))
    every = deps.groupBy(*GROUP).agg(F.collect_list(F.struct("target_id", "deps")).alias("closures")).join(ids, GROUP)
    astray = F.exists("closures", lambda c: F.exists(c["deps"], lambda d: ~F.array_contains(F.col("_ids"), d)))
    images = images.withColumn("bytes", F.octet_length("image"))
    return images.join(every.select(*GROUP, F.when(astray, F.raise_error(F.lit("a closure leaves its group"))).otherwise(F.col("closures")).alias("closures")), GROUP)


def serve(targets: DataFrame, fetches: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Every request's result: keys, batch_id, pos, sample_id, record_id, digest, width.

    targets: keys, batch_id, pos, sample_id, record_id, video_id, gop_id; fetches: keys, record_id, offset, length,
    video_id, gop_id and the span (span_offset, span_length) each record is fetched in; store: ``groups``. A window's
    requests and fetches go to where the bytes of their group are, so bytes are moved once, however many windows
    need them. There each window reads its spans' part in the group, cuts its records out of them and decodes its distinct targets.
    """
    ask, got = F.struct("batch_id", "pos", "sample_id", "record_id"), F.struct("record_id", "offset", "length", "span_offset", "span_length")
    asked = targets.select(*keys, *GROUP, ask.alias("ask"))
    rows = asked.unionByName(fetches.select(*keys, *GROUP, got.alias("got")), allowMissingColumns=True).repartition(*GROUP)
    windows = rows.groupBy(*keys, *GROUP).agg(F.collect_list("ask").alias("asks"), F.collect_list("got").alias("gots"))
    both = windows.filter(F.size("asks") > 0).join(store, GROUP)
    base, stop = F.col("base"), F.col("base") + F.col("bytes")

    def read(g: Column, image: Column) -> Column:
        """The part of a span that lies in the group."""
        begin, end = F.greatest(g["span_offset"], base), F.least(g["span_offset"] + g["span_length"], stop)
        return F.struct(g["span_offset"].alias("offset"), g["span_length"].alias("length"), begin.alias("at"), F.substring(image, (begin - base + 1).cast("int"), (end - begin).cast("int")).alias("bytes"))

    def cut(g: Column, spans: Column) -> Column:
        span = F.get(F.filter(spans, lambda s: (s["offset"] == g["span_offset"]) & (s["length"] == g["span_length"])), F.lit(0))
        data = _let(span, lambda s: F.substring(s["bytes"], (g["offset"] - s["at"] + 1).cast("int"), g["length"].cast("int")))
        return F.struct(g["record_id"].alias("record_id"), data.alias("data"))

    def decoded(c: Column, records: Column) -> Column:
        parts = F.transform(c["deps"], lambda d: F.get(F.filter(records, lambda r: r["record_id"] == d), F.lit(0))["data"])
        whole = _let(parts, lambda x: F.when(F.exists(x, lambda b: b.isNotNull()), _glue(x)))
        return _let(whole, lambda x: F.struct(c["target_id"].alias("record_id"), F.sha2(x, 256).alias("digest"), F.octet_length(x).cast("long").alias("width")))

    ranges = F.array_distinct(F.transform("gots", lambda g: F.struct(g["span_offset"].alias("span_offset"), g["span_length"].alias("span_length"))))
    spans = _let(F.col("image"), lambda image: F.transform(ranges, lambda g: read(g, image)))
    wanted = F.filter("closures", lambda c: F.exists("asks", lambda a: a["record_id"] == c["target_id"]))
    done = _let(spans, lambda s: _let(F.transform("gots", lambda g: cut(g, s)), lambda r: F.transform(wanted, lambda c: decoded(c, r))))
    result = lambda d: F.transform("asks", lambda a: F.struct(*(a[c].alias(c) for c in ("batch_id", "pos", "sample_id", "record_id")), F.get(F.filter(d, lambda x: x["record_id"] == a["record_id"]), F.lit(0)).alias("x")))
    out = both.select(*keys, F.explode(_let(done, result)).alias("r")).filter("r.x is not null")
    return out.select(*keys, "r.batch_id", "r.pos", "r.sample_id", "r.record_id", "r.x.digest", "r.x.width")
