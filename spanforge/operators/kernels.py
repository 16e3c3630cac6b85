"""Grouped decoding with a pluggable kernel.

The shipped kernel digests the bytes of a target's closure in decode order, so wrong
members, a wrong order or gap bytes change its result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


GROUP = ["video_id", "gop_id"]


def jobs(closure: DataFrame, payloads: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a target: its closure's (packet_index, text) in decode order, and its own place among them.

    Closures are sent to their group's texts (they don't leave it), so a text is moved once and not once a closure.
    """
    of = catalog.select("record_id", *GROUP)
    texts = of.join(payloads, "record_id").groupBy(*GROUP).agg(F.collect_list(F.struct("record_id", "text")).alias("_texts"), F.collect_set("record_id").alias("_ids"))
    edges = closure.select("target_id", "dep_id", "packet_index").join(of.withColumnRenamed("record_id", "target_id"), "target_id")
    deps = edges.groupBy("target_id", *GROUP).agg(F.array_sort(F.collect_list(F.struct("packet_index", "dep_id"))).alias("_deps"))
    text = lambda d: F.get(F.filter("_texts", lambda x: x["record_id"] == d["dep_id"]), F.lit(0))["text"]
    astray = F.exists("_deps", lambda d: ~F.array_contains("_ids", d["dep_id"]))
    parts = F.transform("_deps", lambda d: F.struct(d["packet_index"].alias("packet_index"), d["dep_id"].alias("dep_id"), text(d).alias("text")))
    own = F.array_position(F.transform("_deps", lambda x: x["dep_id"]), F.col("target_id")) - 1
    whole = F.when(astray, F.raise_error(F.lit("a closure's text isn't in its group"))).otherwise(parts)
    return deps.join(texts, GROUP).select("target_id", whole.alias("parts"), own.cast("int").alias("ordinal"), *GROUP)


def digest(job_rows: DataFrame) -> DataFrame:
    """The digest kernel, as columns."""
    data = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    return job_rows.select("target_id", F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("width"), F.size("parts").alias("units"))


def run(job_rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A kernel of one's own over each group: a frame of jobs in, rows of ``schema`` out."""
    return job_rows.groupBy("video_id", "gop_id").applyInPandas(kernel, schema)


#: Stages of decoding, in order. Fixed values.
STAGES = ("decoder_setup", "packet_copy", "send", "receive", "flush", "rgb_convert", "rgb_copy")


def profile(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of every stage, of those without a call too. A call without a thread clock (null) counts as a call, not as a sample.

    calls: keys, stage, wall_ns, thread_cpu_ns, bytes.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    every = calls.select(*keys).distinct().withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
    idle = every.select(*keys, "stage", *(F.lit(None).cast("long").alias(c) for c in ("wall_ns", "thread_cpu_ns", "bytes")))
    both = calls.select(*keys, "stage", "wall_ns", "thread_cpu_ns", "bytes").unionByName(idle)
    return both.groupBy(*keys, "stage").agg(total("wall_ns"), total("thread_cpu_ns"), F.count("wall_ns").alias("calls"), F.count("thread_cpu_ns").alias("cpu_samples"), total("bytes"))
