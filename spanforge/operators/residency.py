"""What to keep between batches: liveness, reuse, admission, victims, read-ahead, caches."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["video_id", "gop_id"]


def liveness(targets: DataFrame, closure: DataFrame, keys: list[str]) -> DataFrame:
    """Per batch and dependency, how many distinct targets other than itself need it."""
    asked = targets.select(*keys, "batch_id", F.col("record_id").alias("target_id")).distinct()
    edges = asked.join(closure.select("target_id", "dep_id"), "target_id").filter(F.col("dep_id") != F.col("target_id"))
    return edges.groupBy(*keys, "batch_id", "dep_id").agg(F.count(F.lit(1)).alias("consumers"))


def visible_reuses(live: DataFrame, keys: list[str]) -> DataFrame:
    """Consumers after the one that pays: others of this batch and all of later ones, for batches that have some."""
    later = F.sum("consumers").over(W.partitionBy(*keys, "dep_id").orderBy("batch_id").rowsBetween(1, W.unboundedFollowing))
    return live.withColumn("reuses", F.col("consumers") - 1 + F.coalesce(later, F.lit(0)))


def monotonic(targets: DataFrame, catalog_ordinals: DataFrame, keys: list[str]) -> DataFrame:
    """Per batch and group what a forward-only decoder could serve.

    reuses: distinct ordinals now less one, plus distinct later ones above the current
    maximum; next_use: the first later batch with such a one.
    """
    per = targets.join(catalog_ordinals, "record_id").select(*keys, *GROUP, "batch_id", "ordinal").distinct()
    now = per.groupBy(*keys, *GROUP, "batch_id").agg(F.count(F.lit(1)).alias("_n"), F.max("ordinal").alias("_m"))
    later = per.select(*keys, *GROUP, F.col("batch_id").alias("_b"), F.col("ordinal").alias("_o"))
    ahead = now.join(later, [*keys, *GROUP]).filter((F.col("_b") > F.col("batch_id")) & (F.col("_o") > F.col("_m")))
    future = ahead.groupBy(*keys, *GROUP, "batch_id").agg(F.countDistinct("_o").alias("_f"), F.min("_b").alias("next_use"))
    out = now.join(future, [*keys, *GROUP, "batch_id"], "left")
    return out.select(*keys, *GROUP, "batch_id", F.col("_m").alias("max_ordinal"), (F.col("_n") - 1 + F.coalesce("_f", F.lit(0))).alias("reuses"), "next_use")


def candidates(mono: DataFrame, reuse: DataFrame, closure: DataFrame, targets: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Visible and potential consumers and next use of each batch and group.

    Without any reuse of the group's dependencies nothing is visible; potential ones
    are the group's records behind the furthest requested frame.
    """
    key = [*keys, *GROUP, "batch_id"]
    asked = targets.select(*key, F.col("record_id").alias("target_id"), "frame_idx").distinct()
    deps = asked.join(closure.select("target_id", "dep_id"), "target_id").select(*key, "dep_id").distinct()
    shared = deps.join(reuse.select(*keys, "batch_id", "dep_id", "reuses"), [*keys, "batch_id", "dep_id"], "left").groupBy(*key).agg(F.coalesce(F.sum("reuses"), F.lit(0)).alias("_r"))
    furthest = asked.groupBy(*key).agg(F.max("frame_idx").alias("_f"))
    behind = furthest.join(catalog.select(*GROUP, F.col("frame_idx").alias("_c")), GROUP).groupBy(*key).agg(F.count_if(F.col("_c") > F.col("_f")).alias("potential_consumers"))
    live = F.col("_r") > 0
    return mono.join(shared, key).join(behind, key).select(*key, F.when(live, F.col("reuses")).otherwise(0).alias("visible_consumers"), "potential_consumers", F.when(live, F.col("next_use")).alias("next_use"))


def admitted(c: DataFrame) -> DataFrame:
    return c.withColumn("admit", ((F.col("visible_consumers") > 0) & F.col("next_use").isNotNull()) | (F.col("potential_consumers") > 0))


def victim(states: DataFrame, keys: list[str]) -> DataFrame:
    """The state to evict: the oldest that isn't pinned, else the pinned one used furthest ahead (never: furthest; equal: the youngest).

    states: keys, state, age_rank (0: least recently used), pinned, next_use.
    """
    free = F.when(F.col("pinned"), 1).otherwise(0)
    far = F.when(F.col("pinned"), F.coalesce(F.col("next_use"), F.lit((1 << 62))))
    order = W.partitionBy(*keys).orderBy(free, F.when(F.col("pinned"), F.lit(0)).otherwise(F.col("age_rank")), F.desc(far), F.desc("age_rank"))
    return states.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def allowance(hit: Column, whole: Column, held: Column, cache_bytes: int, most: int) -> Column:
    """Bytes that may be read ahead in a group: what the cache has left, at most ``most``, if the group was hit or fits as a whole; else none."""
    left = F.least(F.greatest(F.lit(cache_bytes) - held, F.lit(0)), F.lit(most))
    return F.when(hit | (whole <= cache_bytes), left).otherwise(F.lit(0)).cast("long")


def read_ahead(suffix: DataFrame, keys: list[str], allowance: int | Column) -> DataFrame:
    """Records in decode order until the first that doesn't fit the allowance (nothing after it).

    suffix: keys, ordinal, length. The sum so far grows with every record, so the first overflow is where it passes.
    """
    total = F.sum("length").over(W.partitionBy(*keys).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    return suffix.withColumn("_t", total).filter(F.col("_t") <= allowance).drop("_t")


def lru_trace(accesses: DataFrame, capacity: int) -> DataFrame:
    """Hit, evictions and bytes held after each access of a lane, in order; what exceeds the capacity isn't stored.

    accesses: lane, seq, record_id, length. Each lane's cache is a state machine of its own.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict[int, int] = OrderedDict()
        used, out = 0, []
        for lane, seq, record, size in rows.sort_values("seq")[["lane", "seq", "record_id", "length"]].itertuples(index=False):
            hit, gone = record in held, 0
            if hit:
                held.move_to_end(record)
            elif 0 < size <= capacity:
                while used + size > capacity:
                    used -= held.popitem(last=False)[1]
                    gone += 1
                held[record] = size
                used += size
            out.append((lane, seq, record, hit, gone, used))
        return pd.DataFrame(out, columns=["lane", "seq", "record_id", "hit", "evicted", "resident_bytes"])

    return accesses.groupBy("lane").applyInPandas(run, "lane long, seq long, record_id long, hit boolean, evicted int, resident_bytes long")
