"""Candidate plans, their costs, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import FIXED_GAP, CostModel
from . import spans


def priced(candidates: DataFrame, model: CostModel) -> DataFrame:
    """Adds io_ns, decode_ns and total_ns to rows with ranges, bytes and units."""
    return candidates.withColumn("io_ns", model.io(F.col("ranges"), F.col("bytes"))).withColumn("decode_ns", model.decode(F.col("units"))).withColumn("total_ns", model.total(F.col("io_ns"), F.col("decode_ns")))


def fixed_reference(extents: DataFrame, keys: list[str], max_gap: int | None) -> DataFrame:
    """Ranges and bytes of the plan with the fixed gap."""
    gap = FIXED_GAP if max_gap is None else min(FIXED_GAP, max_gap)
    return spans.fixed_gap(extents, keys, gap)


def candidates(needed: DataFrame, fetch: DataFrame, regions: DataFrame | None, keys: list[str], model: CostModel, max_gap: int | None = FIXED_GAP, region_units: str = "all") -> DataFrame:
    """All priced plans of each window: kind 'sparse' (with threshold), 'fixed' and 'region'.

    needed: distinct records with extents; fetch: those of them that aren't resident;
    regions: video_id, gop_id, region_offset, region_length, records. A window whose
    records are all resident has one sparse plan without ranges and no fixed one.
    """
    units = needed.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"))
    useful = spans.covered_bytes(fetch, keys).withColumnRenamed("covered_bytes", "useful_bytes")
    base = units.join(useful, keys, "left").withColumn("useful_bytes", F.coalesce("useful_bytes", F.lit(0).cast("long")))
    sparse = spans.threshold_candidates(fetch, keys, max_gap).withColumn("kind", F.lit("sparse"))
    fixed = fixed_reference(fetch, keys, max_gap).withColumn("kind", F.lit("fixed")).withColumn("threshold", F.lit(min(FIXED_GAP, max_gap) if max_gap is not None else FIXED_GAP).cast("long"))
    plans = sparse.unionByName(fixed)
    idle = needed.select(*keys).distinct().join(fetch.select(*keys).distinct(), keys, "left_anti")
    plans = plans.unionByName(idle.select(*keys, F.lit("sparse").alias("kind"), F.lit(None).cast("long").alias("threshold"), F.lit(0).cast("long").alias("ranges"), F.lit(0).cast("long").alias("bytes")))
    out = plans.join(base, keys)
    if regions is not None:
        touched = needed.select(*keys, "video_id", "gop_id").distinct().join(regions, ["video_id", "gop_id"])
        whole = touched.groupBy(*keys).agg(F.count(F.lit(1)).alias("ranges"), F.sum("region_length").alias("bytes"), F.sum("records").alias("_all"))
        # residency isn't subtracted from a region; units and useful bytes follow the mode
        cover = spans.covered_bytes(needed, keys).withColumnRenamed("covered_bytes", "_cover")
        r = whole.join(units, keys).join(cover, keys)
        r = r.select(
            *keys, F.lit("region").alias("kind"), F.lit(None).cast("long").alias("threshold"), "ranges", "bytes",
            (F.col("_all") if region_units == "all" else F.col("units")).alias("units"),
            (F.col("bytes") if region_units == "all" else F.col("_cover")).alias("useful_bytes"),
        )
        out = out.unionByName(r)
    return priced(out, model)


def choose(plans: DataFrame, keys: list[str], model: CostModel) -> DataFrame:
    """One plan a window: within tolerance of the cheapest and no dearer than the fixed one; of these the fewest bytes."""
    w = W.partitionBy(*keys)
    rated = plans.withColumn("min_total_ns", F.min("total_ns").over(w)).withColumn("fixed_total_ns", F.min(F.when(F.col("kind") == "fixed", F.col("total_ns"))).over(w))
    fits = (F.col("total_ns") <= F.col("min_total_ns") + F.lit(model.tolerance_ns)) & (F.col("fixed_total_ns").isNull() | (F.col("total_ns") <= F.col("fixed_total_ns")))
    order = W.partitionBy(*keys).orderBy("bytes", "units", "ranges", "total_ns", F.col("kind").desc(), F.col("threshold").asc_nulls_first())
    return rated.filter(fits & (F.col("kind") != "fixed")).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def parallel_window(jobs: DataFrame, keys: list[str], slots: int, model: CostModel) -> DataFrame:
    """Decode time of a window whose jobs (units) run in waves of ``slots``, longest first: the waves' maxima summed."""
    cost = jobs.withColumn("_c", model.decode(F.col("units")))
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_c"))) - 1
    waves = cost.withColumn("_w", F.floor(at / slots)).groupBy(*keys, "_w").agg(F.max("_c").alias("_m"))
    return waves.groupBy(*keys).agg(F.sum("_m").alias("decode_ns"))


def frontier_choice(frontier: DataFrame, fixed: DataFrame, units: DataFrame, keys: list[str], model: CostModel) -> DataFrame:
    """The same choice on the largest-gap-cut frontier, with the fixed plan's cost beside it."""
    f = priced(fixed.join(units, keys), model).select(*keys, F.col("total_ns").alias("fixed_total_ns"))
    p = priced(frontier.join(units, keys), model).join(f, keys).withColumn("_min", F.min("total_ns").over(W.partitionBy(*keys)))
    fits = (F.col("total_ns") <= F.col("_min") + F.lit(model.tolerance_ns)) & (F.col("total_ns") <= F.col("fixed_total_ns"))
    order = W.partitionBy(*keys).orderBy("bytes", "ranges", "total_ns", "cuts")
    return p.filter(fits).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_min")


def horizons(needed: DataFrame, first: DataFrame, regions: DataFrame | None, key: str, throughput: CostModel, latency: CostModel) -> DataFrame:
    """The plan chosen for each horizon of each window, and when the first batch could be handed out under it.

    needed: ``key`` (one a window and horizon) and distinct records with extents; first: key, record_id of what
    the first batch needs. Plans are priced with ``throughput``; the first batch waits for those of the chosen
    ranges that hold a record it needs, priced with ``latency``. Adds first_batch_ns.
    """
    keys = [key]
    best = choose(candidates(needed, needed, regions, keys, throughput), keys, throughput).select(key, "kind", "threshold", "ranges", "bytes", "units", "total_ns")
    m = needed.join(best, key).join(first.withColumn("_f", F.lit(1)), [key, "record_id"], "left")
    m = m.join(regions.select("video_id", "gop_id", "region_length"), ["video_id", "gop_id"], "left") if regions is not None else m.withColumn("region_length", F.lit(None).cast("long"))
    region = F.col("kind") == "region"
    n = spans.numbered(m, keys, F.coalesce("threshold", F.lit(-(1 << 62))))  # a null threshold never merges
    of = [F.when(region, F.col("video_id")).alias("_v"), F.when(region, F.col("gop_id")).alias("_g"), F.when(~region, F.col("span")).alias("_s")]
    # the chosen plan's own columns come along, so that it is worked out once
    kept = ["kind", "threshold", "ranges", "bytes", "units", "total_ns"]
    size = F.when(F.first("kind") == "region", F.first("region_length")).otherwise(F.max(spans.end()) - F.min("offset"))
    r = n.groupBy(key, *of).agg(size.alias("_len"), F.max("_f").alias("_f"), *(F.first(c).alias(c) for c in kept))
    out = r.groupBy(key).agg(F.count("_f").alias("first_ranges"), F.sum(F.when(F.col("_f") == 1, F.col("_len"))).alias("first_bytes"), *(F.first(c).alias(c) for c in kept))
    out = out.join(first.groupBy(key).agg(F.count(F.lit(1)).alias("first_units")), key)
    return out.withColumn("first_batch_ns", latency.total(latency.io(F.col("first_ranges"), F.col("first_bytes")), latency.decode(F.col("first_units"))))


def lookahead(plans: DataFrame, keys: list[str], slo_ns: float) -> DataFrame:
    """The horizon of each window: of those within the objective the best throughput, else the quickest first batch; ties: the shorter.

    plans: keys, horizon, samples, total_ns, first_batch_ns.
    """
    rate = plans.withColumn("samples_per_s", F.col("samples") * 1e9 / F.col("total_ns")).withColumn("feasible", F.col("first_batch_ns") <= F.lit(slo_ns))
    order = W.partitionBy(*keys).orderBy(F.desc("feasible"), F.when(F.col("feasible"), -F.col("samples_per_s")).otherwise(F.col("first_batch_ns")), "horizon")
    return rate.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def release_ordinal(targets: DataFrame, catalog: DataFrame, threads: int) -> DataFrame:
    """Per group of targets the decode ordinal after which all are out.

    A target (pts) is out when the first record with a greater dts is in, or the last;
    ``threads - 1`` more may be in flight. targets and catalog: video_id, gop_id, pts / ordinal, dts.
    """
    group = ["video_id", "gop_id"]
    later = F.when(F.col("dts") > F.col("pts"), F.col("ordinal"))
    both = targets.select("window_id", *group, "pts").distinct().join(catalog.select(*group, "ordinal", "dts"), group)
    each = both.groupBy("window_id", *group, "pts").agg(F.coalesce(F.min(later), F.max("ordinal")).alias("_r"), F.max("ordinal").alias("_last"))
    return each.groupBy("window_id", *group).agg(F.least(F.max("_r") + (threads - 1), F.max("_last")).cast("long").alias("release_ordinal"))


#: Reasons in the order they are reported. Fixed values.
REASONS = ("p95_slo", "p99_slo", "throughput", "portfolio_storage", "cache", "model_utility")


def portfolio(offers: DataFrame, prices: dict[str, float], limits: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Offers with their cost terms, total, reasons against them, and which one is selected (cheapest, then smallest id)."""
    c, p = F.col, {k: F.lit(v) for k, v in prices.items()}
    stored = c("portfolio_storage_bytes") + c("metadata_bytes")
    tests: dict[str, Column] = {
        "p95_slo": c("p95_ns") > limits["max_p95_ns"] if "max_p95_ns" in limits else F.lit(False),
        "p99_slo": c("p99_ns") > limits["max_p99_ns"] if "max_p99_ns" in limits else F.lit(False),
        "throughput": c("throughput_samples_s") < limits["min_throughput_samples_s"] if "min_throughput_samples_s" in limits else F.lit(False),
        "portfolio_storage": stored > limits["max_portfolio_storage_bytes"] if "max_portfolio_storage_bytes" in limits else F.lit(False),
        "cache": c("cache_bytes") > limits["max_cache_bytes"] if "max_cache_bytes" in limits else F.lit(False),
        "model_utility": c("model_utility") < limits["min_model_utility"] if "min_model_utility" in limits else F.lit(False),
    }
    over = lambda what: F.greatest(c(f"{what}_ns") - limits[f"target_{what}_ns"], F.lit(0.0)) if f"target_{what}_ns" in limits else F.lit(0.0)
    terms = {
        "storage_usd": stored * p["storage_usd_per_byte_month"] * p["retention_months"],
        "request_usd": c("requests_per_sample") * p["workload_samples"] * p["request_usd_per_request"],
        "transfer_usd": c("fetched_bytes_per_sample") * p["workload_samples"] * p["transfer_usd_per_byte"],
        "decode_usd": c("decode_ns_per_sample") * p["workload_samples"] * p["decode_compute_usd_per_ns"],
        "ingestion_usd": c("ingestion_ns") * p["ingestion_compute_usd_per_ns"] / p["amortization_runs"],
        "switch_usd": c("switch_cost_usd"),
        "slo_penalty_usd": (over("p95") + over("p99")) * p["slo_penalty_usd_per_ns"],
    }
    out = offers.withColumns(terms).withColumn("total_usd", sum((c(t) for t in terms), F.lit(0.0)))
    out = out.withColumn("reasons", F.array_join(F.array_compact(F.array(*(F.when(tests[r], r) for r in REASONS))), ","))
    ok = F.col("reasons") == ""
    order = W.partitionBy(*keys).orderBy(F.when(ok, 0).otherwise(1), "total_usd", "id")
    return out.withColumn("selected", ok & (F.row_number().over(order) == 1))


def select_pairs(profile: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Pairs to store within ``budget`` bytes: densest first (requests per byte), what doesn't fit is skipped.

    profile: keys, sample_id, requests, bytes. The order is exact: densities are
    compared as decimals of 38 digits, then requests, bytes and id decide; pairs without bytes,
    which always fit, come last. Skipping makes
    each choice depend on those before it: a fold over each key's ordered rows.
    """
    density = F.col("requests").cast("decimal(18,0)") / F.when(F.col("bytes") != 0, F.col("bytes")).cast("decimal(18,0)")
    item = F.struct(density.isNull().alias("n"), (-density).alias("d"), (-F.col("requests")).alias("r"), F.col("bytes").alias("b"), F.col("sample_id").alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<s: bigint, taken: boolean>>").alias("out"))

    def step(x: Column, e: Column) -> Column:
        fits = x["used"] + e["b"] <= budget
        return F.struct(F.when(fits, x["used"] + e["b"]).otherwise(x["used"]).alias("used"), F.concat(x["out"], F.array(F.struct(e["s"].alias("s"), fits.alias("taken")))).alias("out"))

    folded = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("x", F.aggregate("items", zero, step))
    return folded.select(*keys, F.explode("x.out").alias("o")).select(*keys, F.col("o.s").alias("sample_id"), F.col("o.taken").alias("selected"))


def mechanistic(candidates_: DataFrame, keys: list[str], model: CostModel, units_ns: dict[str, float]) -> DataFrame:
    """The control model: each wave costs its largest range; totals per candidate, the cheapest first by mode id.

    candidates_: keys, mode, position, length, units.
    """
    each = F.lit(model.latency_ns) + F.col("length") / F.lit(model.bytes_per_ns)
    waves = candidates_.withColumn("_w", F.floor(F.col("position") / model.concurrency)).groupBy(*keys, "mode", "units", "_w").agg(F.max(each).alias("_m"), F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_b"))
    total = waves.groupBy(*keys, "mode", "units").agg(F.sum("_m").alias("io_ns"), F.sum("_n").alias("ranges"), F.sum("_b").alias("bytes"))
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in units_ns.items() for x in kv)), F.col("mode"))
    out = total.withColumn("decode_ns", F.col("units") * rate).withColumn("total_ns", model.total(F.col("io_ns"), F.col("decode_ns")))
    return out.withColumn("selected", F.row_number().over(W.partitionBy(*keys).orderBy("total_ns", "mode")) == 1)


def fuse(groups: DataFrame, keys: list[str], slots: int, anchor_cost: float, delta_cost: float) -> DataFrame:
    """Whether decoding each group in one go has the shorter critical path than one decode a target.

    groups: keys, group_id, index (of the target in its group), has_delta.
    """
    delta = F.when(F.col("has_delta"), F.lit(delta_cost)).otherwise(F.lit(0.0))
    apart = groups.withColumn("_s", (F.col("group_id") + F.col("index")) % slots).groupBy(*keys, "_s").agg(F.sum(F.lit(anchor_cost) + delta).alias("_l")).groupBy(*keys).agg(F.max("_l").alias("repeated_ns"))
    own = groups.groupBy(*keys, "group_id").agg((F.lit(anchor_cost) + F.sum(delta)).alias("_l"))
    fused = own.withColumn("_s", F.col("group_id") % slots).groupBy(*keys, "_s").agg(F.sum("_l").alias("_l")).groupBy(*keys).agg(F.max("_l").alias("fused_ns"))
    return apart.join(fused, keys).withColumn("fuse", F.col("fused_ns") < F.col("repeated_ns"))
