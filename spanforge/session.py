"""A session: one catalog, its closures and bytes, one cost model; windows of requests in, ordered results out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .model import DEFAULT, FIXED_GAP, CostModel
from .operators import closures, costing, execute, resolve, spans

ACTIONS = ("keyframe_prefix", "calibrated_closure", "exact_closure", "fixed_gap_closure", "region_selective", "region_all")
KEYS = ["window_id"]


@dataclass(frozen=True)
class Limits:
    """Capacities; lanes follow from them."""

    windows: int = 4
    callers: int = 8
    threads: int = 8
    decoder_threads: int = 1
    max_gap: int | None = FIXED_GAP
    max_range: int | None = None

    def __post_init__(self):
        if min(self.windows, self.callers, self.threads, self.decoder_threads) < 1:
            raise ValueError("capacities must be positive")
        if (self.max_gap is not None and self.max_gap < 0) or (self.max_range is not None and self.max_range < 1):
            raise ValueError("gap must not be negative, range must be positive")

    @property
    def lanes(self) -> int:
        return max(1, min(self.windows, self.callers, self.threads // self.decoder_threads))


def plan_byte_ranges(records: DataFrame, gap: int | None, cap: int | None = None, keys: list[str] | None = None, empty: bool = False) -> DataFrame:
    """Spans over records (keys, record_id, offset, length) with each record's place in its span; bad records are an error.

    ``empty``: records without bytes are good, as in catalogs of texts.
    """
    keys = keys or []
    own = records if keys else records.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    if bad := spans.violations(own, by, empty).first():
        raise ValueError(f"record {bad['record_id']}: {bad['reason']}")
    own = own.dropDuplicates([*by, "record_id"])
    n = spans.numbered(own, by, gap) if cap is None or gap is None else spans.numbered_capped(own, by, gap, cap)
    return spans.members(n, by).select(*keys, "span", "record_id", "offset", "length", "relative_offset")


class Session:
    def __init__(self, catalog: DataFrame, closure: DataFrame, payloads: DataFrame, model: CostModel = DEFAULT, limits: Limits = Limits()):
        """payloads: record_id, data (binary or string)."""
        self.catalog, self.closure, self.model, self.limits = catalog, closure, model, limits
        self.regions = closures.regions(catalog)
        self.kept: list[DataFrame] = []
        self.store = execute.groups(catalog, closure, payloads)

    def resolve(self, requests: DataFrame) -> DataFrame:
        place = self.catalog.select("video_id", "frame_idx", "record_id", "gop_id", "packet_index")
        return resolve.resolve(requests, place, strict=True)

    def _keep(self, df: DataFrame) -> DataFrame:
        """Persist what a call reads several times (rebuilt from its lineage if lost); ``close`` lets it go."""
        self.kept.append(df.persist())
        return df

    def close(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def needed(self, targets: DataFrame) -> DataFrame:
        """Distinct records of each window's closures, by window, so that planning needs no further exchange."""
        return closures.union(targets, self.closure, self.catalog, KEYS)

    def candidates(self, requests: DataFrame, resident: DataFrame | None = None) -> DataFrame:
        needed = self._keep(self.needed(self.resolve(requests)))
        fetch = closures.without(needed, resident, KEYS) if resident is not None else needed
        return costing.candidates(needed, fetch, self.regions, KEYS, self.model, self.limits.max_gap)

    def plan(self, requests: DataFrame, resident: DataFrame | None = None) -> DataFrame:
        """The chosen plan of each window."""
        return costing.choose(self.candidates(requests, resident), KEYS, self.model)

    def _fetches(self, needed: DataFrame, action: str) -> DataFrame:
        """``needed`` with the span (span_offset, span_length) each record is fetched in."""
        group = ["video_id", "gop_id"]
        if action == "exact_closure":
            return needed.withColumn("span_offset", F.col("offset")).withColumn("span_length", F.col("length"))
        if action.startswith("region"):
            return needed.join(self.regions.select(*group, F.col("region_offset").alias("span_offset"), F.col("region_length").alias("span_length")), group)
        if action == "keyframe_prefix":
            last = F.max("packet_index").over(W.partitionBy(*KEYS, *group))
            return needed.withColumn("packet_index", last).join(closures.prefixes(self.catalog).drop("records"), [*group, "packet_index"])
        if action == "fixed_gap_closure":
            n = spans.numbered(needed, KEYS, FIXED_GAP) if self.limits.max_range is None else spans.numbered_capped(needed, KEYS, FIXED_GAP, self.limits.max_range).join(needed.select(*KEYS, "record_id", *group), [*KEYS, "record_id"])
        else:
            plans = costing.candidates(needed, needed, None, KEYS, self.model, self.limits.max_gap)
            gap = costing.choose(plans, KEYS, self.model).select(*KEYS, F.coalesce("threshold", F.lit(-(1 << 62))).alias("_gap"))  # a null threshold never merges
            n = spans.numbered(needed.join(gap, KEYS), KEYS, F.col("_gap"))
        w = W.partitionBy(*KEYS, "span")
        return n.withColumn("span_offset", F.min("offset").over(w)).withColumn("span_length", F.max(spans.end()).over(w) - F.col("span_offset"))

    def execute(self, requests: DataFrame, action: str = "calibrated_closure") -> DataFrame:
        """Results of every request in order: window_id, batch_id, pos, sample_id, record_id, digest, width.

        Unknown targets fail the whole call. Whatever the action fetches, records are cut
        out of it and only closures are decoded, so all actions give the same results.
        """
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action}")
        return self._results(self.resolve(requests), action).orderBy(*KEYS, "batch_id", "pos")

    def _results(self, targets: DataFrame, action: str = "calibrated_closure") -> DataFrame:
        targets = self._keep(targets)
        needed = self.needed(targets)
        return execute.serve(targets, self._fetches(self._keep(needed) if action == "calibrated_closure" else needed, action), self.store, KEYS)

    def execute_portfolio(self, requests: DataFrame, materialized: DataFrame) -> DataFrame:
        """Requests whose record is materialized are served from there, the others by ``execute``; one ordered result.

        materialized: record_id, digest, width.
        """
        targets = self._keep(resolve.route_pairs(self.resolve(requests), materialized))
        have = targets.filter("branch = 'pair'").join(materialized, "record_id").select(*KEYS, "batch_id", "pos", "sample_id", "record_id", "digest", "width")
        rest = targets.filter("branch = 'fallback'").drop("branch")
        return have.unionByName(self._results(rest)).orderBy(*KEYS, "batch_id", "pos")
