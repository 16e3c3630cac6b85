"""Learning from observed windows: features, robust online regression, tails, rolling figures."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CostModel


@dataclass(frozen=True)
class Settings:
    """Constants of the estimator. Fixed values."""

    rate: float = 0.25
    huber: float = 3.0
    relative_step: float = 0.5
    forgetting: float = 0.98
    ratios: int = 128
    least_observations: int = 16
    least_accurate: int = 4
    accurate: float = 0.5
    fallback_after: int = 8


class Regression:
    """Normalised least mean squares on a projected, clipped error."""

    def __init__(self, start: list[float], settings: Settings = Settings()):
        self.s, self.start, self.rejected = settings, np.array(start, float), 0
        self.reset()

    def reset(self) -> None:
        self.theta, self.scale, self.n, self.accurate, self.inaccurate = self.start.copy(), None, 0, 0, 0
        self.ratios: deque[float] = deque(maxlen=self.s.ratios)

    def observe(self, x: np.ndarray, y: float) -> float:
        """Take one observation in; returns what was predicted before. What isn't finite or positive is rejected."""
        s = self.s
        predicted = max(0.0, float(self.theta @ x)) if np.isfinite(x).all() else 0.0
        if not np.isfinite(x).all() or not math.isfinite(y) or y <= 0:
            self.rejected += 1
            return predicted
        if predicted > 0:
            self.ratios.append(min(max(y / predicted, 0.25), 16.0))
        error = y - predicted
        scale = self.scale if self.scale is not None else max(0.25 * abs(predicted), 1000.0)
        clipped = min(max(error, -s.huber * scale), s.huber * scale)
        norm = float(x @ x)
        step = s.rate * clipped * x / (norm + 1e-9)
        reach = abs(predicted / math.sqrt(norm + 1e-9))
        limit = s.relative_step * np.maximum(np.abs(self.theta), max(reach, 1000.0))
        self.theta = np.clip(self.theta + np.clip(step, -limit, limit), 1.0, np.maximum(50 * self.start, 1e6))
        size = max(abs(error), 1000.0) if self.scale is None else abs(error)
        self.scale = size if self.scale is None else s.forgetting * self.scale + (1 - s.forgetting) * size
        self.n += 1
        good = y > 0 and abs(error) / y <= s.accurate
        self.accurate, self.inaccurate = (self.accurate + 1, 0) if good else (0, self.inaccurate + 1)
        return predicted

    def tail(self) -> float:
        """The 95th percentile of recent ratios, at least one; 16 before there are enough."""
        if len(self.ratios) < max(self.s.least_observations, 1):
            return 16.0
        ordered = sorted(self.ratios)
        return max(1.0, ordered[math.ceil(0.95 * len(ordered)) - 1])


class Controller:
    """Two regressions, the activation latch, and the fallback that a run of bad forecasts enters and a run of good ones leaves."""

    def __init__(self, io: list[float], decode: list[float], settings: Settings = Settings()):
        self.s, self.io, self.decode = settings, Regression(io, settings), Regression(decode, settings)
        self.active = self.fallback = False

    def observe(self, x_io: np.ndarray, io_ns: float, x_decode: np.ndarray, decode_ns: float) -> tuple[float, float]:
        out = self.io.observe(x_io, io_ns), self.decode.observe(x_decode, decode_ns)
        both = (self.io, self.decode)
        if all(r.n >= self.s.least_observations and r.accurate >= self.s.least_accurate for r in both):
            if not self.active:
                self._forget_tails()  # they tell how the start converged, not how it runs
            self.active = True
        if self.active and not self.fallback and self.io.inaccurate >= self.s.fallback_after:
            self.fallback = True
            self.io.reset()
            self.decode.reset()
        elif self.fallback and all(r.accurate >= self.s.fallback_after for r in both):
            self.fallback = False
            self._forget_tails()
        return out

    def _forget_tails(self) -> None:
        self.io.ratios.clear()
        self.decode.ratios.clear()

    def tails(self) -> tuple[float, float]:
        """How much worse the tail is than forecast, for reading and decoding; 16 while the estimator isn't in use."""
        return (self.io.tail(), self.decode.tail()) if self.active and not self.fallback else (16.0, 16.0)


def features(observed: DataFrame, concurrency: int) -> DataFrame:
    """Feature columns of a window: waves, further ranges per slot, 64 KiB pages; decode units by 16."""
    waves = F.ceil(F.col("ranges") / concurrency)
    return observed.withColumns({
        "f_waves": waves.cast("double"),
        "f_extra": F.greatest(F.col("ranges") - waves, F.lit(0)) / F.lit(float(concurrency)),
        "f_pages": F.col("bytes") / F.lit(65536.0),
        "f_units": F.col("units") / F.lit(16.0),
    })


#: Columns of a trace: what was forecast, then the state after the observation.
TRACE = "session long, seq long, io_predicted_ns double, decode_predicted_ns double, io_tail double, decode_tail double, active boolean, fallback boolean, wave_ns double, extra_ns double, page_ns double, fixed_ns double, units_ns double"


def trace(observed: DataFrame, io_start: list[float], decode_start: list[float], settings: Settings = Settings()) -> DataFrame:
    """The estimator's state after each observation of a session, in order: a fold per session.

    observed: session, seq, f_waves, f_extra, f_pages, f_units, io_ns, decode_ns. Sessions run
    side by side; one session is a sequence by nature and stays one task, of one row a window.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c, out = Controller(io_start, decode_start, settings), []
        for r in rows.sort_values("seq").itertuples(index=False):
            io, dec = c.observe(np.array([r.f_waves, r.f_extra, r.f_pages]), r.io_ns, np.array([1.0, r.f_units]), r.decode_ns)
            out.append((r.session, r.seq, io, dec, *c.tails(), c.active, c.fallback, *c.io.theta, *c.decode.theta))
        return pd.DataFrame(out, columns=[f.split()[0] for f in TRACE.split(", ")])

    return observed.groupBy("session").applyInPandas(run, TRACE)


def models(traced: DataFrame, model: CostModel) -> DataFrame:
    """The cost model that holds when each window is planned: what the window before it in the session left.

    Adds in_use, wave_first_ns (a wave of one range), wave_step_ns (each further range), bytes_per_ns,
    decode_fixed_ns, decode_unit_ns, and the two tails. Before the estimator is in use, and during a
    fallback, the model is ``model`` itself, and both tails are 16.
    """
    w = W.partitionBy("session").orderBy("seq")
    before = lambda c, first: F.coalesce(F.lag(c).over(w), F.lit(first))
    n = float(model.concurrency)
    waves = model.waves or (model.latency_ns,) * model.concurrency
    step = (waves[model.concurrency - 1] - waves[0]) / (n - 1) if n > 1 else 0.0
    used = before(F.col("active") & ~F.col("fallback"), False)
    pick = lambda learned, given: F.when(F.col("in_use"), learned).otherwise(F.lit(float(given)))
    t = traced.withColumn("in_use", used).withColumns({f"_{c}": F.lag(c).over(w) for c in ("wave_ns", "extra_ns", "page_ns", "fixed_ns", "units_ns")})
    t = t.withColumns({"io_tail": before("io_tail", 16.0), "decode_tail": before("decode_tail", 16.0)})
    return t.select(
        "session", "seq", "in_use",
        pick(F.col("_wave_ns"), waves[0]).alias("wave_first_ns"), pick(F.col("_extra_ns") / n, step).alias("wave_step_ns"),
        pick(F.lit(65536.0) / F.greatest(F.col("_page_ns"), F.lit(1.0)), model.bytes_per_ns).alias("bytes_per_ns"),
        pick(F.col("_fixed_ns"), model.decode_fixed_ns).alias("decode_fixed_ns"), pick(F.col("_units_ns") / 16.0, model.decode_unit_ns).alias("decode_unit_ns"),
        "io_tail", "decode_tail",
    )


def priced(plans: DataFrame, keys: list[str], by_window: DataFrame, model: CostModel, tail: bool = False) -> DataFrame:
    """Plans (ranges, bytes, units) at the costs of their window's own model; ``tail``: at its bad end, for promises on latency."""
    io_x, decode_x = (F.col("io_tail"), F.col("decode_tail")) if tail else (F.lit(1.0), F.lit(1.0))
    full, rest = F.floor(F.col("ranges") / F.lit(model.concurrency)), F.col("ranges") % F.lit(model.concurrency)
    of = lambda n: F.col("wave_first_ns") + (n - 1) * F.col("wave_step_ns")
    io = (full * of(F.lit(model.concurrency)) + F.when(rest > 0, of(rest)).otherwise(F.lit(0.0)) + F.col("bytes") / F.col("bytes_per_ns")) * io_x
    decode = F.when(F.col("units") > 0, F.col("decode_fixed_ns") + F.col("units") * F.col("decode_unit_ns")).otherwise(F.lit(0.0)) * decode_x
    both = plans.drop("io_ns", "decode_ns", "total_ns").join(by_window, keys).withColumn("io_ns", io).withColumn("decode_ns", decode)
    return both.withColumn("total_ns", model.total(F.col("io_ns"), F.col("decode_ns")))


def merged(branches: DataFrame, keys: list[str], sums: list[str], maxima: list[str], earliest: list[str]) -> DataFrame:
    """Counters of parallel branches as one row: counts add up, what runs side by side is its longest, first times are the earliest that happened (zero: none)."""
    first = lambda c: F.coalesce(F.min(F.when(F.col(c) > 0, F.col(c))), F.lit(0))
    return branches.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima), *(first(c).alias(c) for c in earliest))


def tail_multiplier(ratios: DataFrame, keys: list[str], width: int = 128) -> DataFrame:
    """Rolling 95th percentile (nearest rank) of clamped ratios, at least one."""
    w = W.partitionBy(*keys).orderBy("seq").rowsBetween(-(width - 1), 0)
    kept = F.sort_array(F.collect_list(F.least(F.greatest(F.col("ratio"), F.lit(0.25)), F.lit(16.0))).over(w))
    return ratios.withColumn("_v", kept).withColumn("tail", F.greatest(F.lit(1.0), F.element_at("_v", F.ceil(F.size("_v") * F.lit(0.95)).cast("int")))).drop("_v")


def service_ewma(times: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-number moving average (7 old + new) / 8, the first value as seed: a fold per key, linear in its length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, a = rows.sort_values("seq"), [], None
        for v in rows["value"].tolist():
            a = v if a is None else (a * 7 + v) // 8
            out.append(a)
        return rows[[*keys, "seq"]].assign(ewma=out)

    kinds = {f.name: f.dataType.simpleString() for f in times.schema}
    return times.select(*keys, "seq", "value").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "seq")) + ", ewma long")


def capped_trace(events: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """The first ``cap`` events of each key, with how many there were and how many were dropped."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    total = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return events.withColumn("_n", n).withColumn("expected", total).filter(F.col("_n") <= cap).withColumn("dropped", F.greatest(F.col("expected") - cap, F.lit(0))).drop("_n")
