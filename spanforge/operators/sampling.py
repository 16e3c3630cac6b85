"""Reordering an epoch so that batches share dependencies.

The choice is greedy and each step depends on all before it: groups (shards, or
visible windows) are independent and run in parallel, each in one grouped map whose
size the lookahead bounds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULT, FIXED_GAP, CostModel


def closure_cost(extents: dict[int, tuple[int, int]], model: CostModel, gap: int) -> float:
    """Total cost of one sparse plan over distinct records {record_id: (offset, length)}."""
    ranges = size = 0
    reach = start = None
    for off, length in sorted(extents.values()):
        if reach is not None and off <= reach + gap:
            reach = max(reach, off + length)
            continue
        if reach is not None:
            ranges, size = ranges + 1, size + reach - start
        start, reach = off, off + length
    if reach is not None:
        ranges, size = ranges + 1, size + reach - start
    io = -(-ranges // model.concurrency) * model.latency_ns + size / model.bytes_per_ns
    decode = model.decode_fixed_ns + len(extents) * model.decode_unit_ns if extents else 0.0
    return io + decode - model.overlap * min(io, decode)


def _spans(extents, gap: int) -> list[tuple[int, int]]:
    """(start, end) of what sorted (start, end) extents merge to."""
    out: list[tuple[int, int]] = []
    for start, end in extents:
        if out and start <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class Whole:
    """The records a batch holds, priced as a whole by any function of their extents."""

    def __init__(self, closure: dict[int, dict[int, tuple[int, int]]], cost: Callable):
        self.closure, self.of, self.held = closure, cost, {}

    def clear(self) -> None:
        self.held = {}

    def cost(self, record: int) -> float:
        return self.of(self.held | self.closure[record])

    def take(self, record: int) -> None:
        self.held |= self.closure[record]


class Sparse:
    """As ``Whole`` with ``closure_cost``, but only the spans that a closure's own come near are merged anew for its price.

    Spans stand for all they merged: what is added later joins one of them, or not, as it would have joined its extents.
    """

    def __init__(self, closure: dict[int, dict[int, tuple[int, int]]], model: CostModel, gap: int):
        self.model, self.gap, self.ids = model, gap, {r: frozenset(c) for r, c in closure.items()}
        self.of = {r: _spans(sorted((o, o + n) for o, n in c.values()), gap) for r, c in closure.items()}
        self.clear()

    def clear(self) -> None:
        self.held: set[int] = set()
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.size = 0

    def _merged(self, record: int) -> tuple[int, int, list[tuple[int, int]], int]:
        """Spans from lo up to hi are replaced by the next; and by how many bytes these are more."""
        own = self.of[record]
        if not own:
            return 0, 0, [], 0
        lo, hi = bisect_left(self.ends, own[0][0] - self.gap), bisect_right(self.starts, own[-1][1] + self.gap)
        near = list(zip(self.starts[lo:hi], self.ends[lo:hi], strict=True))
        new = _spans(sorted(near + own), self.gap) if near else own
        return lo, hi, new, sum(e - s for s, e in new) - sum(e - s for s, e in near)

    def cost(self, record: int) -> float:
        lo, hi, new, more = self._merged(record)
        model, units = self.model, len(self.held) + len(self.ids[record] - self.held)
        ranges, size = len(self.starts) - (hi - lo) + len(new), self.size + more
        io = -(-ranges // model.concurrency) * model.latency_ns + size / model.bytes_per_ns
        decode = model.decode_fixed_ns + units * model.decode_unit_ns if units else 0.0
        return io + decode - model.overlap * min(io, decode)

    def take(self, record: int) -> None:
        lo, hi, new, more = self._merged(record)
        self.starts[lo:hi], self.ends[lo:hi] = [s for s, _ in new], [e for _, e in new]
        self.size += more
        self.held |= self.ids[record]


def bounded(order: list[int], closure: dict[int, dict[int, tuple[int, int]]], batch: int, lookahead: int, cost: Callable | Sparse) -> list[int]:
    """Ranks of ``order`` in the order they are emitted: the first of a batch and whoever is overdue go first in, first out; else the cheapest, ties to the earlier."""
    if batch < 1 or lookahead < 1 or not order:
        raise ValueError("batch, lookahead and order must not be empty")
    pending: deque[int] = deque()
    nxt, out = 0, []
    held = cost if isinstance(cost, Sparse) else Whole(closure, cost)
    while len(out) < len(order):
        held.clear()
        for slot in range(min(batch, len(order) - len(out))):
            while len(pending) < lookahead and nxt < len(order):
                pending.append(nxt)
                nxt += 1
            if slot == 0 or len(pending) == 1 or pending[0] + lookahead <= len(out):
                chosen = pending[0]
            else:
                chosen = min(pending, key=lambda r: (held.cost(order[r]), r))
            pending.remove(chosen)
            held.take(order[chosen])
            out.append(chosen)
    return out


def label_preserving(order: list[int], labels: list[int], closure: dict[int, dict[int, tuple[int, int]]], batch: int, lookahead: int, cost: Callable | Sparse) -> list[int]:
    """As above, but every position keeps its label and windows of ``batch * lookahead`` samples are emptied one after the other."""
    out: list[int] = []
    size = batch * lookahead
    held = cost if isinstance(cost, Sparse) else Whole(closure, cost)
    for at in range(0, len(order), size):
        queues: dict[int, list[int]] = {}
        for r in range(at, min(at + size, len(order))):
            queues.setdefault(labels[r], []).append(r)
        held.clear()
        for k in range(at, min(at + size, len(order))):
            if (k - at) % batch == 0:
                held.clear()
            queue = queues[labels[k]]
            first = lookahead == 1 or (k - at) % batch == 0 or len(queue) == 1
            chosen = queue[0] if first else min(queue, key=lambda r: (held.cost(order[r]), r))
            queue.remove(chosen)
            held.take(order[chosen])
            out.append(chosen)
    return out


def plan(samples: DataFrame, edges: DataFrame, keys: list[str], batch: int, lookahead: int, labelled: bool = False, model: CostModel = DEFAULT, gap: int = FIXED_GAP) -> DataFrame:
    """Emitted position of each sample: keys, rank, record_id, position.

    samples: keys, rank, record_id, label; edges: target_id, dep_id, offset, length.
    """
    deps = edges.groupBy(F.col("target_id").alias("record_id")).agg(F.collect_list(F.struct("dep_id", "offset", "length")).alias("deps"))
    rows = samples.join(deps, "record_id")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        closure = {r: {d["dep_id"]: (d["offset"], d["length"]) for d in ds} for r, ds in zip(g["record_id"], g["deps"], strict=True)}
        cost = Sparse(closure, model, gap)
        order = g["record_id"].tolist()
        out = label_preserving(order, g["label"].tolist(), closure, batch, lookahead, cost) if labelled else bounded(order, closure, batch, lookahead, cost)
        position = {r: i for i, r in enumerate(out)}
        res = g[[*keys, "rank", "record_id", "label"]].copy()
        res["position"] = [position[i] for i in range(len(g))]
        res["emitted_label"] = [g["label"].iloc[r] for r in out]  # by position: the label that stands at this row's rank now
        return res

    kinds = dict(samples.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", rank long, record_id long, label long, position long, emitted_label long"
    return rows.select(*keys, F.col("rank").cast("long").alias("rank"), "record_id", F.col("label").cast("long").alias("label"), "deps").groupBy(*keys).applyInPandas(run, schema)


def displacement(planned: DataFrame, keys: list[str]) -> DataFrame:
    d = F.abs(F.col("position") - F.col("rank"))
    return planned.groupBy(*keys).agg(F.max(d).alias("max_displacement"), F.round(F.avg(d), 6).alias("mean_displacement"))
