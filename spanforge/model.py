"""Schemas, the cost model and its validation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Gap of the labelled reference plan. Fixed value.
FIXED_GAP = 16384

CATALOG = T.StructType(
    [
        T.StructField("record_id", T.LongType(), False),
        T.StructField("video_id", T.StringType(), False),
        T.StructField("class_name", T.StringType()),
        T.StructField("frame_idx", T.IntegerType(), False),
        T.StructField("gop_id", T.LongType(), False),
        T.StructField("packet_index", T.IntegerType(), False),
        T.StructField("frame_type", T.StringType(), False),
        T.StructField("record_offset", T.LongType(), False),
        T.StructField("record_length", T.LongType(), False),
        T.StructField("k", T.IntegerType(), False),
        T.StructField("k_last", T.LongType(), False),
        T.StructField("right_ref", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class CostModel:
    """Nanosecond costs of fetching and decoding. ``waves``: overhead of a wave of 1, 2, ... ranges, if measured."""

    latency_ns: float = 100_000.0
    bytes_per_ns: float = 1.0
    concurrency: int = 8
    decode_fixed_ns: float = 20_000.0
    decode_unit_ns: float = 3_000.0
    overlap: float = 0.5
    tolerance_ns: float = 50_000.0
    waves: tuple[float, ...] = field(default=())

    def __post_init__(self):
        numbers = (self.latency_ns, self.bytes_per_ns, self.decode_fixed_ns, self.decode_unit_ns, self.overlap, self.tolerance_ns, *self.waves)
        if any(not math.isfinite(x) or x < 0 for x in numbers):
            raise ValueError("costs must be finite and non-negative")
        if self.bytes_per_ns == 0 or self.concurrency < 1:
            raise ValueError("bandwidth and concurrency must be positive")
        if self.overlap > 1:
            raise ValueError("overlap must be at most 1")
        if self.waves and len(self.waves) < self.concurrency:
            raise ValueError("a wave overhead is needed for every size up to the concurrency")

    # -- columns ----------------------------------------------------------------
    def io(self, ranges: Column, size: Column) -> Column:
        """Cost of fetching so many ranges of so many bytes in all."""
        transfer = size / F.lit(self.bytes_per_ns)
        if not self.waves:
            return F.ceil(ranges / F.lit(self.concurrency)) * F.lit(self.latency_ns) + transfer
        table = F.array(*(F.lit(float(w)) for w in (0.0, *self.waves[: self.concurrency])))
        full, rest = F.floor(ranges / F.lit(self.concurrency)), ranges % F.lit(self.concurrency)
        return full * F.lit(float(self.waves[self.concurrency - 1])) + F.element_at(table, rest.cast("int") + 1) + transfer

    def decode(self, units: Column, fixed: bool = True) -> Column:
        each = units * F.lit(self.decode_unit_ns)
        return F.when(units > 0, each + (F.lit(self.decode_fixed_ns) if fixed else F.lit(0.0))).otherwise(F.lit(0.0))

    def total(self, io: Column, decode: Column) -> Column:
        return io + decode - F.lit(self.overlap) * F.least(io, decode)


DEFAULT = CostModel()
WAVED = CostModel(waves=tuple(60_000.0 + 5_000.0 * i for i in range(8)))
