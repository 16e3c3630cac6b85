"""Scalar functions: hexadecimal and JSON numbers, ratios, closure bytes, start-code streams."""

from __future__ import annotations

import struct
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_int(document: Column, path: str) -> Column:
    """A whole number of a JSON document, written as number or string; null otherwise."""
    text = F.get_json_object(document, path)
    return F.when(text.rlike(r"^\s*-?\d{1,18}\s*$"), F.trim(text).cast("long"))


def parse_hex(dump: Column) -> Column:
    """The bytes of a hexadecimal dump whose lines are 'address: hex hex ...  text'."""
    lines = F.transform(F.split(dump, "\n"), lambda line: F.regexp_replace(F.regexp_extract(line, r"^[0-9a-fA-F]+:((?: ?[0-9a-fA-F]{2,4})+)", 1), " ", ""))
    return F.unhex(F.array_join(lines, ""))


def ratio_ppm(part: Column, whole: Column) -> Column:
    """Parts per million, rounded; nothing finite and positive is zero."""
    r = F.when(whole != 0, part / whole)
    good = r.isNotNull() & ~F.isnan(r) & (r > 0) & (r < float("inf"))
    return F.when(good, F.round(r * 1e6).cast("long")).otherwise(F.lit(0).cast("long"))


def encode_closure(ids: Column) -> Column:
    """Little-endian unsigned 64-bit ids as bytes: each hex string reversed by pairs."""
    one = lambda i: F.array_join(F.reverse(F.split(F.regexp_replace(F.lpad(F.hex(i), 16, "0"), "(..)(?=.)", "$1,"), ",")), "")
    return F.unhex(F.array_join(F.transform(ids, one), ""))


def _decode(data: bytes) -> list[int]:
    if len(data) % 8:
        raise ValueError("closure bytes must be a multiple of eight")
    return list(struct.unpack(f"<{len(data) // 8}q", data))


def decode_closure(data: Column) -> Column:
    """The ids of ``encode_closure``'s bytes; a length that isn't a multiple of eight fails the query."""

    @F.pandas_udf("array<bigint>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else _decode(bytes(b)))

    return run(data)


def annex_b(sample: bytes, length_size: int) -> bytes:
    """Length-prefixed units as a start-code stream; empty or cut units are errors."""
    return bytes(_annex_b(sample, length_size, bytearray()))


def _annex_b(sample, length_size: int, out: bytearray) -> bytearray:
    """``out`` with the sample's units behind it."""
    if not 1 <= length_size <= 4:
        raise ValueError("length size must be 1 to 4")
    at = 0
    while at < len(sample):
        if at + length_size > len(sample):
            raise ValueError("length prefix is cut")
        n = int.from_bytes(sample[at : at + length_size], "big")
        at += length_size
        if not n or at + n > len(sample):
            raise ValueError("unit is empty or cut")
        out += b"\0\0\0\1"
        out += sample[at : at + n]
        at += n
    return out


def to_annex_b(sample: Column, length_size: int) -> Column:
    """Of a batch Python holds what came in and what goes out, once each, and no object a row."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return annex_b_array(values, length_size)

    return run(sample)


def annex_b_array(values: pa.Array, length_size: int) -> pa.Array:
    out, ends = bytearray(), array("i", [0])
    for i in range(len(values)):
        if values[i].is_valid:
            _annex_b(memoryview(values[i].as_buffer()), length_size, out)
        ends.append(len(out))
    valid = values.is_valid().buffers()[1] if values.null_count else None  # a boolean array's values are its bits
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [valid, pa.py_buffer(ends), pa.py_buffer(out)])


def units(stream: bytes) -> list[tuple[int, bytes]]:
    """(type, unit) of a start-code stream; start codes have three or four bytes."""
    out, at = [], stream.find(b"\0\0\1")
    while at >= 0:
        begin = at + 3
        at = stream.find(b"\0\0\1", begin)
        unit = stream[begin : at if at >= 0 else len(stream)]
        unit = unit[:-1] if at >= 0 and unit.endswith(b"\0") else unit
        if unit:
            out.append((unit[0] & 0x1F, unit))
    return out


def split_units(stream: Column) -> Column:
    """The units of a start-code stream in order, with their types."""

    @F.pandas_udf("array<struct<unit_type:int,unit:binary>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else [{"unit_type": k, "unit": u} for k, u in units(bytes(b))])

    return run(stream)


def parameter_units(record: bytes) -> tuple[int, bytes]:
    """Size of the length prefix and the parameter sets, as a start-code stream, of a configuration record."""
    if len(record) < 7 or record[0] != 1:
        raise ValueError("not a configuration record of version 1")
    at, out = 5, b""
    for mask, kind in ((0x1F, "sequence"), (0xFF, "picture")):
        if at >= len(record):
            raise ValueError(f"no count of {kind} sets")
        count, at = record[at] & mask, at + 1
        for _ in range(count):
            end = at + 2 + int.from_bytes(record[at : at + 2], "big")
            if at + 2 > len(record) or end > len(record):
                raise ValueError(f"{kind} set is cut")
            out, at = out + b"\0\0\0\1" + record[at + 2 : end], end
    if not out:
        raise ValueError("no parameter sets")
    return (record[4] & 3) + 1, out


def parameter_sets(record: Column) -> Column:
    @F.pandas_udf("length_size int, stream binary")
    def run(values: pd.Series) -> pd.DataFrame:
        found = [(None, None) if b is None else parameter_units(bytes(b)) for b in values]
        return pd.DataFrame({"length_size": pd.array([n for n, _ in found], "Int32"), "stream": [s for _, s in found]})

    return run(record)
