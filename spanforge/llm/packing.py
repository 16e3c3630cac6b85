"""Packing token sequences by non-negative least squares over length combinations.

Each document is encoded once and its end id appended.  Whole windows of it are
sequences of their own; what remains is one piece.  The pieces' lengths, rounded up
to units of 16 tokens, make a histogram of at most ``window / unit`` bins, however
many documents there are.  All combinations of up to three bins that fill a window
are enumerated; non-negative least squares gives how often to repeat each so that
the histogram is used up; the counts are rounded and bounded by what is there.
Pieces left over are packed greedily, longest first, each as a whole.

Rounding leaves a few tokens of each window open.  These gaps, one after the other,
are filled from a few documents that are cut for it: free documents, every
``SHARE``-th piece and all of at most ``SHORT`` tokens, the shortest first, only as
many as the gaps take.  What they have beyond the gaps goes to windows of its own,
the last of them cut at powers of two, which need no padding.  So no sequence is
padded and about one document in a hundred is cut; only free documents carry their
ids beyond the encoder.  Where lengths are such that free documents can't fill the
gaps (a tiny table, or all documents of one length), encoding is done once more with
all documents free.

Which sequence a piece goes to follows from its length and its rank among pieces
of that length, by arithmetic; ranks are a partition's offset plus a running
count, so no length, however frequent, is gathered in one task.  The plan that
is sent to the executors has a few thousand entries at any input size.

Cases.  Null text: empty, so the end id alone.  Repeated rows and ids are packed
each for itself.  Empty table: no pieces.  Other columns aren't read.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import SPLIT, byte_letters, default_path, late_letters, older_split
from .common import cut, per_worker, small_batches

UNIT = 16
DEPTH = 3
#: Of the pieces one in so many may be cut, and all of at most so many tokens.
SHARE, SHORT = 16, 32


# -- the plan -----------------------------------------------------------------
def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises ||a x - b||: the active-set method on the normal equations."""
    n = a.shape[1]
    gram, proj = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(proj).max(initial=0)))
    for _ in range(rounds or 6 * a.shape[0]):
        slope = proj - gram @ x
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tol:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(gram[np.ix_(at, at)], proj[at], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            have = x[at]
            step = np.min(have[bad] / np.maximum(have[bad] - z[bad], 1e-300))
            x[at] = have + step * (z - have)
            free[at[bad & (x[at] <= 1e-9 * max(1.0, float(have.max(initial=0))))]] = False
            x[~free] = 0
            if step == 0 and not free[best]:  # the new column can't enter
                return x
    return x


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``depth`` positive unit counts that sum to ``units``."""
    out = [(units,)]
    for n in range(2, depth + 1):
        for c in itertools.combinations_with_replacement(range(units - 1, 0, -1), n - 1):
            rest = units - sum(c)
            if 0 < rest <= c[-1]:
                out.append((*c, rest))
    return out


def arrange(counts: dict[int, int], window: int, unit: int = UNIT) -> list[tuple[list[tuple[int, int]], int]]:
    """Blocks (lengths and how many of each in a sequence, number of such sequences) that use up ``counts``."""
    left, blocks = dict(counts), []

    def commit(use: dict[int, int], most: int | None = None) -> int:
        times = min(left[n] // m for n, m in use.items())
        times = times if most is None else min(times, most)
        blocks.append((list(use.items()), times))
        for n, m in use.items():
            left[n] -= m * times
        return times

    units = window // unit
    bins: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        bins.setdefault(-(-n // unit), []).append(n)
    size = lambda k: sum(left[n] for n in bins.get(k, ()))
    hist = np.array([size(k) for k in range(1, units + 1)], float)
    ways = [c for c in combinations(units) if all(hist[k - 1] for k in c)]
    if ways:
        a = np.zeros((units, len(ways)))
        for j, c in enumerate(ways):
            for k in c:
                a[k - 1, j] += 1
        x = nnls(a, hist)
        for j in np.argsort(-x, kind="stable"):
            way = ways[j]
            times = min(int(x[j] + 0.5), *(size(k) // m for k, m in Counter(way).items()), int(hist.sum()))
            while times > 0:  # the longest of one bin beside the shortest of another
                use: Counter = Counter()
                for at, k in enumerate(way):
                    use[next(n for n in (bins[k] if at % 2 == 0 else reversed(bins[k])) if left[n] > use[n])] += 1
                times -= commit(use, times)
    # what rounding left over: longest first, then whatever still fits, as often as there are such pieces
    while rest := sorted((n for n in left if left[n]), reverse=True):
        use, room = Counter(), window
        for n in rest:
            if m := min(left[n], room // n):
                use[n] = m
                room -= m * n
        commit(use)
    return blocks


class Plan:
    """Where the piece of a length and a rank goes.  ``fixed``, ``free``: pieces by length; free ones have the higher ranks."""

    def __init__(self, fixed: dict[int, int], free: dict[int, int], window: int, unit: int = UNIT):
        self.window = window
        counts = Counter(fixed)
        counts.update(free)
        need = 0
        while True:
            fill, have = {}, 0
            for n in sorted(free):
                if have < need:
                    fill[n] = min(free[n], -(-(need - have) // n))
                    have += n * fill[n]
            blocks = arrange({n: c - fill.get(n, 0) for n, c in counts.items() if c > fill.get(n, 0)}, window, unit)
            open_ = sum((window - sum(n * m for n, m in use)) * times for use, times in blocks)
            if have >= open_ or fill == free:
                break
            need = max(open_ + window, need + need // 3)
        #: Tokens of padding, and pieces that may be cut.
        self.padding, self.cut_pieces = max(open_ - have, 0), sum(fill.values())
        # segments by length: first rank, sequence base, pieces of this length per sequence, offset of the first
        self.segments: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
        taken = dict.fromkeys(counts, 0)
        # gaps: position in the stream of cut pieces, sequence base, offset and size of the gap
        self.gaps: list[tuple[int, int, int, int]] = []
        base = filled = 0
        for use, times in blocks:
            at = 0
            for n, m in use:
                self.segments[n].append((taken[n], base, m, at))
                taken[n] += m * times
                at += m * n
            if at < window:
                self.gaps.append((filled, base, at, window - at))
                filled += times * (window - at)
            base += times
        # the stream of cut pieces: first through the gaps, then in windows of its own
        self.gap_tokens, self.stream_base, at = filled, base, 0
        for n in sorted(fill):
            self.segments[n].append((taken[n], -1, 0, at))
            at += fill[n] * n
        rest = max(at - filled, 0)
        self.whole = rest // window * window
        self.ends, rest, end = [], rest - self.whole, self.whole
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                end += 1 << bit
                self.ends.append(end)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence_id, offset) of each piece it becomes; more than one only in the stream."""
        segments = self.segments[length]
        first, base, many, at = segments[bisect.bisect_right(segments, rank, key=lambda s: s[0]) - 1]
        if base >= 0:
            return [(length, base + (rank - first) // many, at + (rank - first) % many * length)]
        p = at + (rank - first) * length
        out, end = [], p + length
        while p < end:
            if p < self.gap_tokens:
                begin, seq, offset, size = self.gaps[bisect.bisect_right(self.gaps, p, key=lambda g: g[0]) - 1]
                seq, inside = seq + (p - begin) // size, (p - begin) % size
                n = min(end - p, size - inside)
                out.append((n, seq, offset + inside))
                p += n
                continue
            q = p - self.gap_tokens
            if q < self.whole:
                seq, begin = q // self.window, q // self.window * self.window
                stop = begin + self.window
            else:
                k = bisect.bisect_right(self.ends, q)
                seq, begin, stop = self.whole // self.window + k, ([self.whole, *self.ends])[k], self.ends[k]
            n = min(end - self.gap_tokens, stop) - q
            out.append((n, self.stream_base + seq, q - begin))
            p += n
        return out


# -- ids ----------------------------------------------------------------------
def _tokenizer(raw: bytes, late: str):
    """text -> ids (uint32) as the tokenizers library gives them; the library with the fastest exact form is used.

    Texts with letters newer than the tokenizers library's tables are split here by its older ones.
    """
    import tiktoken

    spec = json.loads(raw)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
    merged = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][a + b] for a, b in merged]
    if any(x >= y for x, y in itertools.pairwise(order)):
        raise ValueError("the vocabulary's ids must rise with its merges")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
    newer, split, whole = re.compile(f"[{late}]").search, older_split(late), own._core_bpe.encode_single_piece
    special = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None

    def encode(text: str | None) -> np.ndarray:
        if text and not text.isascii() and newer(text):
            out: list[int] = []
            for i, part in enumerate(special.split(text) if special else [text]):
                out += [added[part]] if i % 2 else [x for w in split(part) for x in whole(w.encode())]
            return np.array(out, np.uint32)
        return np.asarray(own.encode_to_numpy(text, allowed_special="all"), np.uint32) if text else np.empty(0, np.uint32)

    return encode


_PIECE = ["doc_id", "doc_tokens", "start", "length", "crc", "free", "ids", "pid", "idx"]
_PIECE_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64()]
_PIECE_SCHEMA = "doc_id long, doc_tokens long, start long, length int, crc long, free boolean, ids binary, pid int, idx long"


def pieces(docs: DataFrame, window: int, end_id: int, path: str | None, share: int) -> DataFrame:
    """Whole windows and one remaining piece of each document; ids only of those that may be cut."""
    spark = docs.sparkSession
    with open(path or default_path(), "rb") as f:
        raw = f.read()
    sent, key, late = spark.sparkContext.broadcast(raw), ("packing", zlib.crc32(raw)), late_letters()
    small_batches(spark)

    def cut_up(batches):
        from pyspark import TaskContext

        encode = per_worker(key, lambda: _tokenizer(sent.value, late))
        pid, seen, n_rest = TaskContext.get().partitionId(), {}, 0
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 200):
                part = all_rows.slice(at, 200)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    full = n // window * window
                    for a, b in (*((i, i + window) for i in range(0, full, window)), (full, n)):
                        if a == b:
                            continue
                        free = False
                        if b - a < window:
                            n_rest += 1
                            free = b - a <= SHORT or n_rest % share == 0
                        idx = seen[b - a, free] = seen.get((b - a, free), -1) + 1
                        data = ids[a:b]
                        rows.append((doc_id, n, a, b - a, zlib.crc32(data), free, (data.astype("<u2") if data.max() < 65536 else data).tobytes() if free else None, pid, idx))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_PIECE_KINDS)], names=_PIECE)

    return docs.select("doc_id", "text").mapInArrow(cut_up, _PIECE_SCHEMA)


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window & (window - 1) or window <= UNIT:
        raise ValueError(f"window must be a power of two above {UNIT}")
    for share in (SHARE, 1):
        found = cut(pieces(docs, window, end_id, path, share))
        counts = found.groupBy("pid", "length", "free").agg(F.count(F.lit(1)).alias("n"))
        hist = {(r["length"], r["free"]): r["n"] for r in counts.groupBy("length", "free").agg(F.sum("n").alias("n")).collect()}  # at most 2 * window rows
        plan = Plan(*({n: c for (n, free), c in hist.items() if free is kind} for kind in (False, True)), window)
        if not plan.padding:
            break
    order = W.partitionBy("length").orderBy("free", "pid").rowsBetween(W.unboundedPreceding, 0)
    before = counts.select("pid", "length", "free", (F.sum("n").over(order) - F.col("n")).alias("before"))
    sent_plan = docs.sparkSession.sparkContext.broadcast(plan)
    ranked = found.join(before, ["pid", "length", "free"]).select("doc_id", "doc_tokens", "start", "length", "crc", "ids", (F.col("before") + F.col("idx")).alias("rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches):
        plan = sent_plan.value
        for part in batches:
            rows = []
            for doc_id, n, start, length, crc, ids, rank in zip(*(c.to_pylist() for c in part.columns), strict=True):
                spots = plan.place(length, rank)
                if len(spots) == 1:
                    rows.append((doc_id, start, length, crc, n, *spots[0][1:]))
                    continue
                data = np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4")
                at = 0
                for size, seq, offset in spots:
                    rows.append((doc_id, start + at, size, zlib.crc32(data[at : at + size]), n, seq, offset))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=names)

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
