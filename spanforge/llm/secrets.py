"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Patterns find assignments, access keys and long hexadecimal runs.  Every further
run of key characters, 12 or more with a digit or 24 or more without, is a
candidate; the network reads it with ``CONTEXT`` characters on either side (characters as
classes, an embedding, one convolution, the maximum over positions, a dense
layer) and adds it if its score reaches the threshold.

Training judges values by shape and surroundings, not by what the
patterns look for.  Positive are the values of pattern hits with the key word or
prefix taken away, and drawn keys of the kinds in ``KEYS``; negative are candidates
of the documents and drawn names, numbers, paths and the like (``PLAIN``).  Every
hit and every candidate of every document is an example, and every document has a
key and a harmless value drawn and set into surroundings of its own (several, if
there are few documents).  Equal examples count once.  There are two networks: each half of the documents,
by a hash of the id, is scored by the one that learned from the other half, so no
candidate is judged by a network that was told it is harmless.  A quarter of the
examples, by their hash, is held out; the threshold is the one with the fewest false
findings among those that keep ``RECALL`` of all held out positives, and scores are
calibrated on the same part (Platt), both from exact counts by logit, in steps of
1 / ``STEPS``.

Distribution.  The other examples are dealt by hash into shards of about ``SHARD``.  In
each of ``ROUNDS`` rounds every shard trains from the common weights in numpy, and the
means over shards are the next common weights (iterative parameter mixing).  Means
are of integers, shards and their order follow from the examples: the networks don't
depend on how the table is partitioned.

Cases.  Null text is empty: no findings.  Without any text the networks learn from
drawn examples alone.  A null id belongs to the first half.  Repeated rows repeat.
Offsets are code points.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, fresh, map_rows, per_worker

#: Drawn examples of each label a half has at least; what ``gathered`` shows at most.
EXAMPLES = 1_500
SAMPLE = 20_000
#: Examples of a shard, rounds of training, steps of a logit, fixed point of the means.
SHARD, ROUNDS = 2_048, 15
STEPS, _POINT = 256, 1 << 36
CONTEXT, VALUE = 24, 48
RECALL = 0.98
#: The patterns, their order, and the least length of group or match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "network")
#: Candidates: runs of key characters of this length at least, with a digit and without.
WITH_DIGIT, WITHOUT = 12, 24
_run = re.compile(rf"[A-Za-z0-9+/_.=-]{{{WITH_DIGIT},}}").finditer
_digit = re.compile(r"[0-9]").search


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, in order; HEX asks for maximal runs, so their length at once."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long runs of key characters that no pattern's finding overlaps."""
    out, k = [], 0
    reach = 0  # the furthest end of findings that start before the run ends
    for m in _run(text):
        a, b = m.span()
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a and (b - a >= WITHOUT or _digit(m[0])):
            out.append((a, b))
    return out


def _table() -> np.ndarray:
    """Character to class: printable ASCII each its own, the rest by kind; 0 is padding."""
    t = np.full(1 << 16, 98, np.int64)
    t[32:127] = np.arange(1, 96)
    t[[9, 10, 11, 12, 13]] = 96
    return t


CLASSES, LENGTH = 99, 2 * CONTEXT + VALUE
_CLASS = _table()


def encode(text: str, a: int, b: int) -> np.ndarray:
    """Classes of context, value and context; a value over ``VALUE`` is shown by its two ends."""
    value = text[a:b] if b - a <= VALUE else text[a : a + VALUE // 2] + text[b - VALUE // 2 : b]
    out = np.zeros(LENGTH, np.int64)
    for at, part in ((CONTEXT - len(text[max(0, a - CONTEXT) : a]), text[max(0, a - CONTEXT) : a]), (CONTEXT, value), (CONTEXT + VALUE, text[b : b + CONTEXT])):
        if part:
            codes = np.minimum(np.frombuffer(part.encode("utf-32-le", "replace"), "<u4"), 65535)
            out[at : at + len(codes)] = _CLASS[codes]
    return out


class Network:
    """Embedding, convolution, maximum, dense; float32, trained with Adam on the logistic loss."""

    def __init__(self, width: int = 8, filters: int = 24, size: int = 5, seed: int = 7):
        r = np.random.default_rng(seed)
        self.size = size
        # two embeddings' worth of rows: a character inside the value isn't the same as one beside it
        self.p = {
            "e": r.normal(0, 0.5, (2 * CLASSES, width)).astype(np.float32),
            "w": r.normal(0, (width * size) ** -0.5, (size * width, filters)).astype(np.float32),
            "c": np.zeros(filters, np.float32),
            "v": r.normal(0, filters**-0.5, filters).astype(np.float32),
            "d": np.zeros(1, np.float32),
        }
        self.threshold, self.slope, self.shift = math.inf, 1.0, 0.0

    @staticmethod
    def _inside(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, CONTEXT : CONTEXT + VALUE] += CLASSES
        return x

    def _forward(self, x: np.ndarray):
        """Position and value of each filter's maximum (filters, rows), what passes on, and logits; filters first, so that positions lie together."""
        p, s = self.p, self.size
        n, length = x.shape
        wide, e = length - s + 1, p["e"].T[:, x]  # width, rows, positions
        cols = np.empty((s, len(e), n, wide), np.float32)
        for k in range(s):
            cols[k] = e[:, :, k : k + wide]
        z = (p["w"].T @ cols.reshape(-1, n * wide)).reshape(-1, wide)
        at = z.argmax(1)
        top = z[np.arange(len(z)), at].reshape(-1, n) + p["c"][:, None]
        h = np.maximum(top, 0)
        return at.reshape(-1, n), top, h, p["v"] @ h + p["d"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(self._inside(x[i : i + 256]))[-1] for i in range(0, len(x), 256)]) if len(x) else np.empty(0)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the mean weighed loss of these rows (``_inside`` applied); it goes to the position of the maximum of each filter."""
        p, s = self.p, self.size
        at, top, h, z = self._forward(x)
        filters, n = top.shape
        dz = ((1 / (1 + np.exp(-z)) - y) * weight / n).astype(np.float32)
        dh = dz * p["v"][:, None] * (top > 0)
        g = {"v": h @ dz, "d": dz.sum(keepdims=True), "c": dh.sum(1)}
        where = x[np.arange(n)[:, None], at[:, :, None] + np.arange(s)]  # filters, rows, size
        g["w"] = (dh[:, None] @ p["e"][where].reshape(filters, n, -1))[:, 0].T
        # what each class gets at each place of each filter, summed before it goes through the filter's weights
        cell = (where * s + np.arange(s)) * filters + np.arange(filters)[:, None, None]
        got = np.bincount(cell.ravel(), np.repeat(dh.ravel(), s), len(p["e"]) * s * filters).astype(np.float32)
        g["e"] = got.reshape(-1, s * filters) @ p["w"].reshape(s, -1, filters).transpose(0, 2, 1).reshape(s * filters, -1)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 5e-3, seed: int = 7) -> None:
        r, moments, step = np.random.default_rng(seed), self.moments(), 0
        for _ in range(epochs):
            step = self.epoch(x, y, r.permutation(len(x)), moments, step, (int(y.sum()), int((1 - y).sum())), rate)

    def moments(self) -> tuple[dict, dict]:
        return {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}

    def epoch(self, x: np.ndarray, y: np.ndarray, order: np.ndarray, moments: tuple[dict, dict], step: int, sizes: tuple[int, int], rate: float = 5e-3) -> int:
        """Every example once, in this order, weighed by the numbers of both labels; Adam goes on from ``moments`` and ``step``."""
        (m, q), x, n = moments, self._inside(x), sum(sizes)
        weight = np.where(y > 0, n / (2 * max(sizes[0], 1)), n / (2 * max(sizes[1], 1))).astype(np.float32)
        # one vector of all weights, and one of each moment; the weights by name are views of theirs
        flat, m1, m2 = (np.concatenate([part[k].ravel() for k in self.p]) for part in (self.p, m, q))
        cuts, shapes = np.cumsum([v.size for v in self.p.values()])[:-1], {k: v.shape for k, v in self.p.items()}
        named = lambda v: {k: part.reshape(shapes[k]) for k, part in zip(shapes, np.split(v, cuts), strict=True)}
        self.p = named(flat)
        for i in range(0, len(x), 64):
            b = order[i : i + 64]
            g = self.gradient(x[b], y[b], weight[b])
            grad = np.concatenate([g[k].ravel() for k in self.p])
            step += 1
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad**2
            flat -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        m.update(named(m1))
        q.update(named(m2))
        return step

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float = RECALL, many: np.ndarray | None = None) -> None:
        """Platt's line, then the highest threshold that keeps ``recall``: fewest false findings of all that do; ``many``: how often each is there."""
        a, b = 1.0, 0.0
        many = np.ones(len(z), np.int64) if many is None else many
        n1, n0 = many[y > 0].sum(), many[y == 0].sum()
        t, share = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), many / many.sum()
        for _ in range(500):
            d = (1 / (1 + np.exp(-(a * z + b))) - t) * share
            a, b = a - 0.1 * float((d * z).sum()), b - 0.1 * float(d.sum())
        self.slope, self.shift = max(a, 1e-3), b
        order = np.argsort(z[y > 0])
        at = np.searchsorted(np.cumsum(many[y > 0][order]), int(math.floor((1 - recall) * n1)), side="right")
        self.threshold = float(max(self.score(z[y > 0][order][at : at + 1])[0], 0.5))

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def _draw(alphabet: str, low: int, high: int):
    return lambda r: "".join(r.choices(alphabet, k=r.randint(low, high)))


_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
_MIXED = string.ascii_letters + _DIGITS
_word, _mixed = _draw(_LOWER, 3, 9), _draw(_MIXED, 16, 48)
_number = _draw(_DIGITS, 1, 4)
#: Kinds of keys to draw.
KEYS = {
    "mixed": _mixed,
    "base64": lambda r: _draw(_MIXED + "+/", 20, 60)(r) + "=" * r.randint(0, 2),
    "base32": _draw(_UPPER + "234567", 16, 40),
    "hex": lambda r: _draw(_DIGITS + r.choice(("abcdef", "ABCDEF")), 20, 64)(r),
    "prefixed": lambda r: _draw(_LOWER, 2, 4)(r) + r.choice("_-") + _mixed(r),
    "segments": lambda r: ".".join(_draw(_MIXED + "_-", 12, 40)(r) for _ in range(3)),
}
#: What has the characters of a key and isn't one.
PLAIN = {
    "digits": _draw(_DIGITS, 12, 19),
    "address": lambda r: ".".join(str(r.randrange(256)) for _ in range(4)),
    "host": lambda r: ".".join([_word(r) + _number(r), *(_word(r) for _ in range(r.randint(1, 3)))]),
    "path": lambda r: "/".join([*(_word(r) for _ in range(r.randint(3, 6))), _word(r) + _number(r) + ".txt"]),
    "camel": lambda r: "".join(_word(r).capitalize() for _ in range(r.randint(4, 7))) + r.choice(("", _number(r))),
    "snake": lambda r: r.choice("_-.").join([*(_word(r) for _ in range(r.randint(4, 7))), _number(r)]),
    "version": lambda r: _word(r) + "-" + ".".join(_number(r) for _ in range(r.randint(3, 5))),
    "time": lambda r: f"{r.randint(1900, 2100)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randrange(24):02}.{r.randrange(60):02}",
    "rule": lambda r: r.choice("-=_.x") * r.randint(24, 70),
    "words": lambda r: "".join(_word(r) for _ in range(r.randint(4, 8))),
    "equation": lambda r: "=".join(_word(r) + _number(r) for _ in range(r.randint(3, 5))),
}
#: What a key word is masked with, and what may stand before a drawn value.
_NEUTRAL = ("value", "entry", "item", "code", "name", "field")
_BEFORE = ("", "", "", " ", " (", ' "', " '", ": ", "= ", " <", "id ", "use ", "key ", "bearer ", "auth ")


def half_of(doc_id: int | None) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) & 1


def _masked(kind: int, left: str, value: str, r: random.Random) -> tuple[str, str]:
    """Surroundings and value of a pattern hit without what the pattern goes by."""
    if kind == 0:
        left = re.sub(r"(?i)[a-z_]*(?:password|passwd|secret|token|api_?key)", lambda _: r.choice(_NEUTRAL), left)
    if kind == 1:
        value = _draw(_UPPER, 4, 4)(r) + value[4:]
    return left, value


def _own_examples(doc_id: int | None, text: str) -> list[tuple[int, str, str, str]]:
    """Sort, before, value and after: sort 1 masked pattern hits, 0 other candidates, 2 bare surroundings."""
    found, r, base = [], random.Random(f"secrets {doc_id}"), base_spans(text)
    around = lambda a, b: (text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT])
    show = lambda a, b: text[a:b] if b - a <= VALUE else text[a : a + VALUE // 2] + text[b - VALUE // 2 : b]
    for s, kind, e in base:
        a = ASSIGN.match(text, s, e).start(2) if kind == 0 else s
        left, value = _masked(0 if ASSIGN.search(text[max(0, a - CONTEXT) : e]) else kind, around(a, e)[0], show(a, e), r)
        found.append((1, left, value, around(a, e)[1]))
    found += [(0, around(a, b)[0], show(a, b), around(a, b)[1]) for a, b in candidates(text, base)]
    head = text[:20_000]
    gaps = head.count(" ")
    k = r.randrange(gaps or 1)
    at = len(head) - len(head.split(" ", k + 1)[-1]) - 1 if gaps else len(text)
    return [*found, (2, around(at, at)[0], "", around(at, at)[1])]


def gathered(docs: DataFrame, sample: int = SAMPLE, examples: int = EXAMPLES) -> list:
    """A look at some examples, for trials on the driver (``fit`` takes all): rows (half, sort, before, value, after)."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("secrets"), F.col("doc_id")), F.lit(1 << 30))
    some = docs.filter(F.coalesce(draw, F.lit(0)) < F.lit(min(1.0, sample / max(n, 1)) * (1 << 30)))

    def work(rows: dict) -> dict:
        found = [(half_of(i), *x) for i, t in zip(rows["doc_id"], rows["text"], strict=True) for x in _own_examples(i, t or "")]
        return dict(zip(("half", "sort", "before", "value", "after"), map(list, zip(*found, strict=True)), strict=True)) if found else {k: [] for k in ("half", "sort", "before", "value", "after")}

    rows = map_rows(some, ["doc_id", "text"], "half int, sort int, before string, value string, after string", work).distinct()
    got = []
    for half in (0, 1):
        for sort in (0, 1, 2):
            got += rows.filter((F.col("half") == half) & (F.col("sort") == sort)).orderBy(F.xxhash64("before", "value", "after"), "value", "before", "after").limit(examples).collect()
    return [tuple(r) for r in got]


def _set_in(r: random.Random, left: str, right: str, value: str) -> tuple[str, str, str]:
    """A drawn value in its surroundings."""
    before = r.choice(_BEFORE)
    after = {"(": ")", '"': '"', "'": "'", "<": ">"}.get(before[-1:], r.choice(("", " ", ".", ",")))
    return (left + " " + before)[-CONTEXT:], value, (after + " " + right.lstrip())[:CONTEXT]


def training(rows: list, half: int, examples: int = EXAMPLES, keys: dict = KEYS, plain: dict = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Encoded examples of one half and their labels: gathered ones, and as many drawn ones as there is room for."""
    r = random.Random(f"draw {half}")
    mine = [x for x in rows if x[0] == half]
    places = [(x[2], x[4]) for x in mine if x[1] == 2] or [("", "")]
    out = [(x[1], *x[2:]) for x in mine if x[1] < 2]
    for label, kinds in ((1, keys), (0, plain)):
        have = sum(x[0] == label for x in out)
        for i in range(max(examples - have, examples // 2)):
            left, right = r.choice(places)
            out.append((label, *_set_in(r, left, right, list(kinds.values())[i % len(kinds)](r))))
    out = sorted(set(out), key=lambda x: hashlib.md5("|".join(map(str, x)).encode("utf-8", "replace")).digest())
    x = np.array([encode(a + v + b, len(a), len(a) + len(v)) for _, a, v, b in out])
    return x, np.array([y for y, *_ in out], np.float32)


def train(x: np.ndarray, y: np.ndarray) -> Network:
    net = Network()
    held = np.arange(len(y)) % 4 == 3
    net.train(x[~held], y[~held], epochs=15)
    net.calibrate(net.logits(x[held]), y[held])
    return net


def draws(docs: DataFrame, examples: int = EXAMPLES) -> tuple[int, int]:
    """By half: how many examples of each label a document has to have drawn, so that a half has enough; copies are one document."""
    half = F.coalesce(crc_mod("doc_id", 2), F.lit(0)).alias("half")
    found = docs.select(half, F.xxhash64("doc_id", "text").alias("h")).distinct().groupBy("half").count().collect()
    many = {r["half"]: r["count"] for r in found}
    return tuple(-(-examples // many.get(k, 1)) for k in (0, 1))


def examples_of(docs: DataFrame, drawn: tuple[int, int]) -> DataFrame:
    """half, label, x (classes, a byte each) and h (a hash) of every example of every document, equal ones once; ``drawn``: of each label a document, by half."""

    def work(rows: dict) -> dict:
        out = {"half": [], "label": [], "x": []}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            *found, (_, left, _, right) = _own_examples(doc_id, text or "")
            r = random.Random(f"draw {doc_id}")
            for label, kinds in ((1, KEYS), (0, PLAIN)):
                found += [(label, *_set_in(r, left, right, r.choice(list(kinds.values()))(r))) for _ in range(drawn[half_of(doc_id)])]
            for label, a, v, b in found:
                out["half"].append(half_of(doc_id))
                out["label"].append(label)
                out["x"].append(encode(a + v + b, len(a), len(a) + len(v)).astype(np.uint8).tobytes())
        return out

    return map_rows(docs, ["doc_id", "text"], "half int, label int, x binary", work, rows=200).distinct().withColumn("h", F.xxhash64("label", "x"))


def _numbers(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, LENGTH).astype(np.int64)


def _round(shards: DataFrame, state: dict, number: int, sizes: dict) -> dict:
    """One round: by half the weights and moments that every shard reaches from the common ones, and their mean; steps are those of the longest shard."""
    sent = shards.sparkSession.sparkContext.broadcast(state)
    names, kinds = ["half", "shards", "steps", "sums"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def work(batches):
        sums = {}
        for batch in batches:
            for half, shard, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                net, (weights, *moments, step) = Network(), sent.value[half]
                net.p, moments = {k: v.copy() for k, v in weights.items()}, tuple(dict(m) for m in moments)
                labels = np.frombuffer(y, np.uint8).astype(np.float32)
                order = np.random.default_rng((7, number, shard)).permutation(len(labels))
                step = net.epoch(_numbers([x]), labels, order, moments, step, sizes[half])
                flat = np.concatenate([part[k].ravel() for part in (net.p, *moments) for k in net.p])
                n, most, total = sums.get(half, (0, 0, 0))
                sums[half] = n + 1, max(most, step), total + np.rint(flat.astype(np.float64) * _POINT).astype(np.int64)
        for half, (n, most, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((half, n, most, total.tobytes()), kinds, strict=True)], names=names)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("sums"))
        row = table.column("half")[0].as_py(), sum(table.column("shards").to_pylist()), max(table.column("steps").to_pylist()), total.tobytes()
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    schema, out = "half int, shards long, steps long, sums binary", dict(state)
    for r in shards.mapInArrow(work, schema).groupBy("half").applyInArrow(add, schema).collect():  # two rows
        mean, parts, at = np.frombuffer(r["sums"], np.int64) / (r["shards"] * _POINT), [], 0
        for _ in range(3):
            part = {}
            for k, v in state[r["half"]][0].items():
                part[k] = mean[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
            parts.append(part)
        out[r["half"]] = *parts, r["steps"]
    return out


def fit(docs: DataFrame, examples: int = EXAMPLES) -> tuple[Network, Network]:
    """The networks for documents of the first and of the second half; each has learned from all of the other half."""
    every = cut(examples_of(docs, draws(docs, examples)))
    held = F.pmod("h", F.lit(4)) == 3
    found = {(r["half"], r["label"]): r["count"] for r in every.filter(~held).groupBy("half", "label").count().collect()}
    sizes = {half: (found.get((half, 1), 0), found.get((half, 0), 0)) for half in (0, 1)}
    many = [max(1, sum(sizes[half]) // SHARD) for half in (0, 1)]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("x", "ascending"), ("label", "ascending")])
        row = table.column("half")[0].as_py(), table.column("shard")[0].as_py(), b"".join(table.column("x").to_pylist()), bytes(table.column("label").to_pylist())
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["half", "shard", "x", "y"])

    dealt = every.filter(~held).withColumn("shard", F.pmod(F.shiftright("h", 2), F.when(F.col("half") == 0, F.lit(many[0])).otherwise(F.lit(many[1])).cast("long")))
    shards = cut(dealt.repartition(min(sum(many), 1024), "half", "shard").groupBy("half", "shard").applyInArrow(pack, "half int, shard long, x binary, y binary"))
    state = {half: (Network().p, *Network().moments(), 0) for half in (0, 1)}
    for number in range(ROUNDS):
        state = _round(shards, state, number, sizes)
    nets = [Network(), Network()]
    for half, net in enumerate(nets):
        net.p = state[half][0]
    sent = docs.sparkSession.sparkContext.broadcast(nets)

    def logits(rows: dict) -> dict:
        z, half = np.empty(len(rows["x"])), np.array(rows["half"])
        for k, net in enumerate(sent.value):
            if (half == k).any():
                z[half == k] = net.logits(_numbers([x for x, own in zip(rows["x"], rows["half"], strict=True) if own == k]))
        return {"half": rows["half"], "label": rows["label"], "z": np.floor(np.clip(z, -40, 40) * STEPS).astype(int).tolist()}

    counts = map_rows(every.filter(held), ["half", "label", "x"], "half int, label int, z int", logits).groupBy("half", "label", "z").count().orderBy("half", "label", "z").collect()  # at most 81,924 rows
    for half, net in enumerate(nets):
        mine = [r for r in counts if r["half"] == half]
        if mine:
            net.calibrate(np.array([r["z"] for r in mine]) / STEPS, np.array([r["label"] for r in mine], np.float32), many=np.array([r["count"] for r in mine]))
        else:  # no documents of that half to learn from
            nets[half] = train(*training([], half, examples))
    return nets[1], nets[0]


def find(text: str, net: Network) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings of one text, by start and kind."""
    base = base_spans(text)
    more = candidates(text, base)
    if more:
        scores = net.score(net.logits(np.array([encode(text, a, b) for a, b in more])))
        base = sorted(base + [(a, 3, b) for (a, b), s in zip(more, scores, strict=True) if s >= net.threshold])
    return base


def scan(docs: DataFrame, nets: tuple[Network, Network]) -> DataFrame:
    """doc_id and findings: array<struct<kind, start, end>> of every row, by start, then kind."""
    sent, key = docs.sparkSession.sparkContext.broadcast(nets), fresh("secrets")

    def work(rows: dict) -> dict:
        own = per_worker(key, lambda: sent.value)
        return {"doc_id": rows["doc_id"], "findings": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t or "", own[half_of(i)])] for i, t in zip(rows["doc_id"], rows["text"], strict=True)]}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, findings array<struct<kind: string, start: long, end: long>>", work)
