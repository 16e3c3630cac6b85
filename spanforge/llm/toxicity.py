"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Features are the words and the five-letter beginnings of longer ones, so that
inflected forms count.  A bounded sample of labelled rows is split by a hash of the
id.  From three quarters come the examples, at most a third of them with the
label where there are others, and the weights of all features that any example
has: inverse document frequency times relevance, which grows from ``LEAST`` to 1
with the evidence (log-likelihood ratio beyond ``CHANCE``, in units of ``NATS``) that a feature comes
with the label.  No feature is left out.  Examples are unit vectors in a block-max
inverted index: postings by term and block of ``BLOCK`` examples (of terms that more
than one example in twenty has, a table of the block), and each term's largest
weight in each block.  A query's bound for a block is the sum of its
weights times these maxima; blocks are visited by falling bound until the bound is
below the k-th similarity found, so the ``k`` nearest are exact.  Each votes with
its similarity.  The last quarter of the sample, which took part in nothing so
far, calibrates votes by isotonic regression.

Plain inverse document frequency can't do it: in invented prose most words are
rare, and the nearest texts are those that share some (area under the curve 0.95,
0.61 of toxic documents found at half a per cent of false ones, on check_s with
6,000 examples; with relevance and 2,000 examples 1.000 and all, on 2,500 others).

Bounded sample: about ``SAMPLE`` labelled rows by a hash of the id, ``EXAMPLES`` of
them in the index.  Labels, ids, sources and languages are no input of a score.

Cases.  Null text is empty; texts without known features get the label's share in
the sample, 0.25 when nothing is labelled.  Repeated rows repeat.  Rows without a
label or an id aren't learned; ids that repeat are learned as often.  Ties between
examples go to the smaller id.  Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, filter_rows, fresh, map_rows, per_worker

SAMPLE = 20_000
EXAMPLES = 2_000
NEIGHBOURS = 15
BLOCK = 64
#: Relevance of a feature that says nothing, evidence that may be chance, and evidence beyond it that counts as much as 1 - 1/e of all.
LEAST, CHANCE, NATS = 0.02, 5.0, 20.0
BEGINNING = 5
_words = re.compile(r"\w+").findall


def word_features(unit: str) -> list[str]:
    """Features of what stands between white space, lower-cased; '=' marks a whole word."""
    return [f for w in _words(unit) for f in (["=" + w, w[:BEGINNING]] if len(w) > BEGINNING else ["=" + w])]


def text_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for unit, n in Counter((text or "").lower().split()).items():
        for f in word_features(unit):
            out[f] += n
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Block-max inverted index of unit vectors given as rows (id, label, terms, weights)."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]], n_terms: int):
        often = np.bincount(np.concatenate([r[2] for r in rows]), minlength=n_terms) >= max(2, len(rows) / 20) if rows else np.zeros(n_terms, bool)

        def alike(r):  # examples that share their heaviest common term share blocks
            at = np.flatnonzero(often[r[2]])
            return (int(r[2][at[np.argmax(r[3][at])]]) if len(at) else -1, r[0])

        rows = sorted(rows, key=alike)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], float)
        self.n_blocks = -(-len(rows) // BLOCK)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        term = np.concatenate([r[2] for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
        row, weight = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[3] for r in rows]) if rows else np.empty(0)
        order = np.lexsort((row, term))
        term, self.row, self.weight = term[order], row[order], weight[order]
        # postings of common terms as a table of each block
        self.slot = np.where(often, np.cumsum(often) - 1, -1)
        self.table = np.zeros((self.n_blocks, int(often.sum()), BLOCK), np.float32)
        on = often[term] if len(term) else np.empty(0, bool)
        self.table[self.row[on] // BLOCK, self.slot[term[on]], self.row[on] % BLOCK] = self.weight[on]
        self.table_most = self.table.max(2).T.astype(np.float64) if self.n_blocks else np.zeros((0, 0))
        # of the others cells: the postings of one term in one block
        term, self.row, self.weight = term[~on], self.row[~on], self.weight[~on]
        cell = term * max(self.n_blocks, 1) + self.row // BLOCK
        self.cell_start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_size = np.diff(np.append(self.cell_start, len(cell)))
        self.cell_block = self.row[self.cell_start] // BLOCK
        self.cell_most = np.maximum.reduceat(self.weight, self.cell_start) if len(cell) else np.empty(0)
        self.term_start = np.searchsorted(term[self.cell_start], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k most similar examples, exact, of those with any similarity."""
        none = np.empty(0, np.int64), np.empty(0)
        if not self.n_blocks or not len(terms):
            return none
        slot = self.slot[terms]
        slots, w = slot[slot >= 0], weights[slot >= 0]
        first = self.term_start[terms]
        many = self.term_start[terms + 1] - first
        cells, own = _ranges(first, many), np.repeat(weights, many)
        block = self.cell_block[cells]
        bound = np.bincount(block, own * self.cell_most[cells], self.n_blocks) + w @ self.table_most.take(slots, 0)
        w = w.astype(np.float32)
        scores, kth, left, step = np.zeros(self.n_blocks * BLOCK), 0.0, np.argsort(-bound, kind="stable"), 4
        while len(left := left[(bound[left] > 0) & (bound[left] >= kth - 1e-6)]):
            now, left, step = left[:step], left[step:], self.n_blocks
            for b in now.tolist():
                scores[b * BLOCK : (b + 1) * BLOCK] = w @ self.table[b].take(slots, 0)
            chosen = np.zeros(self.n_blocks, bool)
            chosen[now] = True
            on = chosen[block]
            c = cells[on]
            at = _ranges(self.cell_start[c], self.cell_size[c])
            scores += np.bincount(self.row[at], np.repeat(own[on], self.cell_size[c]) * self.weight[at], len(scores))
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = np.flatnonzero((scores > 0) & (scores >= kth))
        found = found[np.lexsort((self.ids[found], -scores[found]))][:k]
        return found, scores[found]


def isotonic(x: list[float], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x: the ends of each pool and its share, smoothed by one vote for either side."""
    at, group = np.unique(np.array(x, float), return_inverse=True)  # equal votes are one pool from the start
    pools: list[list[float]] = []  # first x, last x, sum of y, number
    for a, total, n in zip(at.tolist(), np.bincount(group, y).tolist(), np.bincount(group).tolist(), strict=True):
        pools.append([a, a, total, n])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    shares = np.maximum.accumulate([(p[2] + 1) / (p[3] + 2) for p in pools])
    return np.array([e for p in pools for e in p[:2]]), np.repeat(shares, 2)


class Model:
    """What scoring needs: features of at most ``EXAMPLES`` texts, their weights, the index, the calibration."""

    def __init__(self, terms: dict[str, int], examples: list[tuple[int, int, np.ndarray, np.ndarray]], pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, k: int = NEIGHBOURS):
        """examples: (id, label, terms, occurrences); pos, neg: documents with a term, with the label and without, of ``n_pos`` and ``n_neg``."""
        self.k, self.base = k, (n_pos + 1) / (n_pos + n_neg + 2) if n_pos + n_neg else 0.25
        self.terms, n, share = terms, pos + neg, self.base
        with np.errstate(divide="ignore", invalid="ignore"):
            nats = np.where(pos > 0, pos * np.log(pos / (n * share)), 0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0)
            nats = np.where(pos > n * share, np.maximum(nats, 0), 0)
        self.weight = (np.log((1 + n_pos + n_neg) / (1 + n)) + 1) * (LEAST + (1 - LEAST) * (1 - np.exp(-np.maximum(nats - CHANCE, 0) / NATS)))
        self.index = Index([(e[0], e[1], *self.weighed(e[2], e[3])) for e in examples if len(e[2])], len(terms))
        self.steps, self.shares = np.array([0.0]), np.array([self.base])
        self.sent = None  # the broadcast that has it, once there is one

    def __getstate__(self) -> dict:
        return {**self.__dict__, "sent": None}

    def share_out(self, spark):
        """One broadcast for calibration and scoring; the calibration itself, a few numbers, goes with each job."""
        self.sent = self.sent or (spark.sparkContext.broadcast(self), fresh("toxicity"))
        (sent, key), steps, shares = self.sent, self.steps, self.shares

        def scorer() -> Scorer:
            own = per_worker(key, lambda: Scorer(sent.value))
            own.model.steps, own.model.shares = steps, shares
            return own

        return scorer

    def weighed(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (1 + np.log(times)) * self.weight[terms]
        return terms, raw / max(float(np.sqrt((raw * raw).sum())), 1e-300)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector."""
        return self.weighed(np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts)))

    def vote(self, counts: dict[int, int]) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Similarity-weighted share of the label among the nearest (None without any), and these."""
        rows, near = self.index.nearest(*self.vector(counts), self.k)
        return (float((near * self.index.labels[rows]).sum() / near.sum()) if len(rows) else None), rows, near

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        vote, rows, near = self.vote(counts)
        return self.base if vote is None else float(np.interp(vote, self.steps, self.shares)), rows, near

    def calibrate(self, votes: list[tuple[float | None, int]]) -> None:
        known = [(round(v, 9), y) for v, y in votes if v is not None]
        if known:
            self.steps, self.shares = isotonic([v for v, _ in known], [y for _, y in known])


class Scorer:
    """A model and the words that a worker has met."""

    #: Words remembered, and the longest of them: some 40 MB at most.
    REMEMBER, LONGEST = 200_000, 48

    def __init__(self, model: Model):
        self.model = model
        known, longest = model.terms, self.LONGEST

        class Units(dict):
            """What stands between white space: the known features it has."""

            def __missing__(self, unit: str):
                out = tuple(known[f] for f in word_features(unit) if f in known)
                if len(unit) <= longest:
                    self[unit] = out
                return out

        self.units = Units()

    def counts(self, text: str | None) -> dict[int, int]:
        if len(self.units) > self.REMEMBER:
            self.units.clear()
        out: dict[int, int] = {}
        for unit, n in Counter((text or "").lower().split()).items():
            for t in self.units[unit]:
                out[t] = out.get(t, 0) + n
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """A model from rows (doc_id, text, label); about ``sample`` of them are used, ``examples`` of these as neighbours."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 30))
    taken = rows.filter(draw < F.lit(min(1.0, sample / max(n, 1)) * (1 << 30)))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(4))
    taken = cut(taken.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("label") > 0).cast("int").alias("label"), part.alias("part")))
    learn = taken.filter("part > 0")
    sizes = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    take_pos = min(n_pos, max(examples // 3, examples - n_neg))
    chosen = [learn.filter(F.col("label") == y).orderBy(F.xxhash64(F.lit("example"), "doc_id", "text"), "doc_id").limit(m) for y, m in ((1, take_pos), (0, examples - take_pos))]

    def features(rows: dict) -> dict:
        found = [text_features(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "label": rows["label"], "names": [list(c) for c in found], "times": [list(c.values()) for c in found]}

    got = map_rows(chosen[0].unionByName(chosen[1]), ["doc_id", "label", "text"], "doc_id long, label int, names array<string>, times array<int>", features).toArrow()
    terms: dict[str, int] = {}
    picked = []
    for i in np.lexsort((got.column("label").to_numpy(), got.column("doc_id").to_numpy())).tolist():
        doc_id, label, names, times = (got.column(c)[i] for c in ("doc_id", "label", "names", "times"))
        of = np.array([terms.setdefault(f, len(terms)) for f in names.as_py()], np.int32)
        picked.append((doc_id.as_py(), label.as_py(), of, np.array(times.as_py(), np.int32)))
    del got
    asked = spark.sparkContext.broadcast(list(terms))

    def count(batches):
        known, both = {f: i for i, f in enumerate(asked.value)}, (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[label].update(known[f] for f in text_features(text) if f in known)
        numbers = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(pa.array([both[y][x] for x in numbers], pa.int64()) for y in (1, 0))], names=["term", "pos", "neg"])

    sums = learn.select("text", "label").mapInArrow(count, "term int, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    asked.unpersist()
    pos, neg = np.zeros(len(terms)), np.zeros(len(terms))
    at = sums.column("term").to_numpy()
    pos[at], neg[at] = sums.column("pos").to_numpy(), sums.column("neg").to_numpy()
    model = Model(terms, picked, pos, neg, n_pos, n_neg, k)
    scorer_of = model.share_out(spark)

    def votes(rows: dict) -> dict:
        scorer = scorer_of()
        return {"vote": [scorer.model.vote(scorer.counts(t))[0] for t in rows["text"]], "label": rows["label"]}

    model.calibrate([tuple(r) for r in map_rows(taken.filter("part = 0"), ["text", "label"], "vote double, label int", votes).collect()])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (similarity, doc_id and label of the nearest examples) for every row."""
    scorer_of = model.share_out(docs.sparkSession)

    def work(rows: dict) -> dict:
        scorer = scorer_of()
        scores, evidence = [], []
        index = scorer.model.index
        for text in rows["text"]:
            score, found, near = scorer.model.score(scorer.counts(text))
            scores.append(score)
            evidence.append([{"similarity": float(s), "doc_id": int(index.ids[r]), "label": int(index.labels[r])} for s, r in zip(near[:5], found[:5], strict=True)])
        return {"doc_id": rows["doc_id"], "score": scores, "evidence": evidence}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double, evidence array<struct<similarity: double, doc_id: long, label: int>>", work)


def keep(docs: DataFrame, model: Model, below: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score less than ``below``."""
    scorer_of = model.share_out(docs.sparkSession)

    def decide(texts: list) -> list[bool]:
        scorer = scorer_of()
        return [scorer.model.score(scorer.counts(t))[0] < below for t in texts]

    return filter_rows(docs, text, decide)


def labelled(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Rows (doc_id, text, label) of every fold but ``held``; one label an id, the larger if they differ."""
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter(F.col("label").isNotNull() & (crc_mod("doc_id", folds) != held))
    return docs.select("doc_id", "text").join(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of ``docs``."""
    found = predict(docs, fit(labelled(docs, labels, folds, held)))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
