"""Language identification by prediction by partial matching (PPM) with frozen statistics.

Each language has a variable-order byte context tree: counts of every byte after
each context of up to ``ORDER`` bytes, gathered from a bounded sample of labelled
texts.  A byte seen in its longest known context costs its share (method C: n
seen, q distinct, share n_i / (n + q)); else the context's escape probability is
paid and the next shorter context asked, among the bytes that the longer one
hasn't seen (exclusion, so probabilities sum to one), down to a uniform byte.  The
code length of a text in bits is exact under these frozen counts.  Contexts start
at the space before a word, so a word's code length doesn't depend on the words
before it, and each worker computes it once.  Words are those between ASCII white
space of the lower-cased text.

The language with the shortest code wins.  ``score`` is its share in a softmax of
the code lengths per square root of the bytes, at a temperature fitted on a fifth
of the sample that the trees didn't see.

Bounded sample: at most about ``PER_LANGUAGE`` documents of each language, chosen
by a hash of the id.  Executors count its words; the driver gets counts of distinct
words and code lengths of the held-out fifth, no texts.  Everything is scored.

Cases.  Null text, or text without a letter: ``und`` with score 0, as is every
text if nothing is labelled.  Repeated rows repeat.  Null labels aren't learned.
Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filter_rows, fresh, map_rows, per_worker

ORDER = 4
PER_LANGUAGE = 1500
_letter = re.compile(r"[^\W\d_]").search


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").split()


def _positions(words: list[bytes], order: int = ORDER):
    """Of all words, each within spaces: bytes to code as keys of each order, how many context bytes each has, and its word."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(data)) - np.repeat(begins, sizes)
    keep = np.flatnonzero(within > 0)
    keys = [data[keep]]
    for k in range(1, order + 1):
        before = data[np.maximum(keep - k, 0)]
        keys.append(keys[-1] + (before << np.uint64(8 * k)))
    return keys, np.minimum(within[keep], order), word[keep]


class Tree:
    """One language: by order, sorted keys (context and byte) with their cost in bits, sorted contexts with what an escape costs."""

    def __init__(self, counts: Counter, order: int = ORDER):
        words = list(counts)
        keys, depth, word = _positions(words, order)
        weight = np.array([counts[w] for w in words], float)[word] if words else np.empty(0)
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(order + 1):
            on = depth >= k
            seen, at = np.unique(keys[k][on], return_inverse=True)
            n = np.bincount(at, weight[on], len(seen))
            context = seen >> np.uint64(8)
            known, group = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(group, n, len(known)), np.bincount(group, minlength=len(known))
            # what the shorter context gives to the bytes seen here is excluded after an escape
            drop = np.uint64((1 << 8 * k) - 1) if k else np.uint64(255)
            below = 2.0 ** -self.bits(seen & drop, k - 1) if k else np.full(len(seen), 1 / 256)
            left = np.maximum(1 - np.bincount(group, below, len(known)), 1e-9)
            self.keys.append(seen)
            self.cost.append(-np.log2(n / (total + kinds)[group]) if len(seen) else n)
            self.contexts.append(known)
            self.escape.append(-np.log2(kinds / (total + kinds)) + np.log2(left) if len(known) else total)

    def escapes(self, contexts: np.ndarray, k: int) -> np.ndarray:
        """What an escape from these contexts of order k costs; nothing where a context is unknown."""
        out = np.zeros(len(contexts))
        if len(self.contexts[k]):
            at = np.minimum(np.searchsorted(self.contexts[k], contexts), len(self.contexts[k]) - 1)
            hit = self.contexts[k][at] == contexts
            out[hit] = self.escape[k][at[hit]]
        return out

    def bits(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code length of each key (context of k bytes, then the byte)."""
        if k < 0:
            return np.full(len(keys), 8.0)
        out = np.empty(len(keys))
        table = self.keys[k]
        at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
        hit = table[at] == keys if len(table) else np.zeros(len(keys), bool)
        out[hit] = self.cost[k][at[hit]]
        miss = ~hit
        if miss.any():
            rest = keys[miss]
            shorter = rest & np.uint64((1 << 8 * max(k, 1)) - 1)
            out[miss] = self.escapes(rest >> np.uint64(8), k) + self.bits(shorter, k - 1)
        return out


class Model:
    """All languages side by side: one lookup gives the costs in every language."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        """counts: how often each word (bytes) occurs in a language."""
        self.languages = sorted(counts)
        self.order = order
        self.temperature = 1.0
        trees = [Tree(counts[g], order) for g in self.languages]
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([t.keys[k] for t in trees])) if trees else np.empty(0, np.uint64)
            contexts = np.unique(np.concatenate([t.contexts[k] for t in trees])) if trees else np.empty(0, np.uint64)
            self.keys.append(keys)
            self.cost.append(np.stack([t.bits(keys, k) for t in trees], 1).astype(np.float32) if trees else np.empty((0, 0)))
            self.contexts.append(contexts)
            self.escape.append(np.stack([t.escapes(contexts, k) for t in trees], 1).astype(np.float32) if trees else np.empty((0, 0)))

    def calibrate(self, held: list[tuple[str, list[float]]]) -> None:
        """held: language and scaled code lengths (``scaled``) of texts that the trees didn't see."""
        known = [(self.languages.index(g), z) for g, z in held if g in self.languages]
        if known and len(self.languages) > 1:
            table, truth = np.array([z for _, z in known]), np.array([j for j, _ in known], int)
            self.temperature = float(min(2.0 ** np.arange(-8, 5, 0.5), key=lambda x: self._loss(table * x, truth)))

    @staticmethod
    def _loss(z: np.ndarray, truth: np.ndarray) -> float:
        z = z - z.max(1, keepdims=True)
        p = np.exp(z[np.arange(len(z)), truth]) / np.exp(z).sum(1)
        return float(-np.log(np.maximum(p, 1e-12)).mean()) if len(z) else 0.0

    def word_bits(self, words: list[bytes], at_once: int = 4096) -> np.ndarray:
        """Code length of each word in each language; few at once, as each of their bytes takes five keys."""
        if len(words) > at_once:
            return np.concatenate([self.word_bits(words[i : i + at_once]) for i in range(0, len(words), at_once)])
        keys, depth, word = _positions(words, self.order)
        out = np.zeros((len(keys[0]), len(self.languages)), np.float32)
        open_ = np.arange(len(out))
        for k in range(self.order, -1, -1):
            on = open_[depth[open_] >= k]
            if not len(on) or not len(self.keys[k]):
                continue
            ask = keys[k][on]
            at = np.minimum(np.searchsorted(self.keys[k], ask), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == ask
            out[on[hit]] += self.cost[k][at[hit]]
            miss = on[~hit]
            context = ask[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context
            out[miss[known]] += self.escape[k][at[known]]
            done = np.zeros(len(out), bool)
            done[on[hit]] = True
            open_ = open_[~done[open_]]
        out[open_] += 8
        return np.stack([np.bincount(word, out[:, j], len(words)) for j in range(out.shape[1])], 1)

    def scaled(self, text: str) -> np.ndarray:
        words = _words(text)
        bits = self.word_bits(words).sum(0) if words else np.zeros(len(self.languages))
        return -bits / np.sqrt(sum(map(len, words)) + len(words) + 1)


class Scorer:
    """A model and the words that a worker has met."""

    #: Words remembered; none beyond so many bytes outlasts its batch.
    REMEMBER, LONGEST = 150_000, 4096

    def __init__(self, model: Model):
        self.model = model
        scorer = self

        class Ids(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = out = len(self)
                scorer.new.append(word)
                scorer.long |= len(word) > scorer.LONGEST
                return out

        self.long = False  # a very long word is there: forget all after this call
        self.ids, self.new, self.bits = Ids(), [], np.empty((0, len(model.languages)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        if len(self.ids) > self.REMEMBER or self.long:
            self.ids.clear()
            self.bits, self.long = self.bits[:0], False
        found = []
        for text in texts:
            if text is None or not model.languages or not _letter(text):
                found.append(None)
                continue
            words = _words(text)
            found.append((np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)), sum(map(len, words)) + len(words) + 1))
        if self.new:
            self.bits = np.concatenate([self.bits, model.word_bits(self.new)])
            self.new = []
        names, scores = [], []
        for x in found:
            if x is None:
                names.append("und")
                scores.append(0.0)
                continue
            z = -self.bits[x[0]].sum(0) / np.sqrt(x[1]) * model.temperature
            j = int(np.argmax(z))
            names.append(model.languages[j])
            scores.append(float(1 / np.exp(z - z[j]).sum()))
        return names, scores


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled rows (text, lang); reads all labels, keeps a bounded sample of texts."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")) * F.lit(float(1 << 30))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30))
    taken = rows.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang").filter(draw < share)
    # a language with few texts needs them all
    apart = (F.pmod(F.xxhash64(F.lit("temperature"), F.col("doc_id"), F.col("text")), F.lit(5)) == 0) & (F.col("n") >= 10)
    taken = taken.select("lang", "text", apart.alias("apart"))

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(_words(text))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    words = taken.filter("not apart").select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = words.orderBy("lang", "word").toArrow()
    samples: dict[str, Counter] = {}
    for batch in got.to_batches(max_chunksize=10_000):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            samples.setdefault(lang, Counter())[word] = n
    del got
    model = Model(samples)
    del samples
    sent, key = docs.sparkSession.sparkContext.broadcast(model), fresh("langid-fit")

    def lengths(rows: dict) -> dict:
        own = per_worker(key, lambda: sent.value)
        return {"lang": rows["lang"], "z": [own.scaled(t).tolist() if _letter(t) else [] for t in rows["text"]]}

    held = map_rows(taken.filter("apart"), ["lang", "text"], "lang string, z array<double>", lengths).collect()
    model.calibrate([(r["lang"], r["z"]) for r in held if r["z"]])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), fresh("langid")

    def work(rows: dict) -> dict:
        scorer = per_worker(key, lambda: Scorer(sent.value))
        names, scores = scorer.score(rows["text"])
        return {"doc_id": rows["doc_id"], "lang_pred": names, "score": scores}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", work, rows=500)


def keep(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in some language with a share of at least ``least``."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), fresh("langid")

    def decide(texts: list) -> list[bool]:
        names, scores = per_worker(key, lambda: Scorer(sent.value)).score(texts)
        return [n != "und" and s >= least for n, s in zip(names, scores, strict=True)]

    return filter_rows(docs, text, decide, rows=500)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from every fold but ``held``, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(crc_mod("doc_id", folds) != held))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
