"""Language-model scores by a hierarchical Pitman-Yor process.

Restaurants form a tree of three levels.  A leaf is the word before: every word of
the vocabulary has one of its own, and so has the start of a text.  The leaves of
words with the same last two bytes are a class and share the class's restaurant as
parent, the classes (``CLASSES`` endings that bytes can form) share the root, whose
base is uniform over the vocabulary and one unknown word.  Customers are all training
tokens, dishes all their words, contexts all words: all grow with the corpus.

Sampling.  A sweep takes the customers of each dish (restaurant and word) up and
seats them anew by the Chinese restaurant process, given everybody else as the
sweep before left them; every table sends a customer to the parent, which is
seated in the same way.  After ``BURN`` sweeps the predictive probabilities of
``KEEP`` sweeps are averaged.  Beyond 16 customers of a dish seating goes by blocks
of an eighth of those seated, so a dish costs the logarithm of its customers; the
mean number of tables stays within two per cent of seating one by one (tested).
Random numbers are a hash of word, restaurant, sweep and step, and what dishes
share, the numbers of tables of each restaurant, is summed exactly between sweeps:
scores don't depend on how the table is partitioned.

Distribution.  Documents are tokenised once into chunks.  A chunk sends the
distinct (word, leaf) pairs that it has, with counts, to the bucket of the word's
hash.  A bucket streams its messages and adds them up, so it holds each of its
dishes once, and of each request the places of its pairs; a word has at most as
many leaves as there are words.  All levels of a dish are in one bucket, so a sweep
needs only the restaurants' totals.  Those of classes and root, some 132,000 numbers
at any size, are summed in executors and broadcast.  Those of leaves grow with the
vocabulary: each leaf has an owner, buckets send owners what they hold of its leaves
(names once, then numbers in the same order), and owners write the sums for each
bucket into the shared folder, from where the bucket reads its own.  Sweeps before
the present one are replayed from these totals instead of being stored.  Buckets
answer with one probability a pair.  Words are compared by 64-bit hashes: about
n^2 / 2^65 colliding pairs among n distinct words; leaves by class and 46 bits.

Cases.  Null text: empty, its end token alone.  Nothing to learn from: every
token has probability one by either formula.  A null id belongs to the training
part.  Repeated rows repeat.  Other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder, small_batches

BURN, KEEP = 1, 2
#: Classes of contexts: the last two bytes, or the only one, and the start of a text.  A leaf is a class and 46 bits of hash.
CLASSES, BITS = 256 * 257 + 1, 46
SPLIT = 1 << BITS
KINDS = CLASSES * SPLIT
_START = KINDS - SPLIT
#: Discount and strength of leaves, classes and root.
LEAF, CLASS, ROOT = (0.8, 1.0), (0.8, 1.0), (0.7, 1.0)
#: Bytes of text in a chunk, tokens for each bucket.
CHUNK, BUCKET = 8_000_000, 600_000
#: Buckets for each owner of leaves.
OWNED = 16
#: What stands for the end of a text: no word has white space.
END = b"\n"
_SLICE = 4096


def _squeeze(a: np.ndarray) -> bytes:
    """Smallest unsigned type that holds the values, byte planes apart, compressed; the first byte says which type."""
    size = next(s for s in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * s)
    raw = np.ascontiguousarray(a, f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()
    return bytes([size]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(b: bytes) -> np.ndarray:
    n, size = int.from_bytes(b[1:9], "little"), b[0]
    if not size:
        return _expand_rising(b[9 : 9 + n])[_expand(b[9 + n :])]
    raw = pa.decompress(b[9:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel()


def _squeeze_names(a: np.ndarray) -> bytes:
    """As ``_squeeze``, for large numbers that come again: each once, then which one it is."""
    names, which = np.unique(np.asarray(a).astype(np.uint64), return_inverse=True)
    head = _squeeze_rising(names)
    return b"\0" + len(head).to_bytes(8, "little") + head + _squeeze(which)


def _squeeze_rising(a: np.ndarray) -> bytes:
    """As ``_squeeze``, for rising uint64 values: their steps are smaller."""
    return _squeeze(np.diff(a, prepend=np.uint64(0)))


def _expand_rising(b: bytes) -> np.ndarray:
    return np.cumsum(_expand(b), dtype=np.uint64)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def class_of(word: bytes) -> int:
    """The class of a word: its last two bytes."""
    return 257 * word[-1] + (word[-2] + 1 if len(word) > 1 else 0)


def leaf(word: bytes, digest: int) -> int:
    """The leaf under which what follows ``word`` is gathered."""
    return class_of(word) * SPLIT + digest % SPLIT


def chunks(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Rows of whole documents: ids of tokens in the chunk's own vocabulary, hashes and classes of its words."""
    names = ["chunk", "doc_ids", "lens", "held", "ids", "hashes", "classes", "n_tokens", "n_train"]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]

    def row(number: int, doc_ids: list, parts: list[np.ndarray], flags: list[bool], vocabulary: _Ids) -> pa.RecordBatch:
        lens, words = np.array([len(p) for p in parts], np.int64), list(vocabulary)
        digests = list(map(xxhash.xxh64_intdigest, words))
        classes = np.fromiter(map(class_of, words), np.uint32, len(words))
        blobs = (_squeeze(lens), np.packbits(flags).tobytes(), _squeeze(np.concatenate(parts)), np.array(digests, np.uint64).tobytes(), _squeeze(classes))
        values = (number, doc_ids, *blobs, int(lens.sum()), int(lens[~np.array(flags, bool)].sum()))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def work(batches):
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        doc_ids, parts, flags, vocabulary = [], [], [], _Ids()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                part = whole.slice(at, 200)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8").lower().split()
                    words.append(END)
                    parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                    doc_ids.append(doc_id)
                    flags.append(doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held)
                    size += len(text or "") + 16
                    if size >= CHUNK:
                        yield row(number, doc_ids, parts, flags, vocabulary)
                        number, size = number + 1, 0
                        doc_ids, parts, flags, vocabulary = [], [], [], _Ids()
        if parts:
            yield row(number, doc_ids, parts, flags, vocabulary)

    schema = "chunk long, doc_ids array<long>, lens binary, held binary, ids binary, hashes binary, classes binary, n_tokens long, n_train long"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


class Pairs:
    """The distinct (word, leaf) pairs of a chunk, words in the order of their hashes."""

    def __init__(self, lens: bytes, held: bytes, ids: bytes, hashes: bytes, classes: bytes):
        self.lens = _expand(lens).astype(np.int64)
        self.held = np.unpackbits(np.frombuffer(held, np.uint8), count=len(self.lens)).astype(bool)
        local, own = _expand(ids), np.frombuffer(hashes, np.uint64)
        self.hashes, rank = np.unique(own, return_inverse=True)
        leaves = (_expand(classes).astype(np.int64) << BITS) + (own & np.uint64(SPLIT - 1)).astype(np.int64)
        kinds, which = np.unique(np.append(leaves, _START), return_inverse=True)
        key = rank[local]
        key *= len(kinds)
        self.starts = np.cumsum(self.lens) - self.lens
        before = np.empty(len(local), np.int32)
        before[1:] = which[:-1].astype(np.int32)[local[:-1]]
        before[self.starts] = which[-1]
        key += before
        keys, self.of_token = np.unique(key, return_inverse=True)
        self.word, self.kind = (keys // len(kinds)).astype(np.int32), kinds[keys % len(kinds)]

    def counts(self) -> np.ndarray:
        """Training tokens of each pair."""
        return np.bincount(self.of_token[np.repeat(~self.held, self.lens)], minlength=len(self.word))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a word; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


# -- seating ------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1), one for each key and step."""
    return (_mix(key + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Successes among n: by inversion, beyond an expected 30 by the normal approximation."""
    out = np.zeros(len(n), np.int64)
    large = n * p > 30
    if large.any():
        z = np.sqrt(-2 * np.log(1 - u[large])) * np.cos(2 * np.pi * u2[large])
        mean = n[large] * p[large]
        out[large] = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - p[large]))), 0, n[large])
    at = np.flatnonzero(~large)
    m, q, v = n[at], p[at], u[at]
    odds, mass = q / np.maximum(1 - q, 1e-300), (1 - q) ** m
    total, k = mass.copy(), 0
    while len(at):
        on = (v >= total) & (k < m)
        at, m, v, odds, mass, total = (x[on] for x in (at, m, v, odds, mass, total))
        mass = mass * odds * (m - k) / (k + 1)
        total, k = total + mass, k + 1
        out[at] = k
    return out


def seat(customers: np.ndarray, open_: np.ndarray, more: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables that the customers of each dish take; ``open_ + more * own tables`` is the weight of a new one."""
    tables = np.minimum(customers, 1).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    c, o, m, k, seated, t, step = customers[at], open_[at], more[at], key[at], 1, np.ones(len(at), np.int64), 0
    while len(at):  # all have the same number seated: blocks depend on it alone
        w = o + m * t
        p = w / (np.maximum(seated - discount * t, 0) + w)
        u = uniform(k, step)
        if seated < 16:
            block = 1
            t = t + (u < p)
        else:
            block = seated // 8
            n = np.minimum(block, c - seated)
            # as in the middle of the block
            t_mid = t + p * (n - 1) / 2
            w = o + m * t_mid
            p = w / (np.maximum(seated + (n - 1) / 2 - discount * t_mid, 0) + w)
            t = t + binomial(n, p, u, uniform(~k, step))
        seated, step = seated + block, step + 1
        on = c > seated
        if not on.all():
            tables[at[~on]] = t[~on]
            at, c, o, m, k, t = at[on], c[on], o[on], m[on], k[on], t[on]
    return tables


class Totals:
    """What dishes share: the vocabulary's size, tables of the root, tables and customers by class, then by leaf, for the leaves of a bucket."""

    #: The part that all buckets share.
    HEAD = 2 + 2 * CLASSES

    def __init__(self, numbers: np.ndarray):
        self.words, self.root = int(numbers[0]), int(numbers[1])
        self.classes, self.at_classes = np.split(numbers[2 : self.HEAD], 2)
        self.leaves, self.customers = np.split(numbers[self.HEAD :], 2)
        self.at_root = int(self.classes.sum())


class Seats:
    """All dishes of a bucket's words on the three levels, with their customers and tables."""

    def __init__(self, hashes: np.ndarray, many: np.ndarray, kind: np.ndarray, count: np.ndarray):
        self.hashes, self.kind, self.count = hashes, kind.astype(np.int64), count.astype(np.int64)
        self.word = np.repeat(np.arange(len(hashes)), many)
        #: leaves of the bucket, rising, and which of them each dish is of
        self.leaves, self.place = np.unique(self.kind, return_inverse=True)
        cls = self.kind // SPLIT
        new = np.ones(len(cls), bool)
        new[1:] = (np.diff(cls) != 0) | (np.diff(self.word) != 0)
        self.group = np.cumsum(new) - 1
        self.g_word, self.g_class = self.word[new], cls[new]
        self.seen = np.bincount(self.word, self.count, len(hashes)).astype(np.int64)
        # keys of the random numbers: word and restaurant
        self.keys = (
            _mix(hashes[self.word] ^ _mix(self.kind.astype(np.uint64) + np.uint64(1 << 40))),
            _mix(hashes[self.g_word] ^ _mix(self.g_class.astype(np.uint64) + np.uint64(1 << 41))),
            _mix(hashes ^ np.uint64(1 << 42)),
        )
        self.tables = np.minimum(self.count, 1)
        self._send()
        self.g_tables = np.minimum(self.g_count, 1)
        self._send_root()
        self.w_tables = np.minimum(self.w_count, 1)

    def _send(self) -> None:
        self.g_count = np.bincount(self.group, self.tables, len(self.g_word)).astype(np.int64)

    def _send_root(self) -> None:
        self.w_count = np.bincount(self.g_word, self.g_tables, len(self.hashes)).astype(np.int64)

    def totals(self) -> np.ndarray:
        by = lambda at, n, size: np.bincount(at, n, size).astype(np.int64)
        head = [[np.count_nonzero(self.seen), self.w_tables.sum()], by(self.g_class, self.g_tables, CLASSES), by(self.g_class, self.g_count, CLASSES)]
        return np.concatenate([*head, by(self.place, self.tables, len(self.leaves)), by(self.place, self.count, len(self.leaves))])

    def by_owner(self, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the leaves by owner, and where each owner's begin and end."""
        owner = (self.leaves & (SPLIT - 1)) % owners
        return np.argsort(owner, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))])

    @staticmethod
    def _share(count, tables, level, all_tables, customers, parent):
        discount, strength = level
        return (count - discount * tables + (strength + discount * all_tables) * parent) / (strength + customers)

    def sweep(self, number: int, t: Totals) -> None:
        """Seat all anew, given ``t`` of the sweep before; a dish's own customers don't count for it."""
        salt = np.uint64(number * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        base = (ROOT[1] + ROOT[0] * t.root) / (t.words + 1)
        root = self._share(self.w_count, self.w_tables, ROOT, 0, t.at_root, base / ROOT[1])
        others = self.g_count[self.group] - self.tables
        kept = np.minimum(self.g_tables[self.group], others)
        cls = self.g_class[self.group]
        parent = self._share(others, kept, CLASS, t.classes[cls], t.at_classes[cls], root[self.word])
        self._seat_leaves(parent, t, salt)
        others = self.w_count[self.g_word] - self.g_tables
        kept = np.minimum(self.w_tables[self.g_word], others)
        parent = self._share(others, kept, ROOT, 0, t.at_root, base / ROOT[1])
        self._send()
        self.g_tables = seat(self.g_count, (CLASS[1] + CLASS[0] * (t.classes[self.g_class] - self.g_tables)) * parent, CLASS[0] * parent, CLASS[0], self.keys[1] + salt)
        self._send_root()
        open_ = (ROOT[1] + ROOT[0] * (t.root - self.w_tables)) / (t.words + 1)
        self.w_tables = seat(self.w_count, open_, np.full(len(open_), ROOT[0] / (t.words + 1)), ROOT[0], self.keys[2] + salt)

    def _seat_leaves(self, parent: np.ndarray, t: Totals, salt: np.uint64) -> None:
        some = np.flatnonzero(self.count > 1)  # one customer has one table
        p, own = parent[some], self.tables[some]
        found = seat(self.count[some], (LEAF[1] + LEAF[0] * (t.leaves[self.place[some]] - own)) * p, LEAF[0] * p, LEAF[0], self.keys[0][some] + salt)
        self.tables = np.minimum(self.count, 1)
        self.tables[some] = found

    def predict(self, t: Totals) -> np.ndarray:
        """Probability of each pair's word after its leaf; ``t`` are the totals of this very state."""
        base = (ROOT[1] + ROOT[0] * t.root) / (t.words + 1)
        root = self._share(self.w_count, self.w_tables, ROOT, 0, t.at_root, base / ROOT[1])
        cls = self._share(self.g_count, self.g_tables, CLASS, t.classes[self.g_class], t.at_classes[self.g_class], root[self.g_word])
        return self._share(self.count, self.tables, LEAF, t.leaves[self.place], t.customers[self.place], cls[self.group])

    def averaged(self, states: list[Totals]) -> np.ndarray:
        """Mean probability over the kept sweeps; ``states``: totals before the first sweep and after each."""
        out = np.zeros(len(self.kind))
        for s in range(1, BURN + KEEP + 1):
            self.sweep(s, states[s - 1])
            if s > BURN:
                out += self.predict(states[s])
        return out / KEEP


class Sum:
    """Adds up messages (words, pairs of each, leaves, counts): every pair is held once, and a few that wait."""

    def __init__(self):
        self.words, self.kinds = np.empty(0, np.uint64), np.empty(0, np.int64)
        #: place of the word, times the number of kinds, and place of the kind
        self.keys, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting, self.n_waiting = [], 0

    def add(self, words: np.ndarray, many: np.ndarray, kind: np.ndarray, count: np.ndarray) -> None:
        self.waiting.append((words, many, kind.astype(np.int64), count))
        self.n_waiting += len(kind)
        if self.n_waiting > max(500_000, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        words, place = np.unique(np.concatenate([self.words, *(m[0] for m in self.waiting)]), return_inverse=True)
        kinds, which = np.unique(np.concatenate([self.kinds, *(m[2] for m in self.waiting)]), return_inverse=True)
        at, of = len(self.words), len(self.kinds)
        parts = [place[self.keys // max(of, 1)] * len(kinds) + which[self.keys % max(of, 1)]]
        for w, many, kind, _ in self.waiting:
            parts.append(np.repeat(place[at : at + len(w)], many) * len(kinds) + which[of : of + len(kind)])
            at, of = at + len(w), of + len(kind)
        self.keys, where = np.unique(np.concatenate(parts), return_inverse=True)
        self.count = np.bincount(where, np.concatenate([self.count, *(m[3] for m in self.waiting)]), len(self.keys)).astype(np.int64)
        self.words, self.kinds, self.waiting, self.n_waiting = words, kinds, [], 0

    def places(self, words: np.ndarray, many: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the pairs of a message, all added and settled, are among all pairs."""
        of_word = np.repeat(np.searchsorted(self.words, words), many)
        return np.searchsorted(self.keys, of_word * len(self.kinds) + np.searchsorted(self.kinds, kind.astype(np.int64)))

    def blobs(self) -> tuple[bytes, bytes, bytes, bytes]:
        self.settle()
        many = np.bincount(self.keys // max(len(self.kinds), 1), minlength=len(self.words))
        return _squeeze_rising(self.words), _squeeze(many), _squeeze_names(self.kinds[self.keys % max(len(self.kinds), 1)]), _squeeze(self.count)


# -- the job --------------------------------------------------------------------
_PARTS = ("lens", "held", "ids", "hashes", "classes")
_MESSAGE = "bucket int, chunk long, words binary, many binary, kinds binary, counts binary"
_MESSAGE_NAMES = ["bucket", "chunk", "words", "many", "kinds", "counts"]
_MESSAGE_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 4]


def _message(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _MESSAGE_KINDS, strict=True)], names=_MESSAGE_NAMES)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def _requests(stored: DataFrame, buckets: int) -> DataFrame:
    """By bucket: one row (chunk -1) with all its pairs and counts, then for each chunk the places of its pairs, as ``kinds``."""

    def send(batches):
        for chunk, *blobs in _rows(batches):
            p = Pairs(*blobs)
            counts = p.counts()
            many = np.bincount(p.word, minlength=len(p.hashes))
            word_end = np.searchsorted(bucket_of(p.hashes, buckets), np.arange(buckets), side="right")
            pair_end = np.concatenate([[0], np.cumsum(many)])[word_end]
            w0 = p0 = 0
            for b in range(buckets):
                w1, p1 = int(word_end[b]), int(pair_end[b])
                if w1 > w0:
                    yield _message(b, chunk, _squeeze_rising(p.hashes[w0:w1]), _squeeze(many[w0:w1]), _squeeze_names(p.kind[p0:p1]), _squeeze(counts[p0:p1]))
                w0, p0 = w1, p1

    def gather(batches):
        here, total, asked = None, Sum(), []

        def flush():
            if here is not None:
                yield _message(here, -1, *total.blobs())
                for asker, words, many, kinds in asked:
                    places = total.places(_expand_rising(words), _expand(many), _expand(kinds))
                    yield _message(here, asker, None, None, _squeeze_rising(places.astype(np.uint64)), None)

        for bucket, chunk, words, many, kinds, counts in _rows(batches):
            if bucket != here:
                yield from flush()
                here, total, asked = bucket, Sum(), []
            total.add(_expand_rising(words), _expand(many), _expand(kinds), _expand(counts))
            asked.append((chunk, words, many, kinds))
        yield from flush()

    sent = stored.select("chunk", *_PARTS).mapInArrow(send, _MESSAGE)
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, _MESSAGE)


def _seats(words: bytes, many: bytes, kinds: bytes, counts: bytes) -> Seats:
    return Seats(_expand_rising(words), _expand(many), _expand(kinds), _expand(counts))


def _stored(folder: str, state: int, what: str, key: int) -> list[dict]:
    """Rows that owners wrote for a bucket or kept for themselves, by the other side's number."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    return pq.read_table(f"{base}/state={state}/what={what}/key={key}", filesystem=store, partitioning=None).sort_by("other").to_pylist()


def _known(folder: str, bucket: int, seats: Seats, heads: list[np.ndarray], owners: int) -> list[Totals]:
    """Totals of the states so far, with the leaves of this bucket."""
    if not heads:
        return []
    order, _ = seats.by_owner(owners)

    def numbers(state: int, column: str) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([_expand(r[column]) for r in _stored(folder, state, "bucket", bucket)])
        return out

    customers, tables = numbers(0, "customers"), numbers(0, "tables")
    return [Totals(np.concatenate([head, tables + numbers(s, "tables") if s else tables, customers])) for s, head in enumerate(heads)]


def _state(own: DataFrame, folder: str, heads: list[np.ndarray], owners: int) -> np.ndarray:
    """Replay the sweeps whose totals are known and make one more: the sums for all, while those of leaves go to the folder.

    Leaves' tables are those of the first state (one a dish), then what is more than these.
    """
    spark, state = own.sparkSession, len(heads)
    sent = spark.sparkContext.broadcast(heads)
    names, kinds = ["owner", "bucket", "leaves", "customers", "tables"], [pa.int32(), pa.int32(), *[pa.binary()] * 3]
    out_names, out_kinds = ["what", "key", "other", "customers", "tables"], [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    out_schema = "what string, key int, other int, customers binary, tables binary"

    def work(batches):
        row = lambda *r: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(r, kinds, strict=True)], names=names)
        head = np.zeros(Totals.HEAD, np.int64)
        for bucket, *blobs in _rows(batches):
            seats = _seats(*blobs)
            first = np.bincount(seats.place, seats.tables, len(seats.leaves)).astype(np.int64)
            for s, t in enumerate(_known(folder, bucket, seats, sent.value, owners), 1):
                seats.sweep(s, t)
            numbers = seats.totals()
            head += numbers[: Totals.HEAD]
            tables, customers = np.split(numbers[Totals.HEAD :], 2)
            order, ends = seats.by_owner(owners)
            for o in range(owners):
                at = order[ends[o] : ends[o + 1]]
                if len(at) and state:
                    yield row(o, bucket, None, None, _squeeze(tables[at] - first[at]))
                elif len(at):
                    yield row(o, bucket, _squeeze_rising(seats.leaves[at].astype(np.uint64)), _squeeze(customers[at]), _squeeze(tables[at]))
        for at in range(0, len(head) if head.any() else 0, _SLICE):
            yield row(-1 - at // _SLICE, -1, None, None, head[at : at + _SLICE].tobytes())

    def add(table: pa.Table) -> pa.Table:
        owner, buckets = table.column("owner")[0].as_py(), table.column("bucket").to_pylist()
        blobs = lambda name: [b.as_py() for b in table.column(name)]
        if owner < 0:
            total = sum(np.frombuffer(b, np.int64) for b in blobs("tables"))
            rows = [("head", 0, -1 - owner, None, total.tobytes())]
        else:
            if state:
                places = {r["other"]: _expand_rising(r["tables"]).astype(np.int64) for r in _stored(folder, 0, "owner", owner)}
                places, customers = [places[b] for b in buckets], None
            else:
                leaves = [_expand_rising(b) for b in blobs("leaves")]
                every = np.unique(np.concatenate(leaves))
                places, customers = [np.searchsorted(every, x) for x in leaves], [_expand(b) for b in blobs("customers")]
            size = max(int(p[-1]) for p in places) + 1

            def total(parts: list[np.ndarray]) -> np.ndarray:
                out = np.zeros(size, np.int64)
                for p, x in zip(places, parts, strict=True):
                    out[p] += x.astype(np.int64)  # a bucket has each leaf once
                return out

            tables, guests = total([_expand(b) for b in blobs("tables")]), total(customers) if customers else None
            rows = [("bucket", b, owner, None if guests is None else _squeeze(guests[p]), _squeeze(tables[p])) for b, p in zip(buckets, places, strict=True)]
            if not state:
                rows += [("owner", owner, b, None, _squeeze_rising(p.astype(np.uint64))) for b, p in zip(buckets, places, strict=True)]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), out_kinds, strict=True)], names=out_names)

    found = own.mapInArrow(work, "owner int, bucket int, leaves binary, customers binary, tables binary").groupBy("owner").applyInArrow(add, out_schema)
    found.repartition("what", "key").write.partitionBy("what", "key").parquet(f"{folder}/state={state}")
    out = np.zeros(Totals.HEAD, np.int64)
    for r in spark.read.schema(out_schema).parquet(f"{folder}/state={state}").filter("what = 'head'").collect():  # about 132,000 numbers
        part = np.frombuffer(r["tables"], np.int64)
        out[r["other"] * _SLICE : r["other"] * _SLICE + len(part)] = part
    return out


def score(docs: DataFrame, folds: int = 7, held: int = 2, per_bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    stored = cut(chunks(docs, folds, held))
    sums = stored.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train"))).first()
    n_train = sums["n_train"]
    buckets = max(16, -(-sums["n_tokens"] // per_bucket))
    asked, owners, folder = cut(_requests(stored, buckets)), max(16, buckets // OWNED), shared_folder(spark, "lm")
    own = asked.filter(F.col("chunk") < 0).select("bucket", "words", "many", "kinds", "counts")
    heads: list[np.ndarray] = []
    for _ in range(1 + BURN + KEEP):
        heads.append(_state(own, folder, heads, owners))
    sent = spark.sparkContext.broadcast(heads)
    answer_names = ["chunk", "bucket", "seen", "chance"]

    def answer(batches):
        for bucket, chunk, words, many, kinds, counts in _rows(batches):
            if chunk < 0:
                seats = _seats(words, many, kinds, counts)
                logs = np.log10(seats.averaged(_known(folder, bucket, seats, sent.value, owners))).astype(np.float32)
                continue
            pair = _expand_rising(kinds)
            word = seats.word[pair]
            seen = seats.seen[word[np.diff(word, prepend=-1) != 0]]
            row = (chunk, bucket, _squeeze(seen), _squeeze(logs[pair].view(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=answer_names)

    answers = asked.mapInArrow(answer, "chunk long, bucket int, seen binary, chance binary")
    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    words = int(heads[-1][0])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        p = Pairs(*(table.column(c)[0].as_py() for c in _PARTS))
        order = np.argsort(replies.column("bucket").to_numpy())
        seen, chance = (np.concatenate([_expand(replies.column(c)[i].as_py()) for i in order.tolist()]) for c in ("seen", "chance"))
        # a bucket's values may come in a narrower type than another's
        log_p = np.ascontiguousarray(chance, np.uint32).view(np.float32).astype(np.float64)[p.of_token]
        c = seen[p.word].astype(np.float64)[p.of_token]
        add = lambda x: np.add.reduceat(x, p.starts)  # noqa: E731  every text has a token
        columns = [table.column("doc_ids")[0].as_py(), p.held, p.lens, add((c > 0).astype(np.int64)), np.full(len(p.lens), n_train), add(np.log10((c + 1) / (n_train + words + 1))), add(log_p)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=out_names)

    left = stored.select("chunk", "doc_ids", *_PARTS).groupBy("chunk")
    return left.cogroup(answers.groupBy("chunk")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
