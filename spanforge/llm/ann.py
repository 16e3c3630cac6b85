"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is its distance from the centre times a unit direction.  The direction
is rotated at random and only the sign of each coordinate kept: one bit a
dimension, and one scalar, the inner product of code and direction.  From packed
bits and these scalars the inner product with a query is estimated without bias,
with an error of about sqrt(1 - f^2) / (f sqrt(D - 1)); ``EPSILON`` times that
bounds it.  A query's threshold is its k-th best exact score so far; vectors whose
estimate plus bound reaches it are reranked in double precision on the original
vectors, all others are left alone.

Every row is indexed.  The centre is the mean of a bounded sample (``SAMPLE`` rows
by a hash of the id) and only sharpens estimates.  Queries are collected and sent
in groups of about ``GROUP`` vectors, each group against all rows; each task
returns at most k rows a query, which a window by query merges.

Cases.  Null, empty or zero vectors, such with a null or a non-finite component,
of another length than most, and rows without an id take no part.  Rows with the
query's own id are no candidates of it.  Ties go to the smaller id.  Fewer
candidates than k: all of them.  Empty table: empty result.  Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 3.0
SAMPLE = 10_000
GROUP = 50_000
_ROWS, _QUERIES, _PAIRS = 8192, 256, 65536


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return out


class Codes:
    """Packed one-bit codes of the rows of x with what corrects their estimates."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.d = x.shape[1]
        rest = (x.astype(np.float64) - centre) @ turn
        self.size = np.sqrt((rest * rest).sum(1))
        unit = rest / np.where(self.size > 0, self.size, 1)[:, None]
        self.bits = np.packbits(unit > 0, axis=1)
        self.fit = np.maximum(np.abs(unit).sum(1) / np.sqrt(self.d), 1e-6)
        self.spread = self.size * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(self.d - 1, 1))

    def estimate(self, turned: np.ndarray, lengths: np.ndarray, offset: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products (queries by rows) and their error bounds."""
        signs = np.unpackbits(self.bits, axis=1, count=self.d).astype(np.float32) * 2 - 1
        raw = turned.astype(np.float32) @ signs.T
        estimate = raw * (self.size / self.fit / np.sqrt(self.d)).astype(np.float32) + offset[:, None].astype(np.float32)
        return estimate, (epsilon * lengths[:, None] * self.spread[None, :] + 1e-5 * (1 + np.abs(offset))[:, None]).astype(np.float32)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scored candidates, ``q`` ascending."""
        if not len(q):
            return
        for a, b in zip(starts := np.flatnonzero(np.diff(q, prepend=-1)), [*starts[1:], len(q)], strict=True):
            i = q[a]
            s, n = np.concatenate([self.score[i], score[a:b]]), np.concatenate([self.id[i], ids[a:b]])
            order = np.lexsort((n, -s))[: self.k]
            self.score[i], self.id[i] = s[order], n[order]


def search_rows(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, codes: Codes, turned: np.ndarray, offset: np.ndarray, best: Best, epsilon: float) -> int:
    """Bring ``best`` up to date with the rows of x; returns how many were reranked."""
    lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    slack = lengths * float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max()) * (x.shape[1] + 8) * 2.0**-23
    reranked = 0
    for at in range(0, len(q), _QUERIES):
        part = np.arange(at, min(at + _QUERIES, len(q)))
        estimate, bound = codes.estimate(turned[part], lengths[part], offset[part], epsilon)
        own = q_ids[part][:, None] == ids[None, :]
        estimate[own] = -np.inf
        # rerank the best estimates first, for a threshold, then all that may reach it
        first = np.zeros(estimate.shape, bool)
        n = min(2 * best.k, estimate.shape[1])
        np.put_along_axis(first, np.argpartition(-estimate, n - 1, axis=1)[:, :n], True, axis=1)
        first &= ~own
        for chosen in (lambda: first, lambda: (estimate + bound >= best.score[part, -1][:, None]) & ~first & ~own):
            a, b = np.nonzero(chosen())
            reranked += len(a)
            for i in range(0, len(a), _PAIRS):
                l, r = part[a[i : i + _PAIRS]], b[i : i + _PAIRS]
                # in single precision first: who misses the threshold by more than its rounding needs no doubles
                near = np.einsum("ij,ij->i", q[l], x[r]) >= best.score[l, -1] - slack[l]
                l, r = l[near], r[near]
                best.add(l, dots(q[l], x[r]), ids[r])
    return reranked


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a list column: their positions, and their components as float32."""
    lists = column.cast(pa.list_(pa.float32()))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == d)
    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32)  # nulls become NaN
    x = values.reshape(len(at), d)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part, and their number of components (0: none)."""
    e = F.col("embedding")
    some = vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    )
    top = some.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = top["d"] if top else 0
    return some.filter(F.size("embedding") == d), d


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, epsilon: float = EPSILON, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each row of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows, d = usable(vectors)
    asked = queries.select("vec_id", "embedding")
    if not d:
        found = spark.createDataFrame([], schema)
    else:
        asked = usable(asked)[0].filter(F.size("embedding") == d).dropDuplicates(["vec_id"])
        draw = F.pmod(F.xxhash64(F.lit("centre"), F.col("vec_id")), F.lit(1 << 30))
        n = rows.count()
        some = rows.filter(draw < F.lit(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))).select("embedding").toArrow()
        sample = _matrix(some.column(0).combine_chunks(), d)[1]
        centre = sample.astype(np.float64).mean(0) if len(sample) else np.zeros(d)
        turn = rotation(d)
        groups = -(-asked.count() // group) or 1
        found = None
        for g in range(groups):
            mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else asked
            table = mine.orderBy("vec_id").toArrow()
            q_ids, q = table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks(), d)[1]
            sent = spark.sparkContext.broadcast((q_ids, q, centre, turn))

            def work(batches, sent=sent):
                q_ids, q, centre, turn = sent.value
                turned, offset = q.astype(np.float64) @ turn, q.astype(np.float64) @ centre
                best = Best(len(q), k)
                for batch in batches:
                    for at in range(0, batch.num_rows, _ROWS):
                        part = batch.slice(at, _ROWS)
                        keep, x = _matrix(part.column(1), d)
                        if len(keep):
                            search_rows(part.column(0).to_numpy()[keep], x, q_ids, q, Codes(x, centre, turn), turned, offset, best, epsilon)
                a, b = np.nonzero(np.isfinite(best.score))
                for i in range(0, len(a), 50_000):
                    r, c = a[i : i + 50_000], b[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(best.id[r, c]), pa.array(best.score[r, c])], names=["query_id", "vec_id", "score"])

            part = rows.mapInArrow(work, schema) if len(q) else spark.createDataFrame([], schema)
            found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The exact search in DuckDB SQL, for queries whose id ``every`` divides.
def sql(k: int = 20, every: int = 20) -> str:
    return f"""
with v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {k}
"""
