"""Nearest neighbours, the pipeline, and the registered queries."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import ann, langid, pii, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


def brute(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            s = sorted((-float((v * w).sum()), j) for j, w in good if j != i)
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def test_ann_cases(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [0.0] * 4), (63, [1.0, None, 0.0, 0.0]), (64, [float("nan")] * 4), (65, [float("inf"), 0.0, 0.0, 0.0]), (66, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(i, rows[3][1]) for i in range(70, 90)]  # ties
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for x in ann.search(df, df.filter("vec_id % 5 = 0"), k=9).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    want = brute(rows, 9, 5)
    assert got.keys() == want.keys()
    for q in got:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)
    assert ann.search(df.filter("false"), df, k=3).count() == 0
    assert ann.search(df, df.filter("false"), k=3).count() == 0
    few = df.filter("vec_id < 3")
    assert ann.search(few, few.filter("vec_id = 0"), k=20).count() == 2


def test_ann_groups_and_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.filter("vec_id % 20 = 0")
    one = {tuple(r) for r in ann.search(v, q).collect()}
    assert one == {tuple(r) for r in ann.search(v, q, group=7).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    exact = {(a, c) for a, _, c, _ in con.execute(ann.sql()).fetchall()}
    assert len({(a, c) for a, _, c, _ in one} & exact) >= 0.99 * len(exact)
    loose = {(r["query_id"], r["vec_id"]) for r in ann.search(v, q, epsilon=1.5).collect()}
    assert len(loose & exact) >= 0.9 * len(exact)


def test_one_bit_estimates_are_bounded():
    r = np.random.default_rng(2)
    x, q = r.normal(size=(2000, 64)).astype(np.float32), r.normal(size=(20, 64)).astype(np.float32)
    centre, turn = x.astype(float).mean(0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes = ann.Codes(x, centre, turn)
    est, bound = codes.estimate(q.astype(float) @ turn, np.sqrt((q.astype(float) ** 2).sum(1)), q.astype(float) @ centre, ann.EPSILON)
    error = np.abs(est - q @ x.T)
    assert (error <= bound).mean() > 0.995
    assert abs(float((est - q @ x.T).mean())) < 0.05 * float(error.mean())
    assert codes.bits.nbytes == 2000 * 8


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen.append((name, {r["doc_id"]: r["text"] for r in now.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}))
        now = spark.createDataFrame(out.collect(), docs.schema)
    stages = {n: (a, b) for n, a, b in seen}
    a, b = stages["language"]
    assert set(b) <= set(a) and len(b) >= 0.97 * len(a)
    a, b = stages["near_duplicates"]
    fps = {i: simhash.fingerprint(t) for i, t in a.items()}
    keep = set()
    left = set(fps)
    while left:  # components by brute force
        todo, group = [min(left)], set()
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                group.add(i)
                todo += [j for j in left if (fps[i] ^ fps[j]).bit_count() <= 3]
        keep.add(min(group))
    assert set(b) == keep
    a, b = stages["pii"]
    assert set(a) == set(b) and any(a[i] != b[i] for i in a)
    last = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == set(b)


def test_pipeline_cases(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "A text of some words in here.", "en", "s", 29), (3, "A text of some words in here.", "en", "s", 29), (None, "Another text, quite unlike it.", "en", None, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_extra", F.lit(1))
    now = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in now.collect()) == [(False, 3), (True, None)]
    empty = df.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered(spark):
    assert [q for q in queries.QUERIES] == ["op1_bpe", "op2_packing", "op3_toxicity", "op4_lm", "op5_quality", "op6_neighbours", "op7_pii", "op8_language", "op9_secrets", "op10_simhash"]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_bpe", "op3_toxicity", "op4_lm", "op5_quality", "op7_pii", "op8_language", "op9_secrets", "op10_simhash"):
        out = queries.QUERIES[name](spark, SF)
        assert out.count() == n
        assert out.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("module", [langid, toxicity, pii])
def test_every_module_says_its_cases(module):
    assert "Cases." in module.__doc__
