"""What grows with the tables: rows that are moved, and odd rows of larger ones."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_catalogs_are_derived_without_texts(spark, monkeypatch):
    from spanforge.functions import ordered
    from spanforge.plans.relations import Relations

    seen = []
    monkeypatch.setattr(ordered, "cut", lambda df, f=ordered.cut: seen.append(df.columns) or f(df))
    t = Relations(spark, SF)
    assert t.catalog.count() == t.catalog_text.count() == 200
    assert len(seen) == 3 and not {"payload", "text"} & {c for cols in seen for c in cols}
    assert t.catalog_text.filter(F.octet_length("payload") != F.col("record_length")).count() == 0


def shuffled(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    gateway = sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def small_session(spark, size, strange=False):
    from spanforge.operators import closures
    from spanforge.session import Session

    rows = [(i, "v", 0, i, p, t, r) for i, (t, p, r) in enumerate(zip("IBBBP", [0, 3, 2, 4, 1], [0, 4, 4, 4, 4], strict=True))]
    cat = spark.createDataFrame(rows, "record_id long, video_id string, gop_id long, k int, packet_index int, frame_type string, right_ref long").withColumn("frame_idx", F.col("k"))
    cat = cat.withColumn("record_offset", F.col("packet_index").cast("long") * size).withColumn("record_length", F.lit(size).cast("long"))
    import random

    r = random.Random(0)
    data = spark.createDataFrame([(i, bytearray(r.randbytes(size))) for i in range(5)], "record_id long, data binary")
    closure = closures.hierarchical(cat)
    if strange:
        closure = closure.unionByName(spark.createDataFrame([(1, 77, 9)], "target_id long, dep_id long, packet_index int"))
    return Session(cat, closure, data)


@pytest.mark.parametrize("action", ["exact_closure", "fixed_gap_closure", "calibrated_closure", "region_all", "keyframe_prefix"])
def test_bytes_move_once_however_many_windows(spark, action):
    windows, size = 40, 20_000
    req = spark.createDataFrame([(w, 0, 0, w, "v", 1) for w in range(windows)], "window_id long, batch_id long, pos long, sample_id long, video_id string, frame_idx int")
    with small_session(spark, size) as s:
        before = shuffled(spark)
        got = s.execute(req, action).collect()
        assert [r["sample_id"] for r in got] == list(range(windows)) and len({r["digest"] for r in got}) == 1 and got[0]["width"] == 4 * size
        assert shuffled(spark) - before < 10 * size * 5  # each window takes 4 or 5 records


def test_a_closure_that_leaves_its_group_is_an_error(spark):
    req = spark.createDataFrame([(0, 0, 0, 0, "v", 0)], "window_id long, batch_id long, pos long, sample_id long, video_id string, frame_idx int")
    with small_session(spark, 10, strange=True) as s, pytest.raises(Exception, match="leaves its group"):
        s.execute(req).collect()


def test_empty_records_have_a_place(spark):
    from spanforge.session import plan_byte_ranges

    rows = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 5, 0), (0, 3, 5, 7)], "w int, record_id long, offset long, length long")
    got = plan_byte_ranges(rows, 0, keys=["w"], empty=True).orderBy("record_id").collect()
    assert [(r["span"], r["relative_offset"]) for r in got] == [(0, 0), (0, 5), (0, 5)]
    with pytest.raises(ValueError):
        plan_byte_ranges(rows.withColumn("length", F.col("length") - 1), 0, keys=["w"], empty=True)


def test_pairs_without_bytes_come_last_and_fit(spark):
    from spanforge.operators import costing

    p = spark.createDataFrame([(0, 1, 9, 0), (0, 2, 1, 10), (0, 3, 2, 10)], "w int, sample_id long, requests long, bytes long")
    got = [(r["sample_id"], r["selected"]) for r in costing.select_pairs(p, 10, ["w"]).collect()]
    assert got == [(3, True), (2, False), (1, True)]


def test_density_of_no_bytes_is_above_all(spark):
    from spanforge.operators import spans

    df = spark.createDataFrame([(1, 0), (10**9, 1), (5, 3)], "a long, b long").withColumn("d", spans.density(F.col("a"), F.col("b")))
    assert [r["b"] for r in df.orderBy(F.desc("d")).collect()] == [0, 1, 3]


def test_records_are_bound_at_borders(spark):
    from spanforge.operators import spans

    given = spark.createDataFrame([(0, 10, 10), (0, 30, 0)], "w int, span_offset long, span_length long")
    rows = [(0, i, o, n) for i, (o, n) in enumerate([(10, 0), (20, 0), (10, 10), (15, 6), (9, 2), (30, 0), (31, 0)])]
    got = spans.bound(spark.createDataFrame(rows, "w int, record_id long, offset long, length long"), given, ["w"]).orderBy("record_id").collect()
    assert [r["span_offset"] for r in got] == [10, 10, 10, None, None, 30, None]


def test_sampler_prices_what_a_closure_adds():
    import random

    from spanforge.model import DEFAULT
    from spanforge.operators import sampling

    r, looks = random.Random(1), []
    recs = {i: (r.randrange(200_000), r.choice([0, 1, 100, 3000])) for i in range(200)}
    closure = {t: {d: recs[d] for d in r.sample(range(200), 5)} for t in range(60)}
    order = [r.randrange(60) for _ in range(120)]
    labels = [r.randint(-1, 1) for _ in order]
    for gap in (0, 100, 16384):
        whole = lambda e, gap=gap: looks.append(len(e)) or sampling.closure_cost(e, DEFAULT, gap)
        adds = sampling.Sparse(closure, DEFAULT, gap)
        assert sampling.bounded(order, closure, 32, 16, adds) == sampling.bounded(order, closure, 32, 16, whole)
        assert sampling.label_preserving(order, labels, closure, 32, 2, adds) == sampling.label_preserving(order, labels, closure, 32, 2, whole)
    assert looks


def test_start_codes_need_no_object_a_row():
    import tracemalloc

    import pyarrow as pa

    from spanforge.functions import scalars

    unit = lambda n: n.to_bytes(4, "big") + bytes(range(256)) * (n // 256)
    rows = [unit(256) * 40, None, b"", unit(512)] * 250
    batch = pa.array(rows, pa.binary())
    tracemalloc.start()
    got = scalars.annex_b_array(batch, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [None if b is None else scalars.annex_b(b, 4) for b in rows]
    assert scalars.annex_b_array(batch.slice(3, 6), 4).to_pylist() == got.to_pylist()[3:9]
    assert peak < 1.5 * batch.nbytes
    with pytest.raises(ValueError):
        scalars.annex_b_array(pa.array([b"\0\0\0\0"]), 4)


def test_texts_move_once_however_many_closures(spark):
    import random

    from spanforge.operators import kernels

    n, size, r = 60, 10_000, random.Random(0)
    cat = spark.createDataFrame([(i, "v", 0, i) for i in range(n)], "record_id long, video_id string, gop_id long, packet_index int")
    texts = spark.createDataFrame([(i, r.randbytes(size // 2).hex()) for i in range(n)], "record_id long, text string")
    closure = cat.select(F.col("record_id").alias("target_id")).join(cat.select(F.col("record_id").alias("dep_id"), "packet_index"), F.col("dep_id") <= F.col("target_id"))
    before = shuffled(spark)
    got = kernels.digest(kernels.jobs(closure, texts, cat)).orderBy("target_id").collect()
    assert [r["width"] for r in got] == [size * (i + 1) for i in range(n)] and [r["units"] for r in got] == list(range(1, n + 1))
    assert shuffled(spark) - before < 5 * n * size  # closures have 1,830 texts in all
