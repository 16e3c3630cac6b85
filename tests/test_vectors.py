"""Small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import ordered, scalars
from spanforge.model import DEFAULT, CostModel
from spanforge.operators import closures, controls, costing, delivery, feedback, residency, resolve, sampling, scans, spans
from spanforge.sources import chunkfile


def extents(spark, rows, key="w long"):
    return spark.createDataFrame([(0, *r) for r in rows], f"{key}, record_id long, offset long, length long")


def spans_of(df):
    return sorted((r["span_offset"], r["span_length"]) for r in df.collect())


def test_gaps(spark):
    e = extents(spark, [(30, 8, 3), (10, 0, 3), (20, 5, 3)])
    assert len(spans_of(spans._spans(spans.numbered(e, ["w"], None), ["w"]))) == 3
    assert spans_of(spans.merged(e, ["w"], 0)) == [(0, 3), (5, 6)]
    assert spans_of(spans.merged(e, ["w"], 2)) == [(0, 11)]


def test_capped(spark):
    e = extents(spark, [(1, 100, 20), (2, 128, 10), (3, 150, 10)])
    assert spans_of(spans.merged_capped(e, ["w"], 16, 45)) == [(100, 38), (150, 10)]
    inside = {r["record_id"]: r["relative_offset"] for r in spans.members(spans.numbered_capped(e, ["w"], 16, 45), ["w"]).collect()}
    assert inside == {1: 0, 2: 28, 3: 0}
    assert spans_of(spans.merged_capped(extents(spark, [(1, 0, 90), (2, 10, 5)]), ["w"], 16, 45)) == [(0, 90), (10, 5)]


def test_covered_and_violations(spark):
    assert spans.covered_bytes(extents(spark, [(1, 0, 40), (2, 20, 20), (3, 60, 20)]), ["w"]).first()["covered_bytes"] == 60
    bad = spans.violations(extents(spark, [(1, 0, 0), (2, (1 << 63) - 2, 5), (3, 0, 1), (3, 0, 2)]), ["w"]).collect()
    assert {(r["record_id"], r["reason"]) for r in bad} == {(1, "empty"), (2, "overflow"), (3, "conflict")}


def test_overlap_across_buckets(spark):
    records = extents(spark, [(i, i * 700, 650) for i in range(60)])
    ranges = spark.createDataFrame([(0, i, i * 5000, 4321) for i in range(9)], "w long, span int, span_offset long, span_length long")
    got = {(r["span"], r["record_id"]) for r in spans.overlaps(ranges, records, ["w"], bucket=1024).collect()}
    assert got == {(s, i) for s in range(9) for i in range(60) if i * 700 < s * 5000 + 4321 and s * 5000 < i * 700 + 650}


def test_peak_ends_first(spark):
    ev = spark.createDataFrame([(0, 0, 10), (0, 10, 20), (0, 5, 7)], "w long, a long, b long")
    assert spans.peak(ev, ["w"], "a", "b").first()["peak"] == 2


@pytest.mark.parametrize(("n", "size", "cost"), [(4, 80, 140), (1, 20, 110), (0, 0, 0), (5, 100, 250)])
def test_io_cost(spark, n, size, cost):
    m = CostModel(latency_ns=100, bytes_per_ns=2, concurrency=4)
    assert spark.range(1).select(m.io(F.lit(n), F.lit(size)).alias("c")).first()["c"] == cost


@pytest.mark.parametrize("bad", [{"bytes_per_ns": 0}, {"latency_ns": -1.0}, {"overlap": 1.5}, {"concurrency": 0}, {"waves": (1.0,)}])
def test_cost_model_rejects(bad):
    with pytest.raises(ValueError):
        CostModel(**bad)


def two_samples(spark, resident=()):
    """Eight records of 1024 bytes every 4096 in one group; what targets 10 and 11 need."""
    need = {10: [0, 2, 3], 11: [0, 4, 6, 7]}

    def plans(targets, model):
        ids = sorted({r for t in targets for r in need[t]})
        rows = [(0, i, i * 4096, 1024, "v", 0) for i in ids]
        schema = "w long, record_id long, offset long, length long, video_id string, gop_id long"
        needed = spark.createDataFrame(rows, schema)
        fetch = spark.createDataFrame([r for r in rows if r[1] not in resident], schema)
        regions = spark.createDataFrame([("v", 0, 0, 32768, 8)], "video_id string, gop_id long, region_offset long, region_length long, records long")
        return costing.choose(costing.candidates(needed, fetch, regions, ["w"], model), ["w"], model).first()

    return plans


def test_choose_plan(spark):
    slow = CostModel(latency_ns=1e7, bytes_per_ns=1, concurrency=1, decode_fixed_ns=0, decode_unit_ns=1, overlap=0, tolerance_ns=0)
    fast = CostModel(latency_ns=1, bytes_per_ns=1, concurrency=8, decode_fixed_ns=0, decode_unit_ns=1, overlap=0, tolerance_ns=0)
    r = two_samples(spark)([10, 11], slow)
    assert (r["kind"], r["ranges"], r["units"]) == ("sparse", 1, 6)
    r = two_samples(spark)([10], fast)
    assert (r["kind"], r["units"], r["bytes"]) == ("sparse", 3, 3072)
    r = two_samples(spark, resident={0})([10], fast)
    assert (r["useful_bytes"], r["units"]) == (2048, 3)
    r = two_samples(spark, resident={0, 2, 3})([10], fast)
    assert (r["ranges"], r["units"], r["bytes"]) == (0, 3, 0)


def test_lookahead(spark):
    p = spark.createDataFrame([(0, 1, 1, 100.0, 50.0), (0, 2, 2, 150.0, 90.0)], "w long, horizon int, samples long, total_ns double, first_batch_ns double")
    assert costing.lookahead(p, ["w"], 60).first()["horizon"] == 1
    assert costing.lookahead(p, ["w"], 100).first()["horizon"] == 2
    assert costing.lookahead(p, ["w"], 10).first()["horizon"] == 1


def small_catalog(spark, types, packets):
    right = []
    for i, t in enumerate(types):
        right.append(i if t != "B" else next(j for j in range(i, len(types)) if types[j] != "B"))
    rows = [(i, "v", 0, i, p, t, i, r) for i, (t, p, r) in enumerate(zip(types, packets, right, strict=True))]
    return spark.createDataFrame(rows, "record_id long, video_id string, gop_id long, k int, packet_index int, frame_type string, frame_idx int, right_ref long")


def test_hierarchical_closure(spark):
    edges = closures.hierarchical(small_catalog(spark, "IBBBP", [0, 3, 2, 4, 1])).collect()
    of = lambda t: [e["dep_id"] for e in sorted(edges, key=lambda e: e["packet_index"]) if e["target_id"] == t]
    assert of(1) == [0, 4, 2, 1]
    assert of(2) == [0, 4, 2]
    assert of(0) == [0] and of(4) == [0, 4]


def test_shared_anchor_and_violations(spark):
    rows = [(0, "v", 0, 0), (1, "v", 0, 1), (2, "v", 0, 2), (3, "v", 0, 3), (4, "v", 1, 4), (5, "v", 1, 5)]
    cat = spark.createDataFrame(rows, "record_id long, video_id string, gop_id long, packet_index int")
    edges = closures.shared_anchor(cat)
    got: dict = {}
    for e in edges.collect():
        got.setdefault(e["target_id"], []).append(e["dep_id"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [0], 1: [0, 1], 2: [0, 2], 3: [0, 3], 4: [4], 5: [4, 5]}
    assert closures.violations(edges, cat).isEmpty()
    broken = edges.filter("not (target_id = 1 and dep_id = 1)").filter("target_id <> 2").unionByName(spark.createDataFrame([(5, 0, 0)], edges.schema))
    assert {(r["target_id"], r["reason"]) for r in closures.violations(broken, cat).collect()} == {(1, "without target"), (2, "empty"), (5, "other group")}


def test_catalog_violations(spark):
    rows = [(0, "v", 0, 0, 0, 0, 5), (0, "v", 1, 0, 1, 5, 5), (1, "", 2, 0, 2, 10, 0), (2, "w", 0, 0, 0, -1, 3), (3, "w", 0, 0, 1, 20, 90), (None, "w", 7, 0, 2, 30, 1)]
    cat = spark.createDataFrame(rows, "record_id long, video_id string, frame_idx int, gop_id long, packet_index int, record_offset long, record_length long")
    got = {(r["record_id"], r["reason"]) for r in scans.violations(cat, 100).collect()}
    assert {(0, "duplicate id"), (1, "empty video"), (1, "empty record"), (2, "negative"), (2, "duplicate frame"), (3, "outside payload"), (None, "null")} <= got


def test_resolution(spark):
    cat = spark.createDataFrame([("a", 0, 5)], "video_id string, frame_idx int, record_id long")
    req = spark.createDataFrame([(1, "a", 0), (2, "a", 0)], "sample_id long, video_id string, frame_idx int")
    assert resolve.resolve(req, cat, strict=True).count() == 2
    with pytest.raises(resolve.UnknownTargets):
        resolve.resolve(req.withColumn("frame_idx", F.lit(9)), cat, strict=True)
    with pytest.raises(KeyError):
        scans.frame_indices(cat, "zzz")


def test_global_order_without_one_task(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 13).alias("v")).repartition(7)
    got = ordered.with_index(df, ["x"]).orderBy("x").collect()
    assert [r["index"] for r in got] == list(range(1000))
    sums = ordered.with_running_sum(df, ["x"], "v", "before").orderBy("x").collect()
    assert [r["before"] for r in sums] == [0, *np.cumsum([r["v"] for r in sums])[:-1].tolist()]


def test_pairs_are_skipped_not_cut(spark):
    p = spark.createDataFrame([(0, 1, 2, 60), (0, 2, 3, 40), (0, 3, 1, 30)], "w long, sample_id long, requests long, bytes long")
    chosen = lambda budget: sorted(r["sample_id"] for r in costing.select_pairs(p, budget, ["w"]).filter("selected").collect())
    assert chosen(70) == [2, 3]
    assert chosen(0) == []


def test_broker(spark):
    rows = [("o", 1, 100, 20), ("o", 2, 300, 10), ("o", 3, 125, 15), ("o", 4, 280, 10), ("p", 5, 100, 20)]
    e = spark.createDataFrame(rows, "object_key string, record_id long, offset long, length long")
    got = spans.merged_capped(e, ["object_key"], 20, 1 << 20).collect()
    assert sorted((r["object_key"], r["span_offset"], r["span_length"], r["records"]) for r in got) == [("o", 100, 40, 2), ("o", 280, 30, 2), ("p", 100, 20, 1)]


def test_histogram_edges(spark):
    s = spark.createDataFrame([(0, x) for x in (4096, 4097, 16384, 65536, 262144, 262145)], "w long, span_length long")
    r = spans.histogram(s, ["w"]).first()
    assert (r["le_4k"], r["le_16k"], r["le_64k"], r["le_256k"], r["above"]) == (1, 2, 1, 1, 1)


@pytest.mark.parametrize(("dts", "pts", "threads", "out"), [([0, 10, 20, 30, 40], [30], 1, 4), (list(range(8)), [2], 4, 6)])
def test_release(spark, dts, pts, threads, out):
    cat = spark.createDataFrame([("v", 0, i, d) for i, d in enumerate(dts)], "video_id string, gop_id long, ordinal long, dts long")
    tg = spark.createDataFrame([(0, "v", 0, p) for p in pts], "window_id long, video_id string, gop_id long, pts long")
    assert costing.release_ordinal(tg, cat, threads).first()["release_ordinal"] == out


def test_liveness_and_monotonic(spark):
    cl = spark.createDataFrame([(10, 0, 0), (10, 1, 1), (11, 0, 0), (11, 2, 2)], "target_id long, dep_id long, packet_index int")
    tg = lambda rows: spark.createDataFrame([(0, *r) for r in rows], "w long, batch_id long, record_id long")
    reuse = lambda rows: {(r["batch_id"], r["dep_id"]): r["reuses"] for r in residency.visible_reuses(residency.liveness(tg(rows), cl, ["w"]), ["w"]).collect()}
    assert reuse([(0, 10), (0, 11)])[0, 0] == 1
    assert reuse([(0, 10), (1, 11)])[0, 0] == 1
    assert reuse([(0, 10), (1, 11)])[1, 0] == 0
    assert reuse([(0, 10), (0, 10)])[0, 0] == 0
    ords = spark.createDataFrame([(6, 6), (7, 7), (8, 8), (9, 9)], "record_id long, ordinal int")
    t2 = lambda rows: spark.createDataFrame([(0, b, r, "v", 0) for b, r in rows], "w long, batch_id long, record_id long, video_id string, gop_id long")
    first = lambda rows: residency.monotonic(t2(rows), ords, ["w"]).filter("batch_id = 0").first()
    assert (first([(0, 7), (1, 7), (2, 6)])["reuses"], first([(0, 7), (1, 7), (2, 6)])["next_use"]) == (0, None)
    assert (first([(0, 7), (1, 8), (1, 8), (2, 9)])["reuses"], first([(0, 7), (1, 8), (2, 9)])["next_use"]) == (2, 1)
    assert first([(0, 7), (0, 8)])["reuses"] == 1


def test_admission_and_victim(spark):
    c = spark.createDataFrame([(0, 0, None), (0, 1, None), (1, 0, None), (1, 0, 1)], "visible_consumers int, potential_consumers int, next_use long")
    assert [r["admit"] for r in residency.admitted(c).collect()] == [False, True, False, True]
    s = spark.createDataFrame([(0, 2, 0, False, None), (0, 1, 1, True, None)], "w long, state long, age_rank long, pinned boolean, next_use long")
    assert residency.victim(s, ["w"]).first()["state"] == 2
    assert residency.victim(s.filter("state = 1"), ["w"]).first()["state"] == 1


def test_lru(spark):
    a = spark.createDataFrame([(0, i, r, n) for i, (r, n) in enumerate([(1, 3), (2, 3), (1, 3), (3, 3), (2, 3), (9, 99)])], "lane long, seq long, record_id long, length long")
    got = residency.lru_trace(a, 6).orderBy("seq").collect()
    assert [r["hit"] for r in got] == [False, False, True, False, False, False]
    assert [r["evicted"] for r in got] == [0, 0, 0, 1, 1, 0]
    assert max(r["resident_bytes"] for r in got) <= 6


def test_cohorts_have_one_budget(spark):
    a = spark.createDataFrame([(0, i, t) for i, t in enumerate([0, 4, 9, 11, 12, 13, 30])], "w long, sample_id long, arrival long")
    got = [r["cohort"] for r in delivery.cohorts(a, ["w"], 10, 3).orderBy("sample_id").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


def test_fnv():
    assert delivery.fnv1a("") == 0xCBF29CE484222325
    assert delivery.fnv1a("a") == 0xAF63DC4C8601EC8C


def test_ready_groups_never_split(spark):
    g = spark.createDataFrame([(0, "a", 1, 3, True), (0, "b", 2, 3, True), (0, "c", 3, 1, False), (0, "d", 4, 2, True)], "w long, group_id string, first_sample long, targets long, ready boolean")
    assert sorted(r["group_id"] for r in delivery.ready_groups(g, ["w"], 4).collect()) == ["a", "b"]
    assert delivery.ready_groups(g, ["w"], 9).isEmpty()


def test_feedback_learns():
    c = feedback.Controller([1_000_000.0, 300_000.0, 500_000.0], [300_000.0, 50_000.0])
    rng = np.random.default_rng(3)
    for _ in range(160):
        x = np.array([rng.integers(1, 6), rng.random() * 2, rng.random() * 20], float)
        u = np.array([1.0, rng.integers(1, 60) / 16])
        c.observe(x, float(x @ [250_000, 70_000, 120_000]), u, float(u @ [80_000, 12_000 * 16]))
    assert c.active and not c.fallback
    assert c.io.theta[0] < 600_000
    before = c.io.theta.copy()
    c.observe(np.array([1.0, 0, 1]), 1e12, np.array([1.0, 1.0]), 1e5)
    assert c.active and (c.io.theta < before * 3).all()
    for _ in range(8):
        c.observe(np.array([1.0, 0, 1]), 5e8, np.array([1.0, 1.0]), 272_000.0)
    assert c.fallback
    for _ in range(400):
        c.observe(np.array([1.0, 0, 1]), 370_000.0, np.array([1.0, 1.0]), 272_000.0)
    assert not c.fallback and c.io.tail() >= 1.0


def layout():
    return {r: {d: (d * 100, 20) for d in {r // 4 * 4, r}} for r in range(8)}


def test_samplers():
    from spanforge.model import DEFAULT

    cost = lambda e: sampling.closure_cost(e, CostModel(latency_ns=1000, concurrency=1, decode_fixed_ns=0, decode_unit_ns=10, overlap=0), 100)
    base = [0, 4, 1, 5, 2, 6, 3, 7]
    assert sampling.bounded(base, layout(), 2, 1, cost) == list(range(8))
    out = sampling.bounded(base, layout(), 2, 4, cost)
    assert sorted(out) == list(range(8)) and [base[r] for r in out[:2]] == [0, 1]
    assert max(abs(i - r) for i, r in enumerate(out)) <= 4
    twice = [0, 4, 0, 4, 1, 5]
    assert sorted(sampling.bounded(twice, layout(), 3, 4, cost)) == list(range(6))
    labels = [0, 1, 0, 1, 0, 1, 0, 1]
    out = sampling.label_preserving(base, labels, layout(), 2, 2, cost)
    assert [labels[r] for r in out] == labels and all(r // 4 == i // 4 for i, r in enumerate(out))
    with pytest.raises(ValueError):
        sampling.bounded([], {}, 2, 2, cost)
    assert DEFAULT.concurrency == 8


def test_portfolio(spark):
    row = {k: 0.0 for k in ("portfolio_storage_bytes", "metadata_bytes", "ingestion_ns", "requests_per_sample", "fetched_bytes_per_sample", "decode_ns_per_sample", "p95_ns", "p99_ns", "throughput_samples_s", "cache_bytes", "switch_cost_usd")}
    prices = {"storage_usd_per_byte_month": 1.0, "retention_months": 1.0, "request_usd_per_request": 0.0, "transfer_usd_per_byte": 0.0, "decode_compute_usd_per_ns": 0.0, "ingestion_compute_usd_per_ns": 0.0, "workload_samples": 1.0, "amortization_runs": 1.0, "slo_penalty_usd_per_ns": 1.0}
    offers = spark.createDataFrame([row | {"id": "small", "portfolio_storage_bytes": 1.0, "p95_ns": 50.0, "model_utility": 0.5}, row | {"id": "fast", "portfolio_storage_bytes": 9.0, "p95_ns": 10.0, "model_utility": 0.9}])
    pick = lambda limits: costing.portfolio(offers, prices, limits).filter("selected").first()
    assert pick({})["id"] == "small"
    assert pick({"target_p95_ns": 10.0})["id"] == "fast"
    out = {r["id"]: r["reasons"] for r in costing.portfolio(offers, prices, {"min_model_utility": 0.6, "max_p95_ns": 20.0}).collect()}
    assert out == {"small": "p95_slo,model_utility", "fast": ""}


def test_grammar(spark):
    rows = [(1, "prefix", "prefix", 0), (1, "prefix", "prefix", 1), (2, "normalized", "anchor", 0), (2, "normalized", "delta", 1), (3, "normalized", "delta", 0), (4, "pair", "pair", 0), (5, "pair", "anchor", 0)]
    bad = controls.representation_violations(spark.createDataFrame(rows, "sample_id long, representation string, kind string, position int")).collect()
    assert sorted(r["sample_id"] for r in bad) == [3, 5]


def test_scalars(spark):
    assert scalars.annex_b(b"\0\0\0\2ab\0\0\0\1c", 4) == b"\0\0\0\1ab\0\0\0\1c"
    for bad in (b"\0\0\0\0", b"\0\0\0\5ab", b"\0\0"):
        with pytest.raises(ValueError):
            scalars.annex_b(bad, 4)
    assert scalars.units(b"\0\0\0\1\x67aa\0\0\1\x65bb") == [(7, b"\x67aa"), (5, b"\x65bb")]
    df = spark.createDataFrame([('{"k": 5}',), ('{"k": "-7"}',), ('{"k": "x"}',), (None,)], "j string")
    assert [r["v"] for r in df.select(scalars.json_int(F.col("j"), "$.k").alias("v")).collect()] == [5, -7, None, None]
    r = spark.range(1).select(scalars.ratio_ppm(F.lit(1), F.lit(3)).alias("a"), scalars.ratio_ppm(F.lit(1), F.lit(0)).alias("b"), scalars.ratio_ppm(F.lit(-1), F.lit(3)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (333333, 0, 0)
    ids = [0, 1, 258, (1 << 62) + 5]
    data = spark.createDataFrame([(ids,)], "ids array<long>").select(scalars.encode_closure(F.col("ids")).alias("b")).first()["b"]
    assert bytes(data) == b"".join(i.to_bytes(8, "little") for i in ids)


def test_chunk_file(spark, tmp_path):
    import pyarrow as pa

    data = chunkfile.build(b"cfg", b"abcXXdefghi", pa.table({"record_id": [1, 2]}))
    (tmp_path / "a.chunk").write_bytes(data)
    assert chunkfile.headers(spark, str(tmp_path / "a.chunk")).first()["payload_bytes"] == 11
    assert chunkfile.read_range(spark, str(tmp_path / "a.chunk"), 5, 3) == b"def"
    with pytest.raises(ValueError):
        chunkfile.read_range(spark, str(tmp_path / "a.chunk"), 9, 3)
    for bad in (b"x", b"\0\0\0\x20hello", data + b"!"):
        with pytest.raises(ValueError):
            chunkfile.parse(bad)


def test_keyed_stream_state(spark, tmp_path):
    from spanforge.streaming import pipeline

    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, 8), (1, 1, 16), (2, 0, 5)], "caller long, seq long, value long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("caller long, seq long, value long").parquet(f"{src}/*.parquet")
    q = pipeline.ewma_stream(stream, "caller", "value").writeStream.format("memory").queryName("ewma").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["caller"], r["ewma"], r["seen"]) for r in spark.table("ewma").collect()} == {(1, 9, 2), (2, 5, 1)}


def test_session(spark):
    from spanforge.session import Limits, Session, plan_byte_ranges

    rows = [(i, "v", 0, i, p, t, r) for i, (t, p, r) in enumerate(zip("IBBBP", [0, 3, 2, 4, 1], [0, 4, 4, 4, 4], strict=True))]
    cat = spark.createDataFrame(rows, "record_id long, video_id string, gop_id long, k int, packet_index int, frame_type string, right_ref long").withColumn("frame_idx", F.col("k"))
    cat = cat.withColumn("record_offset", F.col("packet_index").cast("long") * 10).withColumn("record_length", F.lit(7).cast("long"))
    data = spark.createDataFrame([(i, f"<rec {i}>") for i in range(5)], "record_id long, data string")
    req = spark.createDataFrame([(0, 0, 0, 7, "v", 1), (0, 0, 1, 8, "v", 0), (0, 1, 0, 9, "v", 1)], "window_id long, batch_id long, pos long, sample_id long, video_id string, frame_idx int")
    want = __import__("hashlib").sha256(b"<rec 0><rec 4><rec 2><rec 1>").hexdigest()
    with Session(cat, closures.hierarchical(cat), data) as s:
        for action in ("exact_closure", "calibrated_closure", "fixed_gap_closure", "region_all", "keyframe_prefix"):
            got = s.execute(req, action).collect()
            assert [r["sample_id"] for r in got] == [7, 8, 9]
            assert got[0]["digest"] == got[2]["digest"] == want
        with pytest.raises(ValueError):
            s.execute(req, "whatever")
        with pytest.raises(resolve.UnknownTargets):
            s.execute(req.withColumn("frame_idx", F.lit(99)))
    assert Limits(windows=4, callers=3, threads=8, decoder_threads=4).lanes == 2
    with pytest.raises(ValueError):
        Limits(windows=0)
    with pytest.raises(ValueError):
        plan_byte_ranges(spark.createDataFrame([(1, 0, 0)], "record_id long, offset long, length long"), 0)


def test_models_and_tails(spark):
    rows = [(0, i, 1.0, 0.5, 2.0, 4.0, 900_000.0, 120_000.0) for i in range(40)]
    df = spark.createDataFrame(rows, "session long, seq long, f_waves double, f_extra double, f_pages double, f_units double, io_ns double, decode_ns double")
    m = feedback.models(feedback.trace(df, [500_000.0, 1.0, 65_536.0], [20_000.0, 20_000.0]), DEFAULT).orderBy("seq").collect()
    assert not m[0]["in_use"] and m[0]["wave_first_ns"] == DEFAULT.latency_ns and m[0]["io_tail"] == 16.0
    first = next(r["seq"] for r in m if r["in_use"])
    assert first >= 16 and m[first]["io_tail"] == 16.0  # tails start anew when the estimator comes into use
    assert m[39]["in_use"] and 1.0 <= m[39]["io_tail"] < 16.0
    plan = spark.createDataFrame([(39, 1, 131072, 64)], "seq long, ranges long, bytes long, units long")
    by_window = feedback.models(feedback.trace(df, [500_000.0, 1.0, 65_536.0], [20_000.0, 20_000.0]), DEFAULT)
    usual, bad = (feedback.priced(plan, ["seq"], by_window, DEFAULT, x).first() for x in (False, True))
    assert bad["io_ns"] == pytest.approx(usual["io_ns"] * m[39]["io_tail"])


def test_broker_windows_wait_while_saturated(spark):
    a = spark.createDataFrame([(0, i, at, s, 0) for i, (at, s) in enumerate([(0, False), (9, True), (35, False), (50, False), (59, False), (60, False)])], "w int, sample_id int, arrival long, saturated boolean, service long")
    got = delivery.broker_windows(a, ["w"], 3, 10, 40).orderBy("sample_id").collect()
    # the second request finds the store saturated, so the third still joins and fills the window
    assert [r["broker_window"] for r in got] == [0, 0, 0, 1, 1, 2]
    assert {r["broker_window"] for r in delivery.broker_windows(a, ["w"], 1, 10, 40).collect()} == set(range(6))


def test_lanes_by_cohort(spark):
    a = spark.createDataFrame([(0, 0, "a"), (0, 0, "a"), (0, 1, "a"), (0, 1, "b"), (0, 2, "b"), (0, 3, "a"), (0, 3, "c")], "w int, cohort int, video_id string")
    got = {r["cohort"]: r["lane"] for r in delivery.lanes(a, ["w"], 4).collect()}
    assert got == {0: delivery.fnv1a("a") % 4, 1: 0, 2: delivery.fnv1a("b") % 4, 3: 1}


def test_barriers(spark):
    calls = spark.createDataFrame([(0, 1, 9), (0, 2, 4), (0, 5, 30)], "w int, submitted long, ended long")
    marks = spark.createDataFrame([(0, 1, 0), (0, 2, 5), (0, 3, 40)], "w int, barrier long, at long")
    assert [r["passed"] for r in delivery.barriers(calls, ["w"], marks).orderBy("barrier").collect()] == [0, 9, 40]


def test_parameter_sets():
    record = bytes([1, 66, 0, 30, 0xFD, 0xE1, 0, 2]) + b"sp" + bytes([1, 0, 3]) + b"pps"
    assert scalars.parameter_units(record) == (2, b"\0\0\0\1sp\0\0\0\1pps")
    for bad in (b"", b"\2" + record[1:], record[:9], record[:10], record[:-1], bytes([1, 0, 0, 0, 3, 0xE0, 0])):
        with pytest.raises(ValueError):
            scalars.parameter_units(bad)


def test_chunks_round_trip(spark, tmp_path):
    rows = [("v", i, i, 0, i, "P", 100 + 10 * i, 10, bytes([65 + i]) * 10) for i in range(7)]
    df = spark.createDataFrame(rows, "video_id string, record_id long, frame_idx int, gop_id long, packet_index int, frame_type string, record_offset long, record_length long, payload binary")
    placed = chunkfile.placed(df, 25)
    folder = tmp_path.as_uri()
    done = chunkfile.write(placed, folder).collect()
    assert sorted(r["records"] for r in done) == [1, 3, 3] or sum(r["records"] for r in done) == 7
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted(r["object_key"] + ".chunk" for r in done)
    got = chunkfile.ranges(chunkfile.payloads(spark, folder + "/*.chunk"), placed.select("object_key", "offset", "length", "record_id"), "record_id")
    assert {r["record_id"]: bytes(r["data"]) for r in got.collect()} == {r[1]: r[8] for r in rows}
    (tmp_path / "bad.chunk").write_bytes(b"\0\0\0\2{}")
    with pytest.raises(Exception):  # noqa: B017
        chunkfile.payloads(spark, folder + "/*.chunk").collect()


def test_density_sorts_exactly(spark):
    pairs = [(1, 3), (2, 6), (10**9, 3 * 10**9 - 1), (10**9, 3 * 10**9), (10**9 - 1, 3 * 10**9), (7, 2), (0, 5)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(spans.density(F.col("a"), F.col("b"))).collect()]
    from fractions import Fraction

    want = [Fraction(a, b) for a, b in pairs]
    assert [[x < y for y in got] for x in got] == [[x < y for y in want] for x in want]


def test_option_rules(spark):
    from spanforge.operators import ingest

    good = (8, 7, 0, 0, 1, "hierarchical_b")
    cases = [good, (1, *good[1:]), (20, 17, *good[2:]), (7, *good[1:]), (8, 7, 3, 9, 1, good[5]), (8, 7, 1, 7, 1, good[5]), (8, 7, 0, 0, 0, good[5]), (8, 6, 0, 0, 1, "chained_p"), (18, 7, 0, 0, 1, "shared_anchor"), (17, 7, 0, 0, 1, "shared_anchor")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, gop_size int, max_b_frames int, adaptive int, lookahead int, reference_frames int, policy string")
    assert [r["i"] for r in df.withColumn("p", ingest.option_problem()).orderBy("i").collect() if r["p"] is None] == [0, 9]
    with pytest.raises(ValueError):
        ingest.stored(df, ["i"], "all")
