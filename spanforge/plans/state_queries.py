"""Feedback, sampling, residency, admission, delivery, kernels, controls and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import DEFAULT
from ..operators import closures, controls, costing, delivery, feedback, kernels, residency, sampling, spans
from .relations import Relations, query, sql
from .span_queries import _CHOSEN, _TIMED, _dec, _io, _islands, _timed, _tot, plans

WIN = ["window_id"]

# -- controls -------------------------------------------------------------------
@query("representation_violations", sql("""with r as (select t.record_id as sample_id, 'normalized' as representation, string_agg(case when d.packet_index = 0 or (d.record_id = t.record_id and t.record_id % 50 = 3) then 'anchor' else 'delta' end, ',' order by d.packet_index) as kinds
  from turns t join turns d on d.video_id = t.video_id and (d.packet_index = 0 or d.record_id = t.record_id) group by 1)
select * from r where kinds not in ('anchor', 'anchor,delta')""", "turns"))
def representation_violations(t):
    e = closures.shared_anchor(t.turns).select(F.col("target_id").alias("sample_id"), "dep_id", F.col("packet_index").alias("position"))
    odd = (F.col("position") == 0) | ((F.col("dep_id") == F.col("sample_id")) & (F.col("sample_id") % 50 == 3))
    return controls.representation_violations(e.select("sample_id", F.lit("normalized").alias("representation"), F.when(odd, "anchor").otherwise("delta").alias("kind"), "position"))


@query("normalized_spans", sql("""with l as (select video_id, packet_index as ordinal, record_offset as o, record_length as n from turns where record_id % 7 <> 3),
 m as (select *, case when lag(ordinal) over w is not null and (lag(o + n) over w <> o or ordinal <> lag(ordinal) over w + 1) then 1 else 0 end as broken from l window w as (partition by video_id order by ordinal))
select video_id, ordinal, min(o) over w as span_offset, cast(sum(n) over w as bigint) as span_length, max(broken) over w = 0 as contiguous from m window w as (partition by video_id order by ordinal rows unbounded preceding)""", "turns"))
def normalized_spans(t):
    """Groups of which a seventh of the members is missing, so that some aren't contiguous."""
    kept = t.turns.filter("record_id % 7 <> 3")
    return controls.normalized_spans(kept.select("video_id", F.col("packet_index").alias("ordinal"), F.col("record_offset").alias("offset"), F.col("record_length").alias("length")), ["video_id"])


@query("anchor_metrics", sql("""select window_id, count(distinct (video_id, gop_id)) as unique_anchors, count(*) - count(distinct (video_id, gop_id)) as anchor_reuse_hits from targets group by 1""", "targets"))
def anchor_metrics(t):
    first = t.catalog.filter("frame_type = 'I'").select("video_id", "gop_id", F.col("record_id").alias("anchor_id"))
    return controls.anchor_metrics(t.targets.join(first, ["video_id", "gop_id"]), WIN)


@query("normalized_layout", sql("select video_id, gop_id, min(record_offset) as region_offset, max(record_offset + record_length) - min(record_offset) as region_length, count(*) as members, min(record_id) as anchor_record, -1 - min(record_id) as synthetic_id from turns group by 1, 2", "turns"))
def normalized_layout(t):
    return controls.normalized_layout(t.turns)


@query("layout_violations", sql("""with reg as (select video_id, gop_id, min(record_offset) as o, max(record_offset + record_length) - min(record_offset) - case when gop_id = 1 then 1 else 0 end as l from catalog where gop_id <> 2 group by 1, 2)
select c.record_id, case when reg.o is null then 'no region' else 'outside region' end as reason from catalog c left join reg on reg.video_id = c.video_id and reg.gop_id = c.gop_id
where reg.o is null or c.record_offset < reg.o or c.record_offset + c.record_length > reg.o + reg.l""", "catalog"))
def layout_violations(t):
    reg = closures.regions(t.catalog).filter("gop_id <> 2").withColumn("region_length", F.col("region_length") - F.when(F.col("gop_id") == 1, 1).otherwise(0)).drop("records")
    return controls.layout_violations(t.catalog, reg, t.closure)


_ADAPT = f"""{_islands(16384)},
ac as (select window_id, 'prefix' as mode, cast(row_number() over (partition by window_id order by video_id, gop_id) - 1 as int) as position, len as length, cast(sum(n) over (partition by window_id) as bigint) as units from (
    select m.window_id, m.video_id, m.gop_id, max(record_offset + record_length) - min(record_offset) as len, count(*) as n from (select window_id, video_id, gop_id, max(packet_index) as last from targets group by 1, 2, 3) m
    join catalog c on c.video_id = m.video_id and c.gop_id = m.gop_id and c.packet_index <= m.last group by 1, 2, 3)
  union all select s.window_id, 'sparse', cast(row_number() over (partition by s.window_id order by span) - 1 as int), span_length, u.n from s_16384 s join (select window_id, count(*) as n from needed group by 1) u on u.window_id = s.window_id)"""


def _adaptive(t: Relations):
    p = closures.keyframe_prefix(t.targets, t.catalog, WIN)
    prefix = p.select("window_id", F.lit("prefix").alias("mode"), (F.row_number().over(W.partitionBy("window_id").orderBy("video_id", "gop_id")) - 1).alias("position"), F.col("span_length").alias("length"), F.sum("records").over(W.partitionBy("window_id")).alias("units"))
    u = t.needed.groupBy("window_id").agg(F.count(F.lit(1)).alias("units"))
    sparse = spans.merged(t.needed, WIN, 16384).join(u, "window_id").select("window_id", F.lit("sparse").alias("mode"), (F.row_number().over(W.partitionBy("window_id").orderBy("span")) - 1).alias("position"), F.col("span_length").alias("length"), "units")
    return prefix.unionByName(sparse)


@query("adaptive_candidates", sql(f"with {_ADAPT} select * from ac", "needed"))
def adaptive_candidates(t):
    return _adaptive(t)


@query("adaptive_choice", sql(f"""with {_ADAPT}, aw as (select window_id, mode, units, floor(position / 8) as w, max({DEFAULT.latency_ns}::double + length / {DEFAULT.bytes_per_ns}::double) as m, count(*) as n, sum(length) as b from ac group by 1, 2, 3, 4),
 at1 as (select window_id, mode, units, sum(m) as io_ns, cast(sum(n) as bigint) as ranges, cast(sum(b) as bigint) as bytes from aw group by 1, 2, 3),
 at2 as (select *, units * (case mode when 'prefix' then 2500::double else 3000::double end) as decode_ns from at1), at3 as (select *, {_tot(DEFAULT)} as total_ns from at2)
select window_id, mode, ranges, bytes, units, round(io_ns, 6) as io_ns, round(total_ns, 6) as total_ns, row_number() over (partition by window_id order by total_ns, mode) = 1 as selected from at3""", "needed"))
def adaptive_choice(t):
    out = costing.mechanistic(_adaptive(t), WIN, DEFAULT, {"prefix": 2500.0, "sparse": 3000.0})
    return out.select("window_id", "mode", "ranges", "bytes", "units", F.round("io_ns", 6).alias("io_ns"), F.round("total_ns", 6).alias("total_ns"), "selected")


_PRICES = {"storage_usd_per_byte_month": 2e-11, "retention_months": 3.0, "request_usd_per_request": 4e-7, "transfer_usd_per_byte": 1e-10, "decode_compute_usd_per_ns": 1e-14, "ingestion_compute_usd_per_ns": 1e-14, "workload_samples": 1e6, "amortization_runs": 10.0, "slo_penalty_usd_per_ns": 1e-7}
_LIMITS = {"max_p95_ns": 9e6, "min_throughput_samples_s": 30.0, "max_portfolio_storage_bytes": 140_000.0, "target_p95_ns": 4e6, "target_p99_ns": 8e6, "min_model_utility": 0.25}


@query("portfolio_select", sql(f"""with o as (select video_id as id, cast(sum(record_length) as double) as st, count(*) * 8.0::double as md, count(*) * 1e5::double as ing, count(distinct gop_id) / 4.0::double as req, cast(sum(record_length) as double) / count(*) as fe, count(*) * 2e3::double as de,
    count(*) filter (frame_type = 'B') * 2.5e5::double as p95, count(*) filter (frame_type = 'B') * 4e5::double as p99, 1e4::double / count(*) as th, count(*) * 10.0::double as ca, (min(record_length) % 10) / 10.0::double as mu, 0.01::double as sw from catalog group by 1),
 z as (select *, (st + md) * 2e-11::double * 3.0::double as a1, req * 1e6::double * 4e-7::double as a2, fe * 1e6::double * 1e-10::double as a3, de * 1e6::double * 1e-14::double as a4, ing * 1e-14::double / 10.0::double as a5, sw as a6,
    (greatest(p95 - 4e6::double, 0.0::double) + greatest(p99 - 8e6::double, 0.0::double)) * 1e-7::double as a7,
    array_to_string(list_filter([case when p95 > 9e6 then 'p95_slo' end, case when th < 30.0 then 'throughput' end, case when st + md > 140000.0 then 'portfolio_storage' end, case when mu < 0.25 then 'model_utility' end], lambda x: x is not null), ',') as reasons from o),
 y as (select *, 0.0::double + a1 + a2 + a3 + a4 + a5 + a6 + a7 as total from z)
select id, round(total, 6) as total_usd, round(a7, 6) as slo_penalty_usd, reasons, reasons = '' and row_number() over (order by case when reasons = '' then 0 else 1 end, total, id) = 1 as selected from y""", "catalog"))
def portfolio_select(t):
    n, b = F.count(F.lit(1)), F.count_if(F.col("frame_type") == "B")
    offers = t.catalog.groupBy(F.col("video_id").alias("id")).agg(
        F.sum("record_length").cast("double").alias("portfolio_storage_bytes"), (n * 8.0).alias("metadata_bytes"), (n * 1e5).alias("ingestion_ns"), (F.countDistinct("gop_id") / 4.0).alias("requests_per_sample"),
        (F.sum("record_length").cast("double") / n).alias("fetched_bytes_per_sample"), (n * 2e3).alias("decode_ns_per_sample"), (b * 2.5e5).alias("p95_ns"), (b * 4e5).alias("p99_ns"), (F.lit(1e4) / n).alias("throughput_samples_s"),
        (n * 10.0).alias("cache_bytes"), ((F.min("record_length") % 10) / 10.0).alias("model_utility"), F.first(F.lit(0.01)).alias("switch_cost_usd"),
    )
    return costing.portfolio(offers, _PRICES, _LIMITS).select("id", F.round("total_usd", 6).alias("total_usd"), F.round("slo_penalty_usd", 6).alias("slo_penalty_usd"), "reasons", "selected")


_PAIRSEL = """
pp as (select t.window_id, t.record_id as sample_id, count(*) as requests, any_value(c.record_length) as bytes from targets t join catalog c on c.record_id = t.record_id group by 1, 2),
po as (select *, row_number() over (partition by window_id order by cast(requests * 1000000000000 // bytes as bigint) desc, requests desc, bytes, sample_id) as n from pp),
pf as (select window_id, n, sample_id, bytes <= 60000 as selected, case when bytes <= 60000 then bytes else 0 end as used from po where n = 1
  union all select o.window_id, o.n, o.sample_id, f.used + o.bytes <= 60000, case when f.used + o.bytes <= 60000 then f.used + o.bytes else f.used end from pf f join po o on o.window_id = f.window_id and o.n = f.n + 1)"""


@query("select_pairs", sql(f"with {_PAIRSEL} select window_id, sample_id, selected from pf", "targets", recursive=True))
def select_pairs(t):
    p = t.targets.groupBy("window_id", F.col("record_id").alias("sample_id")).agg(F.count(F.lit(1)).alias("requests"))
    return costing.select_pairs(p.join(t.catalog.select(F.col("record_id").alias("sample_id"), F.col("record_length").alias("bytes")), "sample_id"), 60_000, WIN)


@query("fuse_decision", sql("""
with gq as (select *, dense_rank() over (partition by window_id order by video_id, gop_id) - 1 as group_id from (select distinct window_id, video_id, gop_id, record_id, packet_index from targets)),
 gi as (select *, row_number() over (partition by window_id, group_id order by packet_index, record_id) - 1 as idx from gq), has as (select gi.*, c.frame_type <> 'I' as d from gi join catalog c on c.record_id = gi.record_id),
 ra as (select window_id, (group_id + idx) % 4 as s, sum(5000::double + case when d then 2000::double else 0::double end) as l from has group by 1, 2), r as (select window_id, max(l) as repeated_ns from ra group by 1),
 fa as (select window_id, group_id, 5000::double + sum(case when d then 2000::double else 0::double end) as l from has group by 1, 2), fb as (select window_id, group_id % 4 as s, sum(l) as l from fa group by 1, 2), ff as (select window_id, max(l) as fused_ns from fb group by 1)
select r.window_id, repeated_ns, fused_ns, fused_ns < repeated_ns as fuse from r join ff on ff.window_id = r.window_id""", "targets"))
def fuse_decision(t):
    one = t.targets.select("window_id", "video_id", "gop_id", "record_id", "packet_index").distinct()
    g = one.withColumn("group_id", F.dense_rank().over(W.partitionBy("window_id").orderBy("video_id", "gop_id")) - 1)
    g = g.withColumn("index", F.row_number().over(W.partitionBy("window_id", "group_id").orderBy("packet_index", "record_id")) - 1)
    return costing.fuse(g.join(t.catalog.select("record_id", (F.col("frame_type") != "I").alias("has_delta")), "record_id"), WIN, 4, 5000.0, 2000.0)


_LOCAL = "loc as (select record_id, video_id, gop_id, frame_idx as pts, packet_index - 4 as dts, cast(row_number() over (partition by video_id, gop_id order by packet_index) - 1 as bigint) as ordinal, record_offset, record_length from catalog)"


def _local(t: Relations):
    at = F.row_number().over(W.partitionBy("video_id", "gop_id").orderBy("packet_index")) - 1
    return t.catalog.select("record_id", "video_id", "gop_id", F.col("frame_idx").alias("pts"), (F.col("packet_index") - 4).alias("dts"), at.cast("long").alias("ordinal"), "record_offset", "record_length")


_RELEASE = f"""{_LOCAL}, rt as (select distinct window_id, video_id, gop_id, frame_idx as pts from targets),
 re as (select rt.window_id, rt.video_id, rt.gop_id, rt.pts, coalesce(min(l.ordinal) filter (l.dts > rt.pts), max(l.ordinal)) as r, max(l.ordinal) as last from rt join loc l on l.video_id = rt.video_id and l.gop_id = rt.gop_id group by 1, 2, 3, 4)"""


@query("release_ordinal", sql(f"with {_RELEASE} select window_id, video_id, gop_id, cast(least(max(r) + 1, max(last)) as bigint) as release_ordinal from re group by 1, 2, 3", "targets"))
def release_ordinal(t):
    tg = t.targets.select("window_id", "video_id", "gop_id", F.col("frame_idx").alias("pts"))
    return costing.release_ordinal(tg, _local(t), 2)


# live cursor against the ordinary plan, for groups a window touches more than once
_CURSOR = f"""{_LOCAL},
 cg as (select distinct t.window_id, t.video_id, t.gop_id, t.batch_id, t.record_id, t.frame_idx from targets t),
 cm as (select cg.window_id, cg.video_id, cg.gop_id, cg.batch_id, max(l.ordinal) as closure_max from cg join closure c on c.target_id = cg.record_id join loc l on l.record_id = c.dep_id group by 1, 2, 3, 4),
 cr0 as (select cg.window_id, cg.video_id, cg.gop_id, cg.batch_id, cg.frame_idx, coalesce(min(l.ordinal) filter (l.dts > cg.frame_idx), max(l.ordinal)) as r, max(l.ordinal) as last from cg join loc l on l.video_id = cg.video_id and l.gop_id = cg.gop_id group by 1, 2, 3, 4, 5),
 cr as (select window_id, video_id, gop_id, batch_id, least(max(r) + 1, max(last)) as release_max from cr0 group by 1, 2, 3, 4),
 cq as (select cm.*, greatest(closure_max, release_max) as req from cm join cr using (window_id, video_id, gop_id, batch_id)),
 cp as (select *, coalesce(max(req + 1) over (partition by window_id, video_id, gop_id order by batch_id rows between unbounded preceding and 1 preceding), 0) as prev, row_number() over (partition by window_id, video_id, gop_id order by batch_id) as n from cq),
 cs as (select cp.*, greatest(req + 1 - prev, 0) as units, case when prev <= req then b.record_offset + b.record_length - a.record_offset else 0 end as bytes, case when prev <= req then 1 else 0 end as ranges
   from cp left join loc a on a.video_id = cp.video_id and a.gop_id = cp.gop_id and a.ordinal = cp.prev left join loc b on b.video_id = cp.video_id and b.gop_id = cp.gop_id and b.ordinal = cp.req),
 cost1 as (select window_id, video_id, gop_id, count(*) as batches, sum({_tot(DEFAULT, _io(DEFAULT), "(case when units > 0 then units * 3000::double + case when n = 1 then 20000::double else 0::double end else 0::double end)")}) as cursor_ns from cs group by 1, 2, 3),
 cn as (select distinct cg.window_id, cg.video_id, cg.gop_id, cg.batch_id, c.dep_id from cg join closure c on c.target_id = cg.record_id),
 cj as (select window_id, video_id, gop_id, max(u * 3000::double + 20000::double) as decode_ns from (select window_id, video_id, gop_id, batch_id, count(*) as u from cn group by 1, 2, 3, 4) group by 1, 2, 3),
 cu as (select x.window_id, x.video_id, x.gop_id, sum(c.record_length) as bytes, count(*) as ranges from (select distinct window_id, video_id, gop_id, dep_id from cn) x join catalog c on c.record_id = x.dep_id group by 1, 2, 3),
 cost2 as (select cu.window_id, cu.video_id, cu.gop_id, {_tot(DEFAULT, _io(DEFAULT), 'decode_ns')} as adaptive_ns from cu join cj using (window_id, video_id, gop_id)),
 cc as (select *, cursor_ns <= adaptive_ns + {DEFAULT.tolerance_ns} as cost_effective from cost1 join cost2 using (window_id, video_id, gop_id) where batches > 1)"""


def _cursor(t: Relations):
    """Cost of extending one live decoder over a group's batches, against fetching exact closures and decoding the batches in parallel."""
    key, loc = ["window_id", "video_id", "gop_id"], _local(t)
    asked = t.targets.select(*key, "batch_id", "record_id", "frame_idx").distinct()
    deps = asked.select(*key, "batch_id", F.col("record_id").alias("target_id")).join(t.closure.select("target_id", F.col("dep_id").alias("record_id")), "target_id")
    reach = deps.join(loc.select("record_id", "ordinal"), "record_id").groupBy(*key, "batch_id").agg(F.max("ordinal").alias("_c"))
    out = asked.select(*key, "batch_id", "frame_idx").distinct().join(loc.select("video_id", "gop_id", "ordinal", "dts"), ["video_id", "gop_id"])
    each = out.groupBy(*key, "batch_id", "frame_idx").agg(F.coalesce(F.min(F.when(F.col("dts") > F.col("frame_idx"), F.col("ordinal"))), F.max("ordinal")).alias("_r"), F.max("ordinal").alias("_l"))
    release = each.groupBy(*key, "batch_id").agg(F.least(F.max("_r") + 1, F.max("_l")).alias("_r"))
    o = W.partitionBy(*key).orderBy("batch_id")
    q = reach.join(release, [*key, "batch_id"]).withColumn("_q", F.greatest("_c", "_r"))
    q = q.withColumn("_p", F.coalesce(F.max(F.col("_q") + 1).over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.row_number().over(o))
    at = lambda name, col: loc.select("video_id", "gop_id", F.col("ordinal").alias(name), col)
    q = q.join(at("_p", F.col("record_offset").alias("_a")), ["video_id", "gop_id", "_p"], "left").join(at("_q", (F.col("record_offset") + F.col("record_length")).alias("_b")), ["video_id", "gop_id", "_q"], "left")
    more = F.col("_p") <= F.col("_q")
    units, size, n = F.greatest(F.col("_q") + 1 - F.col("_p"), F.lit(0)), F.when(more, F.col("_b") - F.col("_a")).otherwise(0), F.when(more, 1).otherwise(0)
    dec = F.when(units > 0, units * DEFAULT.decode_unit_ns + F.when(F.col("_n") == 1, DEFAULT.decode_fixed_ns).otherwise(0.0)).otherwise(0.0)
    cursor = q.withColumn("_t", DEFAULT.total(DEFAULT.io(n, size), dec)).groupBy(*key).agg(F.count(F.lit(1)).alias("batches"), F.sum("_t").alias("cursor_ns"))
    own = deps.select(*key, "batch_id", "record_id").distinct()
    decode = own.groupBy(*key, "batch_id").agg(F.count(F.lit(1)).alias("u")).groupBy(*key).agg(F.max(DEFAULT.decode(F.col("u"))).alias("_d"))
    fetch = own.select(*key, "record_id").distinct().join(t.catalog.select("record_id", "record_length"), "record_id").groupBy(*key).agg(F.sum("record_length").alias("_b"), F.count(F.lit(1)).alias("_n"))
    adaptive = fetch.join(decode, key).select(*key, DEFAULT.total(DEFAULT.io(F.col("_n"), F.col("_b")), F.col("_d")).alias("adaptive_ns"))
    return cursor.join(adaptive, key).filter("batches > 1").withColumn("cost_effective", F.col("cursor_ns") <= F.col("adaptive_ns") + DEFAULT.tolerance_ns)


@query("cursor_cost", sql(f"with {_CURSOR} select window_id, video_id, gop_id, batches, round(cursor_ns, 6) as cursor_ns, round(adaptive_ns, 6) as adaptive_ns, cost_effective from cc", "targets", "closure"))
def cursor_cost(t):
    return _cursor(t).select("window_id", "video_id", "gop_id", "batches", F.round("cursor_ns", 6).alias("cursor_ns"), F.round("adaptive_ns", 6).alias("adaptive_ns"), "cost_effective")


@query("cursor_gate", sql(f"with {_CURSOR}, v as (select window_id, count(distinct video_id) = 1 as single_video from targets group by 1) select v.window_id, single_video, coalesce(bool_or(cost_effective), false) as any_effective, single_video and coalesce(bool_or(cost_effective), false) as use_cursor from v left join cc on cc.window_id = v.window_id group by 1, 2", "targets", "closure"))
def cursor_gate(t):
    v = t.targets.groupBy("window_id").agg((F.countDistinct("video_id") == 1).alias("single_video"))
    g = _cursor(t).groupBy("window_id").agg(F.max("cost_effective").alias("_e"))
    return v.join(g, "window_id", "left").select("window_id", "single_video", F.coalesce("_e", F.lit(False)).alias("any_effective"), (F.col("single_video") & F.coalesce("_e", F.lit(False))).alias("use_cursor"))


@query("cursor_keys", sql(f"with {_CURSOR} select window_id, count(*) as candidates, count(*) filter (cost_effective) as selected from cc group by 1", "targets", "closure"))
def cursor_keys(t):
    return _cursor(t).groupBy("window_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("cost_effective").alias("selected"))


# -- feedback -------------------------------------------------------------------
_OBS = f"{_TIMED}, ob as (select window_id, count(*) as ranges, cast(sum(span_length) as bigint) as bytes, max(end_ns) as io_ns, (select count(*) from needed n where n.window_id = timed.window_id) as units from timed group by 1)"


def _observed(t: Relations):
    o = _timed(t).groupBy("window_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum("span_length").alias("bytes"), F.max("end_ns").alias("io_ns"))
    return o.join(t.needed.groupBy("window_id").agg(F.count(F.lit(1)).alias("units")), "window_id")


@query("feedback_features", sql(f"with {_OBS} select window_id, ceil(ranges / 8.0::double) as f_waves, greatest(ranges - ceil(ranges / 8.0::double), 0) / 8.0::double as f_extra, round(bytes / 65536.0::double, 6) as f_pages, round(units / 16.0::double, 6) as f_units from ob", "needed"))
def feedback_features(t):
    f = feedback.features(_observed(t), 8)
    return f.select("window_id", "f_waves", "f_extra", F.round("f_pages", 6).alias("f_pages"), F.round("f_units", 6).alias("f_units"))


@query("tail_multiplier", sql("""with q as (select caller, sample_id as seq, least(greatest(0.2::double + (sample_id * 37 % 100) / 25.0::double, 0.25), 16.0) as r from requests),
 v as (select caller, seq, list_sort(list(r) over (partition by caller order by seq rows between 127 preceding and current row)) as l from q)
select caller, seq, round(greatest(1.0, l[cast(ceil(len(l) * 0.95::double) as int)]), 6) as tail from v""", "catalog", "requests"))
def tail_multiplier(t):
    r = t.requests.select("caller", F.col("sample_id").alias("seq"), (F.lit(0.2) + (F.col("sample_id") * 37 % 100) / F.lit(25.0)).alias("ratio"))
    return feedback.tail_multiplier(r, ["caller"]).select("caller", "seq", F.round("tail", 6).alias("tail"))


@query("service_ewma", sql("""with q as (select caller, sample_id as seq, 1000 + sample_id * 7919 % 5000 as v, row_number() over (partition by caller order by sample_id) as n from requests),
 e as (select caller, seq, n, v as ewma from q where n = 1 union all select q.caller, q.seq, q.n, (7 * e.ewma + q.v) // 8 from e join q on q.caller = e.caller and q.n = e.n + 1)
select caller, seq, ewma from e""", "catalog", "requests", recursive=True))
def service_ewma(t):
    return feedback.service_ewma(t.requests.select("caller", F.col("sample_id").alias("seq"), (F.col("sample_id") * 7919 % 5000 + 1000).alias("value")), ["caller"])


@query("window_stats", sql("select window_id, count(*) as targets, count(distinct batch_id) as batches, max(pos) as last_pos, max(sample_id) as last_sample from targets group by 1", "targets"))
def window_stats(t):
    return t.targets.groupBy("window_id").agg(F.count(F.lit(1)).alias("targets"), F.countDistinct("batch_id").alias("batches"), F.max("pos").alias("last_pos"), F.max_by("sample_id", F.struct("batch_id", "pos")).alias("last_sample"))


@query("session_metrics", sql(f"with {_CHOSEN} select kind, count(*) as windows, cast(sum(ranges) as bigint) as ranges, cast(sum(bytes) as bigint) as bytes, max(units) as max_units, count(*) filter (kind = 'region') as region_windows from chosen group by 1", "marked"))
def session_metrics(t):
    c = costing.choose(plans(t), WIN, DEFAULT)
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("windows"), F.sum("ranges").alias("ranges"), F.sum("bytes").alias("bytes"), F.max("units").alias("max_units"), F.count_if(F.col("kind") == "region").alias("region_windows"))


@query("joint_attribution", sql(f"with {_islands(16384)}, s as (select window_id, count(*) as gets from s_16384 group by 1), cq as (select distinct window_id, caller from targets) select cq.window_id, caller, case when row_number() over (partition by cq.window_id order by caller) = 1 then gets else 0 end as gets from cq join s on s.window_id = cq.window_id", "needed"))
def joint_attribution(t):
    s = spans.merged(t.needed, WIN, 16384).groupBy("window_id").agg(F.count(F.lit(1)).alias("_g"))
    first = F.row_number().over(W.partitionBy("window_id").orderBy("caller")) == 1
    return t.targets.select("window_id", "caller").distinct().join(s, "window_id").select("window_id", "caller", F.when(first, F.col("_g")).otherwise(0).alias("gets"))


@query("trace_capped", sql("select caller, sample_id, n as expected, greatest(n - 50, 0) as dropped from (select *, count(*) over (partition by caller) as n, row_number() over (partition by caller order by sample_id) as r from requests) where r <= 50", "catalog", "requests"))
def trace_capped(t):
    return feedback.capped_trace(t.requests.select("caller", "sample_id"), ["caller"], "sample_id", 50)


@query("percentile_linear", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def percentile_linear(t):
    e = t.table("events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


# -- sampling -------------------------------------------------------------------
def _sampler(t: Relations, labelled: bool):
    labels = t.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    of = t.identified.select("record_id", F.col("id").alias("doc_id")).join(labels, "doc_id", "left").select("record_id", F.coalesce("quality", F.lit(-1)).alias("label"))
    rank = F.row_number().over(W.partitionBy("window_id").orderBy("batch_id", "pos")) - 1
    samples = t.targets.withColumn("rank", rank).select("window_id", "rank", "record_id").join(of, "record_id")
    return sampling.plan(samples, t.placed_closure, WIN, 32, 16 if not labelled else 2, labelled)


@query("sampler_bounded")
def sampler_bounded(t):
    return _sampler(t, False).select("window_id", "rank", "record_id", "position")


@query("sampler_label")
def sampler_label(t):
    return _sampler(t, True).select("window_id", "rank", "record_id", "position", "label")


@query("label_sequence_preserved", sql("""select window_id, count(*) as samples, cast(0 as bigint) as changed from targets group by 1""", "targets"))
def label_sequence_preserved(t):
    return _sampler(t, True).groupBy("window_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("label") != F.col("emitted_label")).alias("changed"))


@query("displacement", sql("select window_id, max(abs(r - p)) as max_displacement, round(avg(abs(r - p)), 6) as mean_displacement from (select window_id, row_number() over (partition by window_id order by batch_id, pos) - 1 as r, row_number() over (partition by window_id order by record_id, batch_id, pos) - 1 as p from targets) group by 1", "targets"))
def displacement(t):
    """How far sorting each window by record would move its samples."""
    r = F.row_number().over(W.partitionBy("window_id").orderBy("batch_id", "pos")) - 1
    p = F.row_number().over(W.partitionBy("window_id").orderBy("record_id", "batch_id", "pos")) - 1
    out = sampling.displacement(t.targets.select("window_id", r.alias("rank"), p.alias("position")), WIN)
    return out.select("window_id", F.col("max_displacement").cast("long").alias("max_displacement"), "mean_displacement")


# -- residency ------------------------------------------------------------------
_LIVE = """
lv as (select t.window_id, t.batch_id, cl.dep_id, count(*) as consumers from (select distinct window_id, batch_id, record_id from targets) t join closure cl on cl.target_id = t.record_id and cl.dep_id <> t.record_id group by 1, 2, 3),
vr as (select *, cast(consumers - 1 + coalesce(sum(consumers) over (partition by window_id, dep_id order by batch_id rows between 1 following and unbounded following), 0) as bigint) as reuses from lv)"""
_MONO = """
dor as (select record_id, cast(row_number() over (partition by video_id, gop_id order by frame_idx) - 1 as int) as ordinal from catalog),
mo as (select distinct t.window_id, t.video_id, t.gop_id, t.batch_id, d.ordinal from targets t join dor d on d.record_id = t.record_id),
mn as (select window_id, video_id, gop_id, batch_id, count(*) as n, max(ordinal) as max_ordinal from mo group by 1, 2, 3, 4),
mf as (select mn.window_id, mn.video_id, mn.gop_id, mn.batch_id, count(distinct mo.ordinal) as f, min(mo.batch_id) as next_use from mn join mo on mo.window_id = mn.window_id and mo.video_id = mn.video_id and mo.gop_id = mn.gop_id and mo.batch_id > mn.batch_id and mo.ordinal > mn.max_ordinal group by 1, 2, 3, 4),
mr as (select mn.window_id, mn.video_id, mn.gop_id, mn.batch_id, max_ordinal, n - 1 + coalesce(f, 0) as reuses, next_use from mn left join mf using (window_id, video_id, gop_id, batch_id))"""


@query("window_liveness", sql(f"with {_LIVE} select window_id, batch_id, dep_id, consumers from lv", "targets", "closure"))
def window_liveness(t):
    return residency.liveness(t.targets, t.closure, WIN)


@query("visible_reuses", sql(f"with {_LIVE} select window_id, batch_id, dep_id, consumers, reuses from vr", "targets", "closure"))
def visible_reuses(t):
    return residency.visible_reuses(residency.liveness(t.targets, t.closure, WIN), WIN)


def _mono(t: Relations):
    return residency.monotonic(t.targets, closures.display_ordinals(t.catalog), WIN)


@query("monotonic_reuses", sql(f"with {_MONO} select * from mr", "targets"))
def monotonic_reuses(t):
    return _mono(t)


_RC = f"""{_LIVE}, {_MONO},
 sh as (select x.window_id, x.video_id, x.gop_id, x.batch_id, coalesce(sum(v.reuses), 0) as r from (select distinct t.window_id, t.video_id, t.gop_id, t.batch_id, cl.dep_id from targets t join closure cl on cl.target_id = t.record_id) x left join vr v on v.window_id = x.window_id and v.batch_id = x.batch_id and v.dep_id = x.dep_id group by 1, 2, 3, 4),
 pc as (select x.window_id, x.video_id, x.gop_id, x.batch_id, count(*) filter (c.frame_idx > x.m) as potential_consumers from (select window_id, video_id, gop_id, batch_id, max(frame_idx) as m from targets group by 1, 2, 3, 4) x join catalog c on c.video_id = x.video_id and c.gop_id = x.gop_id group by 1, 2, 3, 4),
 rc as (select mr.window_id, mr.video_id, mr.gop_id, mr.batch_id, case when r > 0 then reuses else 0 end as visible_consumers, potential_consumers, case when r > 0 then next_use end as next_use from mr join sh using (window_id, video_id, gop_id, batch_id) join pc using (window_id, video_id, gop_id, batch_id))"""


def _resident(t: Relations):
    reuse = residency.visible_reuses(residency.liveness(t.targets, t.closure, WIN), WIN)
    return residency.candidates(_mono(t), reuse, t.closure, t.targets, t.catalog, WIN)


@query("resident_candidates", sql(f"with {_RC} select *, (visible_consumers > 0 and next_use is not null) or potential_consumers > 0 as admit from rc", "targets", "closure"))
def resident_candidates(t):
    return residency.admitted(_resident(t))


@query("liveness_victim", sql(f"""with {_RC}, st as (select *, row_number() over (partition by window_id, batch_id order by video_id, gop_id) - 1 as age_rank, visible_consumers > 0 as pinned from rc)
select window_id, batch_id, video_id, gop_id from st qualify row_number() over (partition by window_id, batch_id order by pinned, case when pinned then 0 else age_rank end, case when pinned then coalesce(next_use, 4611686018427387904) end desc, age_rank desc) = 1""", "targets", "closure"))
def liveness_victim(t):
    age = F.row_number().over(W.partitionBy("window_id", "batch_id").orderBy("video_id", "gop_id")) - 1
    return residency.victim(_resident(t).withColumn("age_rank", age).withColumn("pinned", F.col("visible_consumers") > 0), ["window_id", "batch_id"]).select("window_id", "batch_id", "video_id", "gop_id")


@query("lru_trace", sql("""with ac as (select t.window_id as lane, row_number() over (partition by t.window_id order by batch_id, pos) as seq, t.record_id, c.record_length as length from targets t join catalog c on c.record_id = t.record_id),
 lr as (select distinct lane, 0::bigint as seq, null::bigint as record_id, false as hit, 0 as evicted, []::struct(r bigint, l bigint)[] as held from ac
  union all select lane, seq, record_id, hit, case when hit or not fits then 0 else cast(len(held) - len(room) as int) end,
    case when hit then list_append(list_filter(held, lambda x: x.r <> record_id), {'r': record_id, 'l': length}) when fits then list_append(room, {'r': record_id, 'l': length}) else held end
  from (select *, list_filter(held, lambda x, i: length + list_sum(list_transform(held[i:], lambda y: y.l)) <= 65536) as room from (
    select a.lane, a.seq, a.record_id, a.length, lr.held, len(list_filter(lr.held, lambda x: x.r = a.record_id)) > 0 as hit, a.length > 0 and a.length <= 65536 as fits from lr join ac a on a.lane = lr.lane and a.seq = lr.seq + 1)))
select lane, seq, record_id, hit, evicted, cast(coalesce(list_sum(list_transform(held, lambda x: x.l)), 0) as bigint) as resident_bytes from lr where seq > 0""", "targets", recursive=True))
def lru_trace(t):
    seq = F.row_number().over(W.partitionBy("window_id").orderBy("batch_id", "pos"))
    a = t.targets.select(F.col("window_id").alias("lane"), seq.cast("long").alias("seq"), "record_id").join(t.catalog.select("record_id", F.col("record_length").alias("length")), "record_id")
    return residency.lru_trace(a, 65_536)


@query("read_ahead", sql("""with mm as (select window_id, video_id, gop_id, max(packet_index) as last, count(distinct batch_id) > 1 as hit from targets group by 1, 2, 3),
 gr as (select m.*, c.packet_index as ordinal, c.record_length as length, cast(sum(case when c.packet_index <= last then c.record_length else 0 end) over w as bigint) as held, cast(sum(c.record_length) over w as bigint) as whole
   from mm m join catalog c on c.video_id = m.video_id and c.gop_id = m.gop_id window w as (partition by m.window_id, m.video_id, m.gop_id)),
 a as (select *, case when hit or whole <= 16384 then least(greatest(16384 - held, 0), 8192) else 0 end as allowance from gr where ordinal > last)
select window_id, video_id, gop_id, ordinal, length, allowance from (select *, sum(length) over (partition by window_id, video_id, gop_id order by ordinal) as s from a) where s <= allowance""", "targets"))
def read_ahead(t):
    """Only a group that is used again, or that fits the cache as a whole, is read ahead, as far as the cache has room."""
    key = ["window_id", "video_id", "gop_id"]
    last = t.targets.groupBy(*key).agg(F.max("packet_index").alias("_l"), (F.countDistinct("batch_id") > 1).alias("hit"))
    g = last.join(t.catalog.select("video_id", "gop_id", F.col("packet_index").alias("ordinal"), F.col("record_length").alias("length")), ["video_id", "gop_id"])
    w = W.partitionBy(*key)
    g = g.withColumn("held", F.sum(F.when(F.col("ordinal") <= F.col("_l"), F.col("length")).otherwise(0)).over(w)).withColumn("whole", F.sum("length").over(w))
    g = g.withColumn("allowance", residency.allowance(F.col("hit"), F.col("whole"), F.col("held"), 16_384, 8_192)).filter(F.col("ordinal") > F.col("_l"))
    return residency.read_ahead(g.select(*key, "ordinal", "length", "allowance"), key, F.col("allowance"))


@query("cursor_can_serve", sql(f"with {_MONO} select *, prev is null or max_ordinal > prev as can_serve from (select window_id, video_id, gop_id, batch_id, max_ordinal, max(max_ordinal) over (partition by window_id, video_id, gop_id order by batch_id rows between unbounded preceding and 1 preceding) as prev from mn)", "targets"))
def cursor_can_serve(t):
    prev = F.max("max_ordinal").over(W.partitionBy("window_id", "video_id", "gop_id").orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1))
    return _mono(t).withColumn("prev", prev).select("window_id", "video_id", "gop_id", "batch_id", "max_ordinal", "prev", (F.col("prev").isNull() | (F.col("max_ordinal") > F.col("prev"))).alias("can_serve"))


@query("budget_partition", "select lane, cast(1000003 // 7 + case when lane < 1000003 % 7 then 1 else 0 end as bigint) as bytes from range(7) r(lane)")
def budget_partition(t):
    lane = F.col("id")
    return t.spark.range(7).select(lane.alias("lane"), (F.lit(1_000_003 // 7) + F.when(lane < 1_000_003 % 7, 1).otherwise(0)).cast("long").alias("bytes"))


@query("cache_rebalance", sql("select window_id, cast(greatest(1048576 - sum(length) filter (record_id % 4 = 0), 0) as bigint) as cache_bytes from needed group by 1", "needed"))
def cache_rebalance(t):
    ahead = F.sum(F.when(F.col("record_id") % 4 == 0, F.col("length")))
    return t.needed.groupBy("window_id").agg(F.greatest(F.lit(1 << 20) - ahead, F.lit(0)).cast("long").alias("cache_bytes"))


@query("single_gop", sql("select window_id, batch_id, count(distinct (video_id, gop_id)) = 1 as single_gop from targets group by 1, 2", "targets"))
def single_gop(t):
    return t.targets.groupBy("window_id", "batch_id").agg((F.countDistinct("video_id", "gop_id") == 1).alias("single_gop"))


@query("resident_reservation", sql("select x.window_id, cast(sum(2 * l) as bigint) as reserved_bytes, cast(sum(2 * l) as bigint) <= 4194304 as admitted from (select distinct window_id, video_id, gop_id from targets) x join (select video_id, gop_id, sum(record_length) as l from catalog group by 1, 2) gg using (video_id, gop_id) group by 1", "targets"))
def resident_reservation(t):
    g = t.catalog.groupBy("video_id", "gop_id").agg(F.sum("record_length").alias("_l"))
    r = t.targets.select("window_id", "video_id", "gop_id").distinct().join(g, ["video_id", "gop_id"]).groupBy("window_id").agg(F.sum(F.col("_l") * 2).alias("reserved_bytes"))
    return r.withColumn("admitted", F.col("reserved_bytes") <= 4 << 20)


# -- admission and delivery -----------------------------------------------------
_COHORT = """
ar as (select window_id, sample_id, arrival_us, row_number() over (partition by window_id order by arrival_us, sample_id) as n from requests),
ch as (select window_id, sample_id, arrival_us, n, 0 as cohort, arrival_us as t0, 1 as k from ar where n = 1
 union all select a.window_id, a.sample_id, a.arrival_us, a.n, case when j then c.cohort else c.cohort + 1 end, case when j then c.t0 else a.arrival_us end, case when j then c.k + 1 else 1 end
 from ch c join ar a on a.window_id = c.window_id and a.n = c.n + 1, lateral (select a.arrival_us <= c.t0 + 600000000 and c.k < 8 as j) x)"""


def _cohorts(t: Relations):
    return delivery.cohorts(t.requests.select("window_id", "sample_id", F.col("arrival_us").alias("arrival")), WIN, 600_000_000, 8)


@query("admission_cohorts", sql(f"with {_COHORT} select window_id, sample_id, arrival_us as arrival, cohort from ch", "catalog", "requests", recursive=True))
def admission_cohorts(t):
    return _cohorts(t)


@query("joint_window", sql(f"with {_COHORT} select window_id, cohort, count(*) as calls, min(arrival_us) as opened, max(arrival_us) as closed from ch group by 1, 2", "catalog", "requests", recursive=True))
def joint_window(t):
    return _cohorts(t).groupBy("window_id", "cohort").agg(F.count(F.lit(1)).alias("calls"), F.min("arrival").alias("opened"), F.max("arrival").alias("closed"))


_FNV = """
vb as (select distinct video_id, encode(video_id) as b from requests),
fh as (select video_id, b, 1 as i, 14695981039346656037::hugeint as h from vb
 union all select video_id, b, i + 1, (xor(h, ascii(chr(('0x' || substr(hex(b), 2 * i - 1, 2))::int))::hugeint) * 1099511628211::hugeint) % 18446744073709551616::hugeint from fh where i <= octet_length(b)),
fl as (select video_id, cast(h % 4 as int) as lane from fh where i = octet_length(b) + 1)"""


@query("lane_routing", sql(f"""with {_COHORT}, {_FNV}, c as (select ch.window_id, cohort, min(video_id) as v, min(video_id) = max(video_id) as single, count(*) as calls from ch join requests r on r.window_id = ch.window_id and r.sample_id = ch.sample_id group by 1, 2),
 x as (select *, sum(case when single then 0 else 1 end) over (partition by window_id order by cohort rows unbounded preceding) - 1 as turn from c)
select x.window_id, x.cohort, calls, single, case when single then fl.lane else cast(turn % 4 as int) end as lane from x left join fl on fl.video_id = x.v""", "catalog", "requests", recursive=True))
def lane_routing(t):
    return delivery.lanes(_cohorts(t).join(t.requests.select("window_id", "sample_id", "video_id"), ["window_id", "sample_id"]), WIN, 4)


@query("restore_order", sql("select window_id, batch_id, pos, sample_id, record_id from targets", "targets"))
def restore_order(t):
    """Distinct records joined back to every request: duplicates, batches and positions return."""
    done = t.targets.select("window_id", "record_id").distinct()
    return t.targets.select("window_id", "batch_id", "pos", "sample_id", "record_id").join(done, ["window_id", "record_id"]).select("window_id", "batch_id", "pos", "sample_id", "record_id").orderBy("window_id", "batch_id", "pos")


_READY = f"""{_TIMED}, sp as (select i.window_id, i.record_id, tm.end_ns from i_16384 i join timed tm on tm.window_id = i.window_id and tm.span = i.span),
 rd as (select t.window_id, t.batch_id, t.video_id, t.gop_id, max(sp.end_ns) as ready_ns from targets t join closure cl on cl.target_id = t.record_id join sp on sp.window_id = t.window_id and sp.record_id = cl.dep_id group by 1, 2, 3, 4)"""


def _ready(t: Relations):
    s = spans.numbered(t.needed, WIN, 16384).select("window_id", "record_id", "span").join(_timed(t).select("window_id", "span", "end_ns"), ["window_id", "span"])
    e = t.targets.select("window_id", "batch_id", "video_id", "gop_id", F.col("record_id").alias("target_id")).join(t.closure.select("target_id", F.col("dep_id").alias("record_id")), "target_id")
    return e.join(s, ["window_id", "record_id"]).groupBy("window_id", "batch_id", "video_id", "gop_id").agg(F.max("end_ns").alias("ready_ns"))


@query("task_ready", sql(f"with {_READY} select * from rd", "needed"))
def task_ready(t):
    return _ready(t)


@query("ordered_delivery", sql(f"with {_READY}, b as (select window_id, batch_id, max(ready_ns) as ready from rd group by 1, 2) select *, max(ready) over (partition by window_id order by batch_id) as delivered from b", "needed"))
def ordered_delivery(t):
    return delivery.ordered_delivery(_ready(t).groupBy("window_id", "batch_id").agg(F.max("ready_ns").alias("ready")), WIN)


@query("ready_groups", sql(f"""with {_READY}, gr as (select t.window_id, t.video_id || '/' || cast(t.gop_id as varchar) as group_id, min(t.sample_id) as first_sample, count(*) as targets, max(rd.ready_ns) <= 150000 as ready
   from targets t join rd on rd.window_id = t.window_id and rd.batch_id = t.batch_id and rd.video_id = t.video_id and rd.gop_id = t.gop_id group by 1, 2),
 gs as (select *, coalesce(sum(targets) over (partition by window_id order by first_sample, group_id rows between unbounded preceding and 1 preceding), 0) as b, sum(targets) over (partition by window_id) as a from gr where ready)
select window_id, group_id, first_sample, targets, ready from gs where b < 64 and a >= 64""", "needed"))
def ready_groups(t):
    rd = t.targets.join(_ready(t), ["window_id", "batch_id", "video_id", "gop_id"])
    g = rd.groupBy("window_id", F.concat_ws("/", "video_id", F.col("gop_id").cast("string")).alias("group_id")).agg(F.min("sample_id").alias("first_sample"), F.count(F.lit(1)).alias("targets"), (F.max("ready_ns") <= 150_000).alias("ready"))
    return delivery.ready_groups(g, WIN, 64)


@query("use_completion", sql(f"""with {_islands(16384)}, n as (select window_id, count(*) as ranges from s_16384 group by 1),
 one as (select t.window_id, t.record_id, count(distinct i.span) as spans, min(i.span) as span from (select distinct window_id, record_id from targets) t join closure cl on cl.target_id = t.record_id join i_16384 i on i.window_id = t.window_id and i.record_id = cl.dep_id group by 1, 2),
 best as (select window_id, max(k) as most from (select window_id, span, count(*) as k from one where spans = 1 group by 1, 2) group by 1)
select n.window_id, ranges, coalesce(most, 0) as most_ready, ranges > 1 and (coalesce(most, 0) >= 32 or ranges > 32) as use_completion from n left join best on best.window_id = n.window_id""", "needed"))
def use_completion(t):
    """Decoding as ranges arrive pays if one range alone makes a micro-batch of targets ready, or if there are more ranges than a micro-batch has targets."""
    s = spans.numbered(t.needed, WIN, 16384).select("window_id", "record_id", "span")
    e = t.targets.select("window_id", F.col("record_id").alias("target_id")).distinct().join(t.closure.select("target_id", F.col("dep_id").alias("record_id")), "target_id").join(s, ["window_id", "record_id"])
    one = e.groupBy("window_id", "target_id").agg(F.countDistinct("span").alias("_n"), F.min("span").alias("span")).filter("_n = 1")
    best = one.groupBy("window_id", "span").agg(F.count(F.lit(1)).alias("k")).groupBy("window_id").agg(F.max("k").alias("_m"))
    n = s.groupBy("window_id").agg(F.countDistinct("span").alias("ranges"))
    most = F.coalesce("_m", F.lit(0))
    return n.join(best, "window_id", "left").select("window_id", "ranges", most.alias("most_ready"), ((F.col("ranges") > 1) & ((most >= 32) | (F.col("ranges") > 32))).alias("use_completion"))


@query("microbatch", sql("select window_id, record_id, cast(floor((row_number() over (partition by window_id order by \"offset\", record_id) - 1) / 64) as bigint) as microbatch from needed", "needed"))
def microbatch(t):
    return delivery.microbatches(t.needed.select("window_id", "record_id", "offset"), WIN, ["offset", "record_id"], 64).drop("offset")


@query("fetch_phases", sql("select window_id, record_id, first_batch, cast(dense_rank() over (partition by window_id order by first_batch) - 1 as int) as phase from (select t.window_id, cl.dep_id as record_id, min(t.batch_id) as first_batch from targets t join closure cl on cl.target_id = t.record_id group by 1, 2)", "targets", "closure"))
def fetch_phases(t):
    e = t.targets.select("window_id", "batch_id", F.col("record_id").alias("target_id")).join(t.closure, "target_id").groupBy("window_id", F.col("dep_id").alias("record_id")).agg(F.min("batch_id").alias("first_batch"))
    return e.withColumn("phase", F.dense_rank().over(W.partitionBy("window_id").orderBy("first_batch")) - 1)


_OCC = "oc as (select window_id, sample_id, arrival_us as a, arrival_us + 1000000 * (60 + sample_id * 13 % 600) as b from requests), oe as (select window_id, sample_id, a as tt, 1 as d from oc union all select window_id, sample_id, b, -1 from oc)"


@query("admission_occupancy", sql(f"with {_OCC}, ro as (select *, sum(d) over (partition by window_id order by tt, d, sample_id rows unbounded preceding) as o from oe) select window_id, sample_id, cast(o as bigint) as open from ro where d = 1", "catalog", "requests"))
def admission_occupancy(t):
    c = t.requests.select("window_id", "sample_id", F.col("arrival_us").alias("a"), (F.col("arrival_us") + 1_000_000 * (F.lit(60) + F.col("sample_id") * 13 % 600)).alias("b"))
    return delivery.occupancy(c, WIN, "a", "b")


@query("pipeline_occupancy", sql(f"with {_OCC}, ro as (select *, sum(d) over (partition by window_id order by tt, d, sample_id rows unbounded preceding) as o from oe) select window_id, cast(max(o) as bigint) as peak from ro group by 1", "catalog", "requests"))
def pipeline_occupancy(t):
    c = t.requests.select("window_id", F.col("arrival_us").alias("a"), (F.col("arrival_us") + 1_000_000 * (F.lit(60) + F.col("sample_id") * 13 % 600)).alias("b"))
    return spans.peak(c, WIN, "a", "b")


@query("transient_reservation", sql(f"""with {_islands(16384)}, ft as (select window_id, cast(sum(span_length) as bigint) as fetched from s_16384 group by 1), e as (select window_id, cast(sum(length) as bigint) as encoded from needed group by 1),
 n as (select window_id, count(*) as targets from targets group by 1), r as (select ft.window_id, 2 * fetched + 4 * encoded * 6 + 3 * 64 * targets as reserved_bytes from ft join e on e.window_id = ft.window_id join n on n.window_id = ft.window_id)
select window_id, reserved_bytes, reserved_bytes <= 33554432 as admitted from r""", "needed"))
def transient_reservation(t):
    f = spans.merged(t.needed, WIN, 16384).groupBy("window_id").agg(F.sum("span_length").alias("_f"))
    e = t.needed.groupBy("window_id").agg(F.sum("length").alias("_e"))
    n = t.targets.groupBy("window_id").agg(F.count(F.lit(1)).alias("_n"))
    return f.join(e, "window_id").join(n, "window_id").select("window_id", (F.col("_f") * 2 + F.col("_e") * 4 * (4 + 2) + F.col("_n") * 3 * 64).alias("reserved_bytes")).withColumn("admitted", F.col("reserved_bytes") <= 32 << 20)


@query("fetch_profile", sql(f"with {_TIMED} select window_id, count(*) as ranges, cast(sum(end_ns - start_ns) as bigint) as service_ns, max(end_ns) as last_ns, cast(count(*) filter (span % 11 = 10) as bigint) as missing from timed group by 1", "needed"))
def fetch_profile(t):
    """Completions put back in the order of the plan; those that never came are missing."""
    plan = _timed(t)
    came = plan.filter(F.col("span") % 11 != 10).select("window_id", "span", F.lit(1).alias("_c"))
    return plan.join(came, ["window_id", "span"], "left").groupBy("window_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("service_ns"), F.max("end_ns").alias("last_ns"), F.count_if(F.col("_c").isNull()).alias("missing"))


@query("backend_accounting", sql(f"with {_islands(16384)}, n as (select window_id, count(*) as ranges, cast(sum(span_length) as bigint) as bytes from s_16384 group by 1) select window_id, backend, case backend when 'batch' then 1 when 'mapped' then 0 else ranges end as client_requests, case backend when 'mapped' then 0 else ranges end as server_entries, bytes from n, (values ('mapped'), ('ranges'), ('batch')) b(backend)", "needed"))
def backend_accounting(t):
    """A batch request is one call with an entry a range; mapped files make none."""
    n = spans.merged(t.needed, WIN, 16384).groupBy("window_id").agg(F.count(F.lit(1)).alias("_r"), F.sum("span_length").alias("bytes"))
    b = n.withColumn("backend", F.explode(F.array(*map(F.lit, ("mapped", "ranges", "batch")))))
    none = F.col("backend") == "mapped"
    return b.select("window_id", "backend", F.when(F.col("backend") == "batch", 1).when(none, 0).otherwise(F.col("_r")).alias("client_requests"), F.when(none, 0).otherwise(F.col("_r")).alias("server_entries"), "bytes")


# -- kernels --------------------------------------------------------------------
@query("decode_groups", sql("select cl.target_id, sha256(string_agg(c.text, '' order by cl.packet_index)) as digest, cast(sum(strlen(c.text)) as bigint) as width, cast(count(*) as int) as units from closure cl join catalog_text c on c.record_id = cl.dep_id group by 1", "closure"))
def decode_groups(t):
    return kernels.digest(kernels.jobs(t.closure, t.payloads, t.catalog))


@query("decode_jobs", sql("select cl.target_id, cast(count(*) as int) as units, cast(count(*) filter (cl.packet_index < c.packet_index) as int) as ordinal, c.video_id, c.gop_id from closure cl join catalog c on c.record_id = cl.target_id group by 1, c.video_id, c.gop_id, c.packet_index", "closure"))
def decode_jobs(t):
    return kernels.jobs(t.closure, t.payloads, t.catalog).select("target_id", F.size("parts").alias("units"), "ordinal", "video_id", "gop_id")


# -- scalar functions -----------------------------------------------------------
@query("json_int", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_int(t):
    return t.table("events").select("event_id", scalars.json_int(F.col("props"), "$.k").alias("k"))


@query("hex_parse", "select doc_id, sha256(text) as digest, cast(strlen(text) as bigint) as bytes from documents")
def hex_parse(t):
    """Every text written as a dump of 16 bytes a line and read back."""
    d = t.table("documents").select("doc_id", F.hex(F.col("text").cast("binary")).alias("h"))
    line = F.regexp_replace(F.regexp_replace(F.lower("h"), "(.{1,32})", "00000000: $1  text\n"), "([0-9a-f]{4})(?=[0-9a-f]{2})", "$1 ")
    back = d.select("doc_id", scalars.parse_hex(F.regexp_replace(line, "0000 0000: ", "00000000: ")).alias("data"))
    return back.select("doc_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("bytes"))


@query("ratio_ppm", sql("select window_id, case when sum(length) > 0 then cast(round(sum(length) filter (record_id % 2 = 0) / sum(length) :: double * 1e6) as bigint) else 0 end as ppm from needed group by 1", "needed"))
def ratio_ppm(t):
    n = t.needed.groupBy("window_id").agg(F.sum(F.when(F.col("record_id") % 2 == 0, F.col("length"))).alias("_p"), F.sum("length").alias("_w"))
    return n.select("window_id", scalars.ratio_ppm(F.col("_p"), F.col("_w")).alias("ppm"))


@query("closure_codec", sql("select target_id, list(dep_id order by packet_index) as ids from closure group by 1", "closure"))
def closure_codec(t):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("packet_index", "dep_id"))), lambda x: x["dep_id"])
    packed = t.closure.groupBy("target_id").agg(ids.alias("ids")).select("target_id", scalars.encode_closure(F.col("ids")).alias("data"))
    return packed.select("target_id", scalars.decode_closure(F.col("data")).alias("ids"))
