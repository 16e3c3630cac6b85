"""Scans, ingestion, resolution and closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closures, ingest, resolve, scans
from .relations import Relations, query, sql

# -- scans ----------------------------------------------------------------------
_CAT = "record_id, video_id, class_name, frame_idx, gop_id, packet_index, frame_type, record_offset, record_length, k, k_last, right_ref"


@query("scan_catalog", sql(f"select {_CAT} from catalog", "catalog"))
def scan_catalog(t: Relations):
    return t.catalog


@query("video_ids", "select distinct source as video_id from documents")
def video_ids(t):
    return scans.video_ids(t.catalog)


@query("frame_indices", sql("select distinct frame_idx from catalog where video_id = 'src3'", "catalog"))
def frame_indices(t):
    return scans.frame_indices(t.catalog, "src3")


@query("record_count", "select count(*) as records from documents")
def record_count(t):
    return t.catalog.agg(F.count(F.lit(1)).alias("records"))


@query("catalog_violations", sql("""with br as (
  select record_id, case when record_id % 40 = 5 then '' else video_id end as video_id, case record_id % 40 when 2 then -1 - cast(record_id as int) when 7 then 1000003 else frame_idx end as frame_idx, gop_id,
    case when record_id % 40 = 3 then 0 else packet_index end as packet_index, case when record_id % 40 = 11 then null else record_offset end as record_offset, case when record_id % 40 = 1 then 0 else record_length end as record_length from catalog
  union all select record_id, video_id, frame_idx, gop_id, packet_index, record_offset, record_length from catalog where record_id % 40 = 9)
select record_id, unnest(list_filter([case when record_offset is null then 'null' end, case when video_id = '' then 'empty video' end, case when frame_idx < 0 or gop_id < 0 or record_offset < 0 then 'negative' end,
    case when record_length <= 0 then 'empty record' end, case when record_offset + record_length > (select max(record_offset) from catalog) then 'outside payload' end], lambda x: x is not null)) as reason from br
union all select record_id, 'duplicate id' from br group by 1 having count(*) > 1
union all select min(record_id), 'duplicate frame' from br group by video_id, frame_idx having count(*) > 1
union all select record_id, 'decode order' from (select *, lag(packet_index) over (partition by video_id order by record_offset nulls first, record_id) as b from br) where b >= packet_index""", "catalog"))
def catalog_violations(t):
    """The catalog with faults of every sort put in."""
    at, c = F.col("record_id") % 40, t.catalog
    last = c.agg(F.max("record_offset")).first()[0] or 0  # one number
    broken = c.select(
        "record_id", F.when(at == 5, "").otherwise(F.col("video_id")).alias("video_id"),
        F.when(at == 2, -1 - F.col("record_id")).when(at == 7, 1_000_003).otherwise(F.col("frame_idx")).cast("int").alias("frame_idx"), "gop_id",
        F.when(at == 3, 0).otherwise(F.col("packet_index")).alias("packet_index"), F.when(at == 11, None).otherwise(F.col("record_offset")).alias("record_offset"),
        F.when(at == 1, 0).otherwise(F.col("record_length")).alias("record_length"),
    )
    return scans.violations(broken.unionByName(c.filter(at == 9).select(*broken.columns)), last)


_TIERS = """
with keys as (select video_id, gop_id, frame_idx, record_length as length, count(*) over (partition by video_id) as n,
    row_number() over (partition by video_id order by gop_id) - 1 as nth from catalog where frame_type = 'I'),
 tiered as (select 0 as tier, * from keys where nth = n // 2 union all select 1, * from keys where nth % 4 = 0 union all select 2, * from keys),
 tier_index as (select video_id, tier, cast(sum(length) over (order by tier, video_id, gop_id rows between unbounded preceding and current row) - length as bigint) as "offset",
   length, frame_idx, gop_id, 'idr' as dependency_kind from tiered)
"""


@query("scan_tier_index", sql(_TIERS + "select * from tier_index", "catalog"))
def _tier_index(t):
    return scans.tiers(t.catalog)


@query("tiered_layout", sql(_TIERS + "select tier, count(*) as records, min(\"offset\") as first_offset, cast(sum(length) as bigint) as bytes from tier_index group by tier", "catalog"))
def tiered_layout(t):
    return scans.tiers(t.catalog).groupBy("tier").agg(F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"), F.sum("length").alias("bytes"))


@query("lookup_all", sql(_TIERS + "select * from tier_index where video_id = 'src5' and tier = 2", "catalog"))
def lookup_all(t):
    return scans.tiers(t.catalog).filter((F.col("video_id") == "src5") & (F.col("tier") == 2))


_AT = "row_number() over (partition by video_id, tier order by \"offset\") - 1"


@query("records_range", sql(_TIERS + f"select * from (select *, cast({_AT} as int) as nth from tier_index) where nth >= 1 and nth < 3", "catalog"))
def records_range(t):
    return scans.slice_of(scans.tiers(t.catalog), 1, 2)


@query("lookup_at", sql(_TIERS + f"select * exclude (nth) from (select *, {_AT} as nth from tier_index) where nth = 1", "catalog"))
def lookup_at(t):
    return scans.nth(scans.tiers(t.catalog), 1)


@query("record_count_for", sql(_TIERS + """
select a.video_id, a.tier, cast(count(x.video_id) as bigint) as records from (select distinct source as video_id, t.tier from documents, (values (0), (1), (2), (7)) t(tier)) a
left join tier_index x on x.video_id = a.video_id and x.tier = a.tier group by a.video_id, a.tier""", "catalog"))
def record_count_for(t):
    asked = t.catalog.select("video_id").distinct().select("video_id", F.explode(F.array(*map(F.lit, (0, 1, 2, 7)))).alias("tier"))
    return scans.counts_for(scans.tiers(t.catalog), asked)


# -- ingestion ------------------------------------------------------------------
@query("ingest_catalog", sql("select record_id, video_id, frame_idx, gop_id, packet_index, frame_type, record_offset, record_length from turns", "turns"))
def ingest_catalog(t):
    return t.turns


@query("payload_offsets", sql("select record_id, record_offset, record_length from catalog", "catalog"))
def payload_offsets(t):
    return t.catalog.select("record_id", "record_offset", "record_length")


@query("probe_ordinals", sql("""
select video_id, record_id, cast(frame_idx as bigint) * 40 as pts, cast(row_number() over (partition by video_id order by frame_idx) - 1 as int) as display_ordinal, false as duplicate_pts from catalog""", "catalog"))
def probe_ordinals(t):
    return ingest.probe_ordinals(t.catalog.select("video_id", "record_id", (F.col("frame_idx").cast("long") * 40).alias("pts")))


@query("max_b_run", sql("""
select video_id, cast(max(n) as bigint) as max_b_run from (
  select video_id, run, count(*) filter (frame_type = 'B') as n from (
    select *, sum(case when frame_type = 'B' then 0 else 1 end) over (partition by video_id order by frame_idx) as run from catalog) group by 1, 2) group by 1""", "catalog"))
def max_b_run(t):
    return ingest.longest_b_run(t.catalog)


@query("build_stats", sql("""
with s as (select target_id, count(*) as size from closure group by 1), l as (select list_sort(list(size)) as v, count(*) as n, avg(size) as m, max(size) as x from s)
select count(*) as records, count(*) filter (frame_type = 'I') as n_i, count(*) filter (frame_type = 'P') as n_p, count(*) filter (frame_type = 'B') as n_b,
  count(distinct (video_id, gop_id)) as gops, round(any_value(m), 6) as closure_mean, any_value(x) as closure_max,
  any_value(v[cast(ceil((n - 1) * 0.5) as int) + 1]) as closure_median, any_value(v[cast(ceil((n - 1) * 0.95) as int) + 1]) as closure_p95 from catalog, l""", "catalog", "closure"))
def build_stats(t):
    return ingest.build_stats(t.catalog, t.closure)


@query("fused_layout", sql("""
select record_id, video_id, gop_id, case when row_number() over (partition by video_id, gop_id order by packet_index) = 1 then 'anchor' else 'delta' end as kind,
  cast(sum(record_length) over (order by video_id, gop_id, packet_index rows between unbounded preceding and current row) - record_length as bigint) as new_offset, record_length as length from catalog""", "catalog"))
def fused_layout(t):
    return ingest.fused_layout(t.catalog)


@query("two_level_layout", sql("""
with r as (select *, row_number() over g - 1 as nth from catalog window g as (partition by video_id, gop_id order by packet_index)),
 pg as (select *, cast(nth // 4 as bigint) as page from r)
select record_id, video_id, gop_id, page, first(record_id) over g as root_id, first(record_id) over q as checkpoint_id, first(record_offset) over g as root_offset,
  first(record_offset) over q as checkpoint_offset, record_offset as target_offset,
  cast(len(list_distinct([first(record_id) over g, first(record_id) over q, record_id])) as bigint) as closure_size
from pg window g as (partition by video_id, gop_id order by packet_index), q as (partition by video_id, gop_id, page order by packet_index)""", "catalog"))
def two_level_layout(t):
    return ingest.two_level_layout(t.catalog)


_PAIRS = """
pairs as (select c.record_id as sample_id, c.video_id, a.record_id as anchor_id, case when a.record_id <> c.record_id then c.record_id end as delta_id
  from turns c join (select video_id, min(record_id) as record_id from turns group by 1) a on a.video_id = c.video_id)"""


def _pairs(t: Relations):
    first = t.turns.groupBy("video_id").agg(F.min("record_id").alias("anchor_id"))
    return t.turns.join(first, "video_id").select(F.col("record_id").alias("sample_id"), "video_id", "anchor_id", F.when(F.col("anchor_id") != F.col("record_id"), F.col("record_id")).alias("delta_id"))


@query("materialize_pairs", sql(f"""
with {_PAIRS}, txt as (select row_number() over (order by conv_id, turn) - 1 as record_id, text from conversations),
 d as (select sample_id, video_id, a.text || coalesce(b.text, '') as data from pairs join txt a on a.record_id = anchor_id left join txt b on b.record_id = delta_id)
select sample_id, video_id, cast(sum(strlen(data)) over (partition by video_id order by sample_id) - strlen(data) as bigint) as "offset", cast(strlen(data) as bigint) as length, sha256(data) as sha256 from d""", "turns"))
def materialize_pairs(t):
    texts = t.table("conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("frame_idx"), "text").join(t.turns, ["video_id", "frame_idx"]).select("record_id", "text")
    return ingest.materialize_pairs(_pairs(t), texts)


@query("encode_params", sql("""
select video_id, cast(greatest(max(n), 8) as bigint) as max_gop, bool_or(p) as any_anchor_p from (
  select video_id, gop_id, count(*) as n, bool_or(frame_type = 'P') as p from catalog group by 1, 2) group by 1""", "catalog"))
def encode_params(t):
    return ingest.encode_parameters(t.catalog)


@query("frame_count_check", sql("""
select video_id, count(*) as packets, count(distinct frame_idx) as frames, case when count(*) <> count(distinct frame_idx) then 'mismatch' when count(distinct frame_idx) > 7 then 'too many' else 'ok' end as verdict
from turns group by 1""", "turns"))
def frame_count_check(t):
    return ingest.frame_count_check(t.turns, 7)


# -- resolution -----------------------------------------------------------------
@query("resolve_targets", sql("select sample_id, window_id, batch_id, pos, video_id, frame_idx, record_id from targets", "targets"))
def resolve_targets(t):
    return resolve.resolve(t.requests, t.catalog.select("video_id", "frame_idx", "record_id"), strict=True).select("sample_id", "window_id", "batch_id", "pos", "video_id", "frame_idx", "record_id")


@query("unknown_targets", sql("""
select sample_id, video_id, frame_idx + 20 as frame_idx from requests r where not exists (select 1 from catalog c where c.video_id = r.video_id and c.frame_idx = r.frame_idx + 20)""", "catalog", "requests"))
def unknown_targets(t):
    shifted = t.requests.select("sample_id", "video_id", (F.col("frame_idx") + 20).alias("frame_idx"))
    return resolve.unknown(shifted, t.catalog)


@query("unique_targets", sql("""
select window_id, record_id, batch_id, pos, sample_id from (select *, row_number() over (partition by window_id, record_id order by batch_id, pos) as n from targets) where n = 1""", "targets"))
def unique_targets(t):
    return resolve.first_occurrences(t.targets, ["window_id"]).select("window_id", "record_id", "batch_id", "pos", "sample_id")


@query("batch_resolve_rr", sql(_TIERS + """
, c as (select *, row_number() over (partition by video_id, tier order by "offset") - 1 as j, count(*) over (partition by video_id, tier) as n from tier_index),
 q as (select sample_id as request_id, video_id, cast(sample_id % 3 as int) as tier, row_number() over (partition by video_id, sample_id % 3 order by sample_id) - 1 as i from requests)
select request_id, q.video_id, q.tier, c."offset", c.length, c.frame_idx from q join c on c.video_id = q.video_id and c.tier = q.tier and c.j = q.i % c.n""", "catalog", "requests"))
def batch_resolve_rr(t):
    asked = t.requests.select(F.col("sample_id").alias("request_id"), "video_id", (F.col("sample_id") % 3).cast("int").alias("tier"))
    return resolve.round_robin(asked, scans.tiers(t.catalog))


@query("tier_record_index", sql("""
with s as (select video_id, count(*) as records from catalog where frame_type = 'I' group by 1)
select sample_id, r.video_id, frame_idx, cast(least(floor(frame_idx / 8), records - 1) as bigint) as record_index from requests r join s on s.video_id = r.video_id""", "catalog", "requests"))
def tier_record_index(t):
    sizes = t.catalog.filter("frame_type = 'I'").groupBy("video_id").agg(F.count(F.lit(1)).alias("records"))
    return resolve.tier_record(t.requests, sizes, 8, 4, 2, clamp=True)


@query("infer_gop_size", sql(_TIERS + """
select coalesce((select step from (select frame_idx - lag(frame_idx) over (partition by video_id order by frame_idx) as step from tier_index where tier = 2) where step > 0
  group by step order by count(*) desc, step limit 1), 8) :: bigint as gop_size""", "catalog"))
def infer_gop_size(t):
    return resolve.modal_gap(scans.tiers(t.catalog), 2, 8)


@query("fragment_resolve", sql("""
with fr as (select video_id, gop_id, min(record_offset) as fragment_offset, max(record_offset + record_length) - min(record_offset) as fragment_length from catalog group by 1, 2)
select sample_id, r.video_id, cast(frame_idx // 16 as bigint) as gop_id, frame_idx % 16 as ordinal, fragment_offset, fragment_length from requests r
left join fr on fr.video_id = r.video_id and fr.gop_id = frame_idx // 16""", "catalog", "requests"))
def fragment_resolve(t):
    parts = closures.regions(t.catalog).select("video_id", "gop_id", F.col("region_offset").alias("fragment_offset"), F.col("region_length").alias("fragment_length"))
    return resolve.fragments(t.requests, parts, 16).select("sample_id", "video_id", "gop_id", "ordinal", "fragment_offset", "fragment_length")


@query("route_pairs", sql("""
select window_id, batch_id, pos, sample_id, record_id, branch, cast(row_number() over (partition by window_id, branch order by batch_id, pos) - 1 as bigint) as branch_pos
from (select *, case when record_id % 3 = 0 then 'pair' else 'fallback' end as branch from targets)""", "targets"))
def route_pairs(t):
    have = t.catalog.filter(F.col("record_id") % 3 == 0).select("record_id")
    return resolve.route_pairs(t.targets, have).select("window_id", "batch_id", "pos", "sample_id", "record_id", "branch", "branch_pos")


@query("dependency_kind", sql(_TIERS + "select video_id, tier, min(dependency_kind) as dependency_kind from tier_index group by 1, 2", "catalog"))
def dependency_kind(t):
    return scans.tiers(t.catalog).groupBy("video_id", "tier").agg(F.min_by("dependency_kind", "offset").alias("dependency_kind"))


# -- closures -------------------------------------------------------------------
@query("closure_hier_b", sql("select target_id, dep_id, packet_index from closure", "closure"))
def closure_hier_b(t):
    return t.closure


@query("closure_chained_p", sql("select t.record_id as target_id, d.record_id as dep_id, d.packet_index from turns t join turns d on t.video_id = d.video_id and d.packet_index <= t.packet_index", "turns"))
def closure_chained_p(t):
    return closures.chained(t.turns)


@query("closure_shared_anchor", sql("""
with a as (select video_id, min(record_id) as dep_id, min(packet_index) as packet_index from turns group by 1)
select record_id as target_id, record_id as dep_id, packet_index from turns
union select t.record_id, a.dep_id, a.packet_index from turns t join a on a.video_id = t.video_id""", "turns"))
def closure_shared_anchor(t):
    return closures.shared_anchor(t.turns)


@query("closure_violations", sql("""
with broken as (select target_id, dep_id, packet_index from closure where not (target_id % 7 = 0 and dep_id = target_id))
select t.record_id as target_id, case when count(b.dep_id) = 0 then 'empty' else 'without target' end as reason from catalog t left join broken b on b.target_id = t.record_id
group by 1 having count(*) filter (b.dep_id = t.record_id) <> 1""", "closure"))
def closure_violations(t):
    broken = t.closure.filter(~((F.col("target_id") % 7 == 0) & (F.col("dep_id") == F.col("target_id"))))
    return closures.violations(broken, t.catalog)


@query("closure_union", sql("select window_id, record_id, \"offset\", length, video_id, gop_id, packet_index from needed", "needed"))
def closure_union(t):
    return t.needed


@query("closure_minus_resident", sql("select window_id, record_id, \"offset\", length from needed n where record_id % 5 <> 0", "needed"))
def closure_minus_resident(t):
    held = t.needed.filter(F.col("record_id") % 5 == 0)
    return closures.without(t.needed, held, ["window_id"]).select("window_id", "record_id", "offset", "length")


@query("gop_regions", sql("select video_id, gop_id, min(record_offset) as region_offset, max(record_offset + record_length) - min(record_offset) as region_length, count(*) as records from catalog group by 1, 2", "catalog"))
def gop_regions(t):
    return closures.regions(t.catalog)


@query("keyframe_prefix", sql("""
with m as (select window_id, video_id, gop_id, max(packet_index) as last from targets group by 1, 2, 3)
select m.window_id, m.video_id, m.gop_id, min(record_offset) as span_offset, max(record_offset + record_length) - min(record_offset) as span_length, count(*) as records
from m join catalog c on c.video_id = m.video_id and c.gop_id = m.gop_id and c.packet_index <= m.last group by 1, 2, 3""", "targets"))
def keyframe_prefix(t):
    return closures.keyframe_prefix(t.targets, t.catalog, ["window_id"])


@query("display_ordinals", sql("select record_id, cast(row_number() over (partition by video_id, gop_id order by frame_idx) - 1 as int) as ordinal from catalog", "catalog"))
def display_ordinals(t):
    return closures.display_ordinals(t.catalog)
