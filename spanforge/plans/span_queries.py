"""Interval algebra, candidates, costs and plan choice."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DEFAULT, WAVED, CostModel
from ..operators import closures, costing, spans
from .relations import Relations, query, sql

WIN = ["window_id"]


def _islands(gap: int, table: str = "needed", keys: str = "window_id") -> str:
    return f"""
m_{gap} as (select *, max("offset" + length) over (partition by {keys} order by "offset", record_id rows between unbounded preceding and 1 preceding) as r from {table}),
i_{gap} as (select *, cast(sum(case when r is null or "offset" > r + {gap} then 1 else 0 end) over (partition by {keys} order by "offset", record_id rows unbounded preceding) - 1 as int) as span from m_{gap}),
s_{gap} as (select {keys}, span, min("offset") as span_offset, max("offset" + length) - min("offset") as span_length, count(*) as records from i_{gap} group by {keys}, span)"""


for _gap, _name, _keys in ((0, "coalesce_gap0", WIN), (16384, "coalesce_gap16k", WIN), (1048576, "coalesce_vectored_baseline", ["window_id", "video_id"])):
    query(_name, sql(f"with {_islands(_gap, keys=', '.join(_keys))} select * from s_{_gap}", "needed"))(lambda t, g=_gap, k=_keys: spans.merged(t.needed, k, g))


@query("coalesce_none", sql('select window_id, record_id, "offset", length from needed', "needed"))
def coalesce_none(t):
    return spans.numbered(t.needed, WIN, None).select("window_id", "record_id", "offset", "length")


# a fold in the oracle too: rows in order, carrying the open span
_FOLD = """
ordered as (select window_id, record_id, "offset", length, row_number() over (partition by window_id order by "offset", record_id) as n from needed),
fold as (select window_id, n, record_id, "offset", length, 0 as span, "offset" as start, "offset" + length as reach from ordered where n = 1
  union all
  select o.window_id, o.n, o.record_id, o."offset", o.length,
    case when o."offset" <= f.reach + 512 and greatest(f.reach, o."offset" + o.length) - f.start <= 65536 then f.span else f.span + 1 end,
    case when o."offset" <= f.reach + 512 and greatest(f.reach, o."offset" + o.length) - f.start <= 65536 then f.start else o."offset" end,
    case when o."offset" <= f.reach + 512 and greatest(f.reach, o."offset" + o.length) - f.start <= 65536 then greatest(f.reach, o."offset" + o.length) else o."offset" + o.length end
  from fold f join ordered o on o.window_id = f.window_id and o.n = f.n + 1)"""


@query("coalesce_capped", sql(f'with {_FOLD} select window_id, span, min("offset") as span_offset, max("offset" + length) - min("offset") as span_length, count(*) as records from fold group by 1, 2', "needed", recursive=True))
def coalesce_capped(t):
    return spans.merged_capped(t.needed, WIN, 512, 65536)


@query("range_violations", sql("""
select record_id, 'empty' as reason from (select record_id, case when record_id % 50 = 0 then 0 else record_length end as length from catalog) where length <= 0
union all select record_id, 'conflict' from catalog where record_id % 90 = 1""", "catalog"))
def range_violations(t):
    rows = t.catalog.select("record_id", F.col("record_offset").alias("offset"), F.when(F.col("record_id") % 50 == 0, 0).otherwise(F.col("record_length")).cast("long").alias("length"))
    twice = rows.filter(F.col("record_id") % 90 == 1).withColumn("length", F.col("length") + 1)
    return spans.violations(rows.unionByName(twice), [])


@query("span_members", sql(f'with {_islands(512)} select window_id, span, record_id, "offset" - min("offset") over (partition by window_id, span) as relative_offset, length from i_512', "needed"))
def span_members(t):
    return spans.members(spans.numbered(t.needed, WIN, 512), WIN).select("window_id", "span", "record_id", "relative_offset", "length")


@query("group_spans", sql('select window_id, video_id, gop_id, min("offset") as span_offset, max("offset" + length) - min("offset") as span_length, count(*) as records from needed group by 1, 2, 3', "needed"))
def group_spans(t):
    """An unbounded gap inside a group merges all of it, whatever lies between."""
    return t.needed.groupBy("window_id", "video_id", "gop_id").agg(F.min("offset").alias("span_offset"), (F.max(spans.end()) - F.min("offset")).alias("span_length"), F.count(F.lit(1)).alias("records"))


@query("covered_bytes", sql(f"with {_islands(0)} select window_id, cast(sum(span_length) as bigint) as covered_bytes from s_0 group by 1", "needed"))
def covered_bytes(t):
    return spans.covered_bytes(t.needed, WIN)


# every threshold planned from scratch: what the running sums must equal
_CANDIDATES = """
thresholds as (select window_id, 0 as threshold from needed union select window_id, "offset" - reach from marked where "offset" > reach and "offset" - reach <= 16384),
zero as (select window_id, sum(case when reach is null or "offset" > reach then 1 else 0 end) as n, sum(greatest(0, "offset" + length - greatest("offset", coalesce(reach, "offset")))) as b from marked group by 1),
cand as (
  select t.window_id, cast(t.threshold as bigint) as threshold, cast(any_value(z.n) - count(m.record_id) as bigint) as ranges, cast(any_value(z.b) + coalesce(sum(m."offset" - m.reach), 0) as bigint) as bytes
  from thresholds t join zero z on z.window_id = t.window_id left join marked m on m.window_id = t.window_id and m."offset" > m.reach and m."offset" - m.reach <= t.threshold group by 1, 2
  union all select window_id, null, count(*), cast(sum(length) as bigint) from needed group by 1)"""


@query("span_candidates", sql(f"with {_CANDIDATES} select * from cand", "marked"))
def span_candidates(t):
    return spans.threshold_candidates(t.needed, WIN, 16384)


def _io(model, n="ranges", b="bytes") -> str:
    if not model.waves:
        return f"(ceil({n} / {float(model.concurrency)}) * {model.latency_ns}::double + {b} / {model.bytes_per_ns}::double)"
    waves = ", ".join(str(w) for w in (0.0, *model.waves[: model.concurrency]))
    return f"(floor({n} / {float(model.concurrency)}) * {model.waves[model.concurrency - 1]} + ([{waves}])[cast({n} % {model.concurrency} as int) + 1] + {b} / {model.bytes_per_ns})"


def _dec(model, u="units", fixed: float | None = None) -> str:
    return f"(case when {u} > 0 then {u} * {model.decode_unit_ns}::double + {model.decode_fixed_ns if fixed is None else fixed}::double else 0::double end)"


def _tot(model, io="io_ns", dec="decode_ns") -> str:
    return f"({io} + {dec} - {model.overlap} * least({io}, {dec}))"


def _frontier(model) -> str:
    return """
gp as (select window_id, "offset" - reach as gap, row_number() over (partition by window_id order by "offset", record_id) - 1 as nth from marked qualify "offset" > reach),
zero as (select window_id, sum(case when reach is null or "offset" > reach then 1 else 0 end) as n, sum(greatest(0, "offset" + length - greatest("offset", coalesce(reach, "offset")))) as b from marked group by 1),
small as (select window_id, count(*) as c, sum(gap) as s from gp where gap <= 16384 group by 1),
base as (select z.window_id, n - coalesce(c, 0) as r, b + coalesce(s, 0) as t from zero z left join small on small.window_id = z.window_id),
front as (select window_id, 0 as cuts, cast(r as bigint) as ranges, cast(t as bigint) as bytes from base
  union all select gp.window_id, cast(row_number() over w as int), cast(r + row_number() over w as bigint), cast(t - sum(gap) over (w rows unbounded preceding) as bigint)
  from gp join base on base.window_id = gp.window_id where gap <= 16384 window w as (partition by gp.window_id order by gap desc, nth))"""


@query("gap_cut_frontier", sql(f"with {_frontier(WAVED)}, u as (select window_id, count(*) as units from needed group by 1) select f.window_id, cuts, ranges, bytes, round({_io(WAVED)}, 6) as io_ns, round({_tot(WAVED, _io(WAVED), _dec(WAVED))}, 6) as total_ns from front f join u on u.window_id = f.window_id", "marked"))
def gap_cut_frontier(t):
    units = t.needed.groupBy("window_id").agg(F.count(F.lit(1)).alias("units"))
    p = costing.priced(spans.cut_frontier(t.needed, WIN, 16384).join(units, "window_id"), WAVED)
    return p.select("window_id", "cuts", "ranges", "bytes", F.round("io_ns", 6).alias("io_ns"), F.round("total_ns", 6).alias("total_ns"))


@query("frontier_choice", sql(f"""with {_frontier(WAVED)}, {_islands(16384)}, u as (select window_id, count(*) as units from needed group by 1),
fx as (select s.window_id, {_tot(WAVED, _io(WAVED), _dec(WAVED))} as fixed_total_ns from (select window_id, count(*) as ranges, sum(span_length) as bytes from s_16384 group by 1) s join u on u.window_id = s.window_id),
p2 as (select f.window_id, cuts, ranges, bytes, {_tot(WAVED, _io(WAVED), _dec(WAVED))} as total_ns, fixed_total_ns from front f join u on u.window_id = f.window_id join fx on fx.window_id = f.window_id),
ok as (select * from (select *, min(total_ns) over (partition by window_id) as low from p2) where total_ns <= low + {WAVED.tolerance_ns} and total_ns <= fixed_total_ns)
select window_id, cuts, ranges, bytes, round(total_ns, 6) as total_ns, round(fixed_total_ns, 6) as fixed_total_ns from ok qualify row_number() over (partition by window_id order by bytes, ranges, total_ns, cuts) = 1""", "marked"))
def frontier_choice(t):
    units = t.needed.groupBy("window_id").agg(F.count(F.lit(1)).alias("units"))
    out = costing.frontier_choice(spans.cut_frontier(t.needed, WIN, 16384), costing.fixed_reference(t.needed, WIN, None), units, WIN, WAVED)
    return out.select("window_id", "cuts", "ranges", "bytes", F.round("total_ns", 6).alias("total_ns"), F.round("fixed_total_ns", 6).alias("fixed_total_ns"))


# -- overlap, extraction, geometry ----------------------------------------------
@query("range_record_overlap", sql(f"""with {_islands(4096)} select s.window_id, s.span, n.record_id, greatest(s.span_offset, n."offset") as from_offset,
  least(s.span_offset + s.span_length, n."offset" + n.length) - greatest(s.span_offset, n."offset") as common_bytes
  from s_4096 s join needed n on n.window_id = s.window_id and s.span_offset < n."offset" + n.length and n."offset" < s.span_offset + s.span_length""", "needed"))
def range_record_overlap(t):
    both = spans.overlaps(spans.merged(t.needed, WIN, 4096).drop("records"), t.needed.select("window_id", "record_id", "offset", "length"), WIN)
    begins = F.greatest("span_offset", "offset")
    return both.select("window_id", "span", "record_id", begins.alias("from_offset"), (F.least(F.col("span_offset") + F.col("span_length"), spans.end()) - begins).alias("common_bytes"))


@query("extract_records", "select doc_id as sample_id, sha256(text) as sha256, cast(strlen(text) as bigint) as length from documents")
def extract_records(t):
    """Records cut out of the group regions that hold them: offset and length must give back each text."""
    whole = t.catalog_text.groupBy("video_id", "gop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("packet_index", "payload"))), lambda x: x["payload"]), "").cast("binary").alias("bytes"), F.min("record_offset").alias("base"))
    cut = t.catalog_text.join(whole, ["video_id", "gop_id"]).select("id", F.expr("substring(bytes, cast(record_offset - base as int) + 1, cast(record_length as int))").alias("data"))
    return cut.select(F.col("id").alias("sample_id"), F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("length"))


@query("no_overdecode", sql(f"""with {_islands(16384)} select i.window_id, i.span, sum(i.length) :: bigint as needed_bytes, any_value(s.span_length) - sum(i.length) :: bigint as dropped_bytes
  from i_16384 i join s_16384 s on s.window_id = i.window_id and s.span = i.span group by 1, 2""", "needed"))
def no_overdecode(t):
    n = spans.numbered(t.needed, WIN, 16384)
    return n.groupBy("window_id", "span").agg(F.sum("length").alias("needed_bytes"), (F.max(spans.end()) - F.min("offset") - F.sum("length")).alias("dropped_bytes"))


@query("range_geometry", sql(f"""with {_islands(4096)} select window_id, cast(floor(sum(span_length) / count(*)) as bigint) as mean_range_bytes, max(span_length) as max_range_bytes,
  max(span_offset + span_length) - min(span_offset) as address_span_bytes, cast(count(*) filter (before = span_offset) as bigint) as contiguous_range_pairs
  from (select *, lag(span_offset + span_length) over (partition by window_id order by span_offset, span) as before from s_4096) group by 1""", "needed"))
def range_geometry(t):
    return spans.geometry(spans.merged(t.needed, WIN, 4096), WIN)


@query("range_histogram", sql(f"""with {_islands(16384)} select window_id, count(*) filter (span_length <= 4096) as le_4k, count(*) filter (span_length > 4096 and span_length <= 16384) as le_16k,
  count(*) filter (span_length > 16384 and span_length <= 65536) as le_64k, count(*) filter (span_length > 65536 and span_length <= 262144) as le_256k, count(*) filter (span_length > 262144) as above from s_16384 group by 1""", "needed"))
def range_histogram(t):
    return spans.histogram(spans.merged(t.needed, WIN, 16384), WIN)


@query("batch_features", sql(f"""with {_islands(16384)}, {_islands(0)}, ga as (select window_id, max(span_length) as max_range_bytes, cast(sum(span_length) as bigint) as fetched_bytes, count(*) as physical_ranges,
    max(span_offset + span_length) - min(span_offset) as address_span_bytes from s_16384 group by 1),
  c0 as (select window_id, cast(sum(span_length) as bigint) as useful_bytes from s_0 group by 1),
  r as (select window_id, count(*) as logical_requests, count(distinct record_id) as unique_targets, count(distinct video_id) as unique_videos from targets group by 1),
  d as (select x.window_id, count(*) as dependency_records, count(distinct cl.dep_id) as unique_records from (select distinct window_id, record_id from targets) x join closure cl on cl.target_id = x.record_id group by 1)
select r.window_id, logical_requests, unique_targets, unique_videos, dependency_records, unique_records, useful_bytes, physical_ranges, fetched_bytes, fetched_bytes - useful_bytes as overfetch_bytes, max_range_bytes, address_span_bytes
from r join d on d.window_id = r.window_id join ga on ga.window_id = r.window_id join c0 on c0.window_id = r.window_id""", "needed"))
def batch_features(t):
    r = t.targets.groupBy("window_id").agg(F.count(F.lit(1)).alias("logical_requests"), F.countDistinct("record_id").alias("unique_targets"), F.countDistinct("video_id").alias("unique_videos"))
    edges = t.targets.select("window_id", F.col("record_id").alias("target_id")).distinct().join(t.closure, "target_id")
    d = edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("dependency_records"), F.countDistinct("dep_id").alias("unique_records"))
    s = spans.merged(t.needed, WIN, 16384)
    g = s.groupBy("window_id").agg(F.max("span_length").alias("max_range_bytes"), F.sum("span_length").alias("fetched_bytes"), F.count(F.lit(1)).alias("physical_ranges"), (F.max(F.col("span_offset") + F.col("span_length")) - F.min("span_offset")).alias("address_span_bytes"))
    u = spans.covered_bytes(t.needed, WIN).withColumnRenamed("covered_bytes", "useful_bytes")
    out = r.join(d, "window_id").join(g, "window_id").join(u, "window_id")
    return out.withColumn("overfetch_bytes", F.col("fetched_bytes") - F.col("useful_bytes"))


def _timed(t: Relations):
    """Ranges of each window with derived service times: started in order of offset, eight at once."""
    s = spans.merged(t.needed, WIN, 16384)
    at = F.row_number().over(W.partitionBy("window_id").orderBy("span_offset")) - 1
    return s.withColumn("start_ns", (F.floor(at / 8) * 50_000).cast("long")).withColumn("end_ns", F.col("start_ns") + 20_000 + F.col("span_length"))


_TIMED = f"{_islands(16384)}, timed as (select *, start_ns + 20000 + span_length as end_ns from (select *, cast(floor((row_number() over (partition by window_id order by span_offset) - 1) / 8) * 50000 as bigint) as start_ns from s_16384))"
_SWEEP = "ev as (select window_id, start_ns as tt, 1 as d, {w} as x from timed union all select window_id, end_ns, -1, -({w}) from timed), run as (select *, sum(x) over (partition by window_id order by tt, d rows unbounded preceding) as s from ev)"


@query("max_in_flight", sql(f"with {_TIMED}, {_SWEEP.format(w='1')} select window_id, cast(max(s) as bigint) as max_in_flight from run group by 1", "needed"))
def max_in_flight(t):
    return spans.peak(_timed(t), WIN, "start_ns", "end_ns", name="max_in_flight")


@query("buffer_peak", sql(f"with {_TIMED}, {_SWEEP.format(w='span_length')} select window_id, cast(max(s) as bigint) as peak_bytes from run group by 1", "needed"))
def buffer_peak(t):
    return spans.peak(_timed(t), WIN, "start_ns", "end_ns", F.col("span_length"), "peak_bytes")


@query("pressure_snapshot", sql(f"""with {_TIMED}, q as (select *, start_ns - 30000 as queued_ns from timed)
select window_id, count(*) filter (start_ns <= 60000 and end_ns > 60000) as active, count(*) filter (queued_ns <= 60000 and end_ns > 60000) as outstanding,
  count(*) filter (queued_ns <= 60000 and start_ns > 60000) as queued from q group by 1""", "needed"))
def pressure_snapshot(t):
    at, q = F.lit(60_000), _timed(t).withColumn("queued_ns", F.col("start_ns") - 30_000)
    open_ = F.col("end_ns") > at
    out = q.groupBy("window_id").agg(F.count_if((F.col("start_ns") <= at) & open_).alias("active"), F.count_if((F.col("queued_ns") <= at) & open_).alias("outstanding"))
    return out.withColumn("queued", F.col("outstanding") - F.col("active"))


_FIRST_USE = "use as (select t.window_id, cl.dep_id as record_id, min(t.batch_id) as first_batch, count(distinct t.record_id) as fanout from targets t join closure cl on cl.target_id = t.record_id group by 1, 2)"


@query("range_priority_batch", sql(f"""with {_islands(4096)}, {_FIRST_USE}, o as (select i.window_id, i.span, min(u.first_batch) as first_batch, min(i."offset") as span_offset from i_4096 i join use u on u.window_id = i.window_id and u.record_id = i.record_id group by 1, 2)
select window_id, span, first_batch, span_offset, cast(row_number() over (partition by window_id order by first_batch, span_offset) - 1 as int) as place from o""", "needed"))
def range_priority_batch(t):
    o = spans.numbered(_first_use(t), WIN, 4096).groupBy("window_id", "span").agg(F.min("first_batch").alias("first_batch"), F.min("offset").alias("span_offset"))
    return o.withColumn("place", F.row_number().over(W.partitionBy("window_id").orderBy("first_batch", "span_offset")) - 1)


def _first_use(t: Relations):
    """A window's needed records with their extents, the first batch that needs each and how many targets do, by window."""
    asked = t.targets.groupBy("window_id", F.col("record_id").alias("target_id")).agg(F.min("batch_id").alias("batch_id"))
    edges = asked.join(t.placed_closure.select("target_id", F.col("dep_id").alias("record_id"), "offset", "length"), "target_id").repartition("window_id")
    return edges.groupBy("window_id", "record_id", "offset", "length").agg(F.min("batch_id").alias("first_batch"), F.count(F.lit(1)).alias("fanout"))


@query("range_priority_fanout", sql(f"""with {_islands(4096)}, {_FIRST_USE}, o as (select i.window_id, i.span, cast(sum(u.fanout) as bigint) as fanout, min(i."offset") as span_offset, max(i."offset" + i.length) - min(i."offset") as span_length
  from i_4096 i join use u on u.window_id = i.window_id and u.record_id = i.record_id group by 1, 2)
select window_id, span, fanout, cast(row_number() over (partition by window_id order by fanout desc, span_offset) - 1 as int) as by_fanout, cast(row_number() over (partition by window_id order by span_length, span_offset) - 1 as int) as by_smallest,
  cast(row_number() over (partition by window_id order by span_length desc, span_offset) - 1 as int) as by_largest,
  cast((select count(*) from o p where p.window_id = o.window_id and (cast(p.fanout as hugeint) * o.span_length > cast(o.fanout as hugeint) * p.span_length or (cast(p.fanout as hugeint) * o.span_length = cast(o.fanout as hugeint) * p.span_length and p.span_offset < o.span_offset))) as int) as by_fanout_per_byte from o""", "needed"))
def range_priority_fanout(t):
    o = spans.numbered(_first_use(t), WIN, 4096).groupBy("window_id", "span").agg(F.sum("fanout").alias("fanout"), F.min("offset").alias("span_offset"), (F.max(spans.end()) - F.min("offset")).alias("span_length"))
    place = lambda *order: F.row_number().over(W.partitionBy("window_id").orderBy(*order, "span_offset")) - 1
    return o.select("window_id", "span", "fanout", place(F.desc("fanout")).alias("by_fanout"), place("span_length").alias("by_smallest"), place(F.desc("span_length")).alias("by_largest"), place(F.desc(spans.density(F.col("fanout"), F.col("span_length")))).alias("by_fanout_per_byte"))


# -- broker ---------------------------------------------------------------------
_BROKER = """
own as (select distinct t.window_id, t.caller, c.video_id as object_key, c.record_offset as "offset", c.record_length as length, c.record_id from targets t join catalog c on c.record_id = t.record_id),
bo as (select *, row_number() over (partition by window_id, object_key order by "offset", record_id, caller) as n from own),
bf as (select window_id, object_key, n, caller, record_id, "offset", length, 0 as span, "offset" as start, "offset" + length as reach from bo where n = 1
  union all select o.window_id, o.object_key, o.n, o.caller, o.record_id, o."offset", o.length,
    case when j then f.span else f.span + 1 end, case when j then f.start else o."offset" end, case when j then greatest(f.reach, o."offset" + o.length) else o."offset" + o.length end
  from bf f join bo o on o.window_id = f.window_id and o.object_key = f.object_key and o.n = f.n + 1, lateral (select o."offset" <= f.reach + 8192 and greatest(f.reach, o."offset" + o.length) - f.start <= 262144 as j) x)"""


def _broker(t: Relations):
    own = t.targets.select("window_id", "caller", "record_id").distinct().join(t.catalog.select("record_id", F.col("video_id").alias("object_key"), F.col("record_offset").alias("offset"), F.col("record_length").alias("length")), "record_id")
    # identical extents of different callers are one extent with several members
    extents = own.select("window_id", "object_key", "record_id", "offset", "length").distinct()
    numbered = spans.numbered_capped(extents, ["window_id", "object_key"], 8192, 262144)
    return own.join(numbered.select("window_id", "object_key", "record_id", "span"), ["window_id", "object_key", "record_id"])


@query("broker_spans", sql(f'with {_BROKER} select window_id, object_key, span, min("offset") as span_offset, max("offset" + length) - min("offset") as span_length, count(*) as members from bf group by 1, 2, 3', "targets", recursive=True))
def broker_spans(t):
    return _broker(t).groupBy("window_id", "object_key", "span").agg(F.min("offset").alias("span_offset"), (F.max(spans.end()) - F.min("offset")).alias("span_length"), F.count(F.lit(1)).alias("members"))


@query("broker_attribution", sql(f"""with {_BROKER}, sp as (select window_id, object_key, span, max("offset" + length) - min("offset") as span_length from bf group by 1, 2, 3)
select bf.window_id, bf.object_key, bf.span, caller, record_id, case when row_number() over w = 1 then 1 else 0 end as gets, case when row_number() over w = 1 then span_length else 0 end as charged_bytes
from bf join sp on sp.window_id = bf.window_id and sp.object_key = bf.object_key and sp.span = bf.span window w as (partition by bf.window_id, bf.object_key, bf.span order by caller, record_id)""", "targets", recursive=True))
def broker_attribution(t):
    key = ["window_id", "object_key", "span"]
    m = _broker(t).withColumn("_s", F.max(spans.end()).over(W.partitionBy(*key)) - F.min("offset").over(W.partitionBy(*key)))
    first = F.row_number().over(W.partitionBy(*key).orderBy("caller", "record_id")) == 1
    return m.select(*key, "caller", "record_id", F.when(first, 1).otherwise(0).alias("gets"), F.when(first, F.col("_s")).otherwise(0).cast("long").alias("charged_bytes"))


@query("plan_exactness", sql(f"with {_islands(16384)} select window_id, count(*) as planned_ranges, cast(sum(span_length) as bigint) as planned_bytes, count(*) as executed_ranges, cast(sum(span_length) as bigint) as executed_bytes, true as exact from s_16384 group by 1", "needed"))
def plan_exactness(t):
    """Planned ranges against what the timed execution fetched."""
    plan = spans.merged(t.needed, WIN, 16384).groupBy("window_id").agg(F.count(F.lit(1)).alias("planned_ranges"), F.sum("span_length").alias("planned_bytes"))
    ran = _timed(t).groupBy("window_id").agg(F.count(F.lit(1)).alias("executed_ranges"), F.sum(F.col("end_ns") - F.col("start_ns") - 20_000).alias("executed_bytes"))
    same = (F.col("planned_ranges") == F.col("executed_ranges")) & (F.col("planned_bytes") == F.col("executed_bytes"))
    return plan.join(ran, "window_id", "full_outer").withColumn("exact", F.coalesce(same, F.lit(False)))


_CLUSTER = """
cl1 as (select distinct window_id, video_id, record_id, packet_index from targets),
cl2 as (select *, packet_index - lag(packet_index) over (partition by window_id, video_id order by packet_index) as step from cl1),
cl3 as (select *, sum(case when step is null or step > 4 then 1 else 0 end) over (partition by window_id, video_id order by packet_index rows unbounded preceding) - 1 as cluster from cl2)"""


@query("cluster_records", sql(f"with {_CLUSTER} select window_id, video_id, cast(cluster as int) as cluster, min(packet_index) as first_packet, max(packet_index) as last_packet, count(*) as targets, max(packet_index) - min(packet_index) + 1 as fetched_records from cl3 group by 1, 2, 3", "targets"))
def cluster_records(t):
    o = W.partitionBy("window_id", "video_id").orderBy("packet_index")
    one = t.targets.select("window_id", "video_id", "record_id", "packet_index").distinct()
    step = F.col("packet_index") - F.lag("packet_index").over(o)
    c = one.withColumn("_s", F.when(step.isNull() | (step > 4), 1).otherwise(0)).withColumn("cluster", (F.sum("_s").over(o.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    return c.groupBy("window_id", "video_id", "cluster").agg(F.min("packet_index").alias("first_packet"), F.max("packet_index").alias("last_packet"), F.count(F.lit(1)).alias("targets"), (F.max("packet_index") - F.min("packet_index") + 1).alias("fetched_records"))


@query("bind_ranges", sql(f"""with {_islands(4096)}, given as (select * from s_4096 where span % 3 <> 0)
select n.window_id, n.record_id, coalesce(g.span_offset, n."offset") as bound_offset, coalesce(g.span_length, n.length) as bound_length, g.span is null as added
from needed n left join given g on g.window_id = n.window_id and n."offset" >= g.span_offset and n."offset" + n.length <= g.span_offset + g.span_length""", "needed"))
def bind_ranges(t):
    """Records bound to given ranges; those that none covers get a range of their own."""
    given = spans.merged(t.needed, WIN, 4096).filter(F.col("span") % 3 != 0).drop("records")
    records = t.needed.select("window_id", "record_id", "offset", "length")
    b = spans.bound(records, given.drop("span"), WIN)
    return b.select("window_id", "record_id", F.coalesce("span_offset", "offset").alias("bound_offset"), F.coalesce("span_length", "length").alias("bound_length"), F.col("span_offset").isNull().alias("added"))


# -- costs and choice -----------------------------------------------------------
_PLANS = f"""{_CANDIDATES}, {_islands(16384)}, {_islands(0)},
units as (select window_id, count(*) as units from needed group by 1), useful as (select window_id, cast(sum(span_length) as bigint) as useful_bytes from s_0 group by 1),
reg as (select video_id, gop_id, max(record_offset + record_length) - min(record_offset) as len, count(*) as n from catalog group by 1, 2),
touched as (select x.window_id, count(*) as ranges, cast(sum(len) as bigint) as bytes, cast(sum(n) as bigint) as units from (select distinct window_id, video_id, gop_id from needed) x join reg on reg.video_id = x.video_id and reg.gop_id = x.gop_id group by 1),
shape as (
  select 'sparse' as kind, c.window_id, threshold, ranges, bytes, u.units, useful_bytes from cand c join units u on u.window_id = c.window_id join useful f on f.window_id = c.window_id
  union all select 'fixed', s.window_id, 16384, count(*), cast(sum(span_length) as bigint), any_value(u.units), any_value(useful_bytes) from s_16384 s join units u on u.window_id = s.window_id join useful f on f.window_id = s.window_id group by 2
  union all select 'region', window_id, null, ranges, bytes, units, bytes from touched),
plans as (select *, {_io(DEFAULT)} as io_ns, {_dec(DEFAULT)} as decode_ns, {_tot(DEFAULT, _io(DEFAULT), _dec(DEFAULT))} as total_ns from shape)"""


def plans(t: Relations, model=DEFAULT):
    return costing.candidates(t.needed, t.needed, closures.regions(t.catalog), WIN, model)


@query("inspect_candidates", sql(f"with {_PLANS} select kind, window_id, threshold, ranges, bytes, units, useful_bytes, round(io_ns, 6) as io_ns, round(decode_ns, 6) as decode_ns, round(total_ns, 6) as total_ns from plans", "marked"))
def inspect_candidates(t):
    return plans(t).select("kind", "window_id", "threshold", "ranges", "bytes", "units", "useful_bytes", *(F.round(c, 6).alias(c) for c in ("io_ns", "decode_ns", "total_ns")))


_CHOSEN = f"""{_PLANS}, rated as (select *, min(total_ns) over (partition by window_id) as low, min(total_ns) filter (kind = 'fixed') over (partition by window_id) as fixed_total_ns from plans),
chosen as (select * from rated where total_ns <= low + {DEFAULT.tolerance_ns} and total_ns <= fixed_total_ns and kind <> 'fixed'
  qualify row_number() over (partition by window_id order by bytes, units, ranges, total_ns, kind desc, threshold nulls first) = 1)"""


@query("choose_plan", sql(f"with {_CHOSEN} select window_id, kind, threshold, ranges, bytes, units, useful_bytes, round(total_ns, 6) as total_ns, round(fixed_total_ns, 6) as fixed_total_ns from chosen", "marked"))
def choose_plan(t):
    out = costing.choose(plans(t), WIN, DEFAULT)
    return out.select("window_id", "kind", "threshold", "ranges", "bytes", "units", "useful_bytes", F.round("total_ns", 6).alias("total_ns"), F.round("fixed_total_ns", 6).alias("fixed_total_ns"))


for _n, _m in (("io_cost", DEFAULT), ("io_cost_waves", WAVED)):
    query(_n, sql(f"with {_islands(4096)}, s as (select window_id, count(*) as ranges, cast(sum(span_length) as bigint) as bytes from s_4096 group by 1) select window_id, ranges, bytes, round({_io(_m)}, 6) as io_ns from s", "needed"))(
        lambda t, m=_m: spans.merged(t.needed, WIN, 4096).groupBy("window_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum("span_length").alias("bytes")).withColumn("io_ns", F.round(m.io(F.col("ranges"), F.col("bytes")), 6))
    )


@query("plan_cost", sql(f"with {_islands(4096)}, s as (select s.window_id, count(*) as ranges, cast(sum(span_length) as bigint) as bytes, any_value(u.units) as units from s_4096 s join (select window_id, count(*) as units from needed group by 1) u on u.window_id = s.window_id group by 1) select window_id, ranges, bytes, units, round({_tot(DEFAULT, _io(DEFAULT), _dec(DEFAULT))}, 6) as total_ns from s", "needed"))
def plan_cost(t):
    s = spans.merged(t.needed, WIN, 4096).groupBy("window_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum("span_length").alias("bytes"))
    u = t.needed.groupBy("window_id").agg(F.count(F.lit(1)).alias("units"))
    return costing.priced(s.join(u, "window_id"), DEFAULT).select("window_id", "ranges", "bytes", "units", F.round("total_ns", 6).alias("total_ns"))


@query("execution_cost", sql(f"""with gx as (select window_id, video_id, gop_id, count(*) as units, max("offset" + length) - min("offset") as bytes from needed group by 1, 2, 3)
select window_id, video_id, gop_id, units, round({_tot(DEFAULT, _io(DEFAULT, '1'), _dec(DEFAULT))}, 6) as with_open_ns, round({_tot(DEFAULT, _io(DEFAULT, '1'), _dec(DEFAULT, fixed=0.0))}, 6) as continued_ns from gx""", "needed"))
def execution_cost(t):
    """One range per group, with and without opening the decoder."""
    g = t.needed.groupBy("window_id", "video_id", "gop_id").agg(F.count(F.lit(1)).alias("units"), (F.max(spans.end()) - F.min("offset")).alias("bytes"))
    io = DEFAULT.io(F.lit(1), F.col("bytes"))
    return g.select("window_id", "video_id", "gop_id", "units", F.round(DEFAULT.total(io, DEFAULT.decode(F.col("units"))), 6).alias("with_open_ns"), F.round(DEFAULT.total(io, DEFAULT.decode(F.col("units"), fixed=False)), 6).alias("continued_ns"))


@query("parallel_window_cost", sql(f"""with jobs as (select window_id, {_dec(DEFAULT, 'count(*)')} as c from needed group by window_id, video_id, gop_id),
 w as (select *, floor((row_number() over (partition by window_id order by c desc) - 1) / 4) as wave from jobs), mx as (select window_id, wave, max(c) as m from w group by 1, 2)
select window_id, round(sum(m), 6) as decode_ns from mx group by 1""", "needed"))
def parallel_window_cost(t):
    jobs = t.needed.groupBy("window_id", "video_id", "gop_id").agg(F.count(F.lit(1)).alias("units"))
    return costing.parallel_window(jobs, WIN, 4, DEFAULT).select("window_id", F.round("decode_ns", 6).alias("decode_ns"))


# -- forced actions -------------------------------------------------------------
@query("action_exact_closure", sql("select window_id, count(*) as ranges, cast(sum(length) as bigint) as bytes, count(*) as units from needed group by 1", "needed"))
def action_exact_closure(t):
    return t.needed.groupBy("window_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("units"))


@query("action_fixed_gap_closure", sql(f"with {_islands(16384)} select window_id, count(*) as ranges, cast(sum(span_length) as bigint) as bytes, cast(sum(records) as bigint) as units from s_16384 group by 1", "needed"))
def action_fixed_gap_closure(t):
    return spans.merged(t.needed, WIN, 16384).groupBy("window_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum("span_length").alias("bytes"), F.sum("records").alias("units"))


@query("action_keyframe_prefix", sql("""with m as (select window_id, video_id, gop_id, max(packet_index) as last from targets group by 1, 2, 3),
 s as (select m.window_id, m.video_id, m.gop_id, max(record_offset + record_length) - min(record_offset) as len, count(*) as n from m join catalog c on c.video_id = m.video_id and c.gop_id = m.gop_id and c.packet_index <= m.last group by 1, 2, 3)
select window_id, count(*) as ranges, cast(sum(len) as bigint) as bytes, cast(sum(n) as bigint) as units from s group by 1""", "targets"))
def action_keyframe_prefix(t):
    return closures.keyframe_prefix(t.targets, t.catalog, WIN).groupBy("window_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum("span_length").alias("bytes"), F.sum("records").alias("units"))


def _region(all_units: bool) -> str:
    return sql(f"""with reg as (select video_id, gop_id, max(record_offset + record_length) - min(record_offset) as len, count(*) as n from catalog group by 1, 2), u as (select window_id, count(*) as units from needed group by 1)
select x.window_id, count(*) as ranges, cast(sum(len) as bigint) as bytes, cast({'sum(n)' if all_units else 'any_value(u.units)'} as bigint) as units from (select distinct window_id, video_id, gop_id from needed) x
join reg on reg.video_id = x.video_id and reg.gop_id = x.gop_id join u on u.window_id = x.window_id group by 1""", "needed")


def _region_plan(t: Relations, units: str):
    return costing.candidates(t.needed, t.needed, closures.regions(t.catalog), WIN, DEFAULT, region_units=units).filter("kind = 'region'").select("window_id", "ranges", "bytes", "units")


query("action_region_all", _region(True))(lambda t: _region_plan(t, "all"))
query("action_region_selective", _region(False))(lambda t: _region_plan(t, "closure"))
query("action_calibrated_closure", sql(f"with {_CHOSEN.replace('kind <> ' + repr('fixed'), 'kind = ' + repr('sparse'))} select window_id, ranges, bytes, units, round(total_ns, 6) as total_ns from chosen", "marked"))(
    lambda t: costing.choose(plans(t).filter("kind <> 'region'"), WIN, DEFAULT).select("window_id", "ranges", "bytes", "units", F.round("total_ns", 6).alias("total_ns"))
)


@query("fixed16_override", sql(f"""with {_CHOSEN.replace('plans as (', 'plans as materialized (')} select c.window_id, case when c.window_id % 2 = 0 and c.kind = 'sparse' then 'fixed' else c.kind end as kind,
  case when c.window_id % 2 = 0 and c.kind = 'sparse' then f.ranges else c.ranges end as ranges, case when c.window_id % 2 = 0 and c.kind = 'sparse' then f.bytes else c.bytes end as bytes
  from chosen c join plans f on f.window_id = c.window_id and f.kind = 'fixed'""", "marked"))
def fixed16_override(t):
    """The fixed plan replaces a sparse one while the fallback is latched (here: even windows)."""
    all_ = plans(t)
    f = all_.filter("kind = 'fixed'").select("window_id", F.col("ranges").alias("_r"), F.col("bytes").alias("_b"))
    use = (F.col("window_id") % 2 == 0) & (F.col("kind") == "sparse")
    return costing.choose(all_, WIN, DEFAULT).join(f, "window_id").select("window_id", F.when(use, "fixed").otherwise(F.col("kind")).alias("kind"), F.when(use, F.col("_r")).otherwise(F.col("ranges")).alias("ranges"), F.when(use, F.col("_b")).otherwise(F.col("bytes")).alias("bytes"))


#: What first batches are held to: slower than what throughput is ranked by.
PROMISED = CostModel(latency_ns=200_000.0, bytes_per_ns=0.5, decode_fixed_ns=40_000.0, decode_unit_ns=6_000.0)
_SLO = 5_000_000.0

# windows and horizons as one key, so that the choice among plans is the same SQL as for windows
_LOOK = f"""
hz as (select * from (values (1), (2), (4), (8)) h(horizon)),
needed as (select x.window_id, c.record_id, c.record_offset as "offset", c.record_length as length, c.video_id, c.gop_id, c.packet_index
  from (select distinct t.window_id * 16 + horizon as window_id, cl.dep_id from hz join targets t on t.batch_id % 8 < horizon join closure cl on cl.target_id = t.record_id) x join catalog c on c.record_id = x.dep_id),
marked as (select *, max("offset" + length) over (partition by window_id order by "offset", record_id rows between unbounded preceding and 1 preceding) as reach from needed), {_CHOSEN},
fi as (select window_id - 1 as base, record_id from needed where window_id % 16 = 1), fu as (select base, count(*) as first_units from fi group by 1),
mk as (select m.*, c.kind, c.threshold, fi.record_id is not null as f from marked m join chosen c on c.window_id = m.window_id left join fi on fi.base = m.window_id - m.window_id % 16 and fi.record_id = m.record_id),
sn as (select *, sum(case when reach is null or threshold is null or "offset" > reach + threshold then 1 else 0 end) over (partition by window_id order by "offset", record_id rows unbounded preceding) as span from mk where kind = 'sparse'),
rs as (select window_id, max("offset" + length) - min("offset") as len, bool_or(f) as f from sn group by window_id, span
  union all select k.window_id, any_value(reg.len), bool_or(f) from mk k join reg on reg.video_id = k.video_id and reg.gop_id = k.gop_id where kind = 'region' group by k.window_id, k.video_id, k.gop_id),
wt as (select window_id, count(*) as first_ranges, sum(len) as first_bytes from rs where f group by 1),
sa as (select t.window_id * 16 + horizon as window_id, count(*) as samples from hz join targets t on t.batch_id % 8 < horizon group by 1),
hl as (select c.window_id, c.kind, c.total_ns, samples, {_tot(PROMISED, _io(PROMISED, 'first_ranges', 'first_bytes'), _dec(PROMISED, 'first_units'))} as first_batch_ns
  from chosen c join wt on wt.window_id = c.window_id join fu on fu.base = c.window_id - c.window_id % 16 join sa on sa.window_id = c.window_id),
hr as (select *, samples * 1e9 / total_ns as rate, first_batch_ns <= {_SLO} as feasible from hl)"""


@query("choose_lookahead", sql(f"with {_LOOK} select window_id // 16 as window_id, cast(window_id % 16 as int) as horizon, kind, samples, round(total_ns, 6) as total_ns, round(first_batch_ns, 6) as first_batch_ns, feasible from hr qualify row_number() over (partition by window_id // 16 order by feasible desc, case when feasible then -rate else first_batch_ns end, window_id % 16) = 1", "targets", "closure"))
def choose_lookahead(t):
    """Horizons 1, 2, 4, 8, each with the plan chosen for it; the first batch waits for the ranges that hold a record it needs."""
    wide, needed = t.planned, t.needed_by_plan
    every = F.explode(F.array(*(F.col("plan") - 1 + h for h in (1, 2, 4, 8))))
    samples = wide.groupBy("plan").agg(F.count(F.lit(1)).alias("samples"))
    # a window's first batch needs the same records whatever the horizon
    first = needed.filter("plan % 16 = 1").select(every.alias("plan"), "record_id").join(samples.select("plan"), "plan", "left_semi")
    p = costing.horizons(needed, first, closures.regions(t.catalog), "plan", DEFAULT, PROMISED).join(samples, "plan")
    p = p.withColumn("window_id", F.floor(F.col("plan") / 16).cast("long")).withColumn("horizon", (F.col("plan") % 16).cast("int"))
    return costing.lookahead(p, WIN, _SLO).select("window_id", "horizon", "kind", "samples", F.round("total_ns", 6).alias("total_ns"), F.round("first_batch_ns", 6).alias("first_batch_ns"), "feasible")
