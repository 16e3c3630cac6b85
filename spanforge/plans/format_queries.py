"""Start-code streams, storage policies, build options, single records, broker windows, releases, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import delivery, ingest, kernels, resolve
from .relations import Relations, query, sql
from .state_queries import _READY, WIN, _ready

# -- start-code streams ---------------------------------------------------------
def _lines(t: Relations):
    """Each text's non-empty lines as length-prefixed units, in one sample."""
    frame = lambda u: F.concat(F.lpad(F.hex(F.octet_length(u)), 8, "0"), F.hex(u.cast("binary")))
    parts = F.filter(F.split("text", "\n"), lambda u: u != "")
    return t.table("documents").filter("text is not null").select("doc_id", F.unhex(F.array_join(F.transform(parts, frame), "")).alias("sample"))


_UNITS = "un as (select doc_id, u, row_number() over (partition by doc_id order by i) - 1 as position from (select doc_id, unnest(string_split(text, chr(10))) as u, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where u <> '')"


@query("to_annex_b", f"with {_UNITS} select d.doc_id, sha256(coalesce(s.stream, ''::blob)) as digest, cast(octet_length(coalesce(s.stream, ''::blob)) as bigint) as bytes from documents d left join (select doc_id, unhex(string_agg('00000001' || hex(u), '' order by position)) as stream from un group by 1) s on s.doc_id = d.doc_id where d.text is not null")
def to_annex_b(t):
    s = _lines(t).select("doc_id", scalars.to_annex_b(F.col("sample"), 4).alias("stream"))
    return s.select("doc_id", F.sha2("stream", 256).alias("digest"), F.octet_length("stream").cast("long").alias("bytes"))


@query("split_units", f"with {_UNITS} select doc_id, cast(position as int) as position, cast(ascii(chr(('0x' || substr(hex(u), 1, 2))::int)) & 31 as int) as unit_type, sha256(u) as digest from un")
def split_units(t):
    """The units of a start-code stream and their types."""
    u = _lines(t).select("doc_id", F.posexplode(scalars.split_units(scalars.to_annex_b(F.col("sample"), 4))).alias("position", "u"))
    return u.select("doc_id", "position", F.col("u.unit_type").alias("unit_type"), F.sha2("u.unit", 256).alias("digest"))


@query("storage_policies", f"""with {_UNITS}, ty as (select doc_id, position, ('0x' || substr(hex(u), 1, 2))::int & 31 as unit_type from un),
 gr as (select *, sum(case when unit_type = 5 then 1 else 0 end) over (partition by doc_id order by position rows unbounded preceding) as g from ty where unit_type in (1, 5)),
 po as (select * from gr, (values ('idr_only'), ('full_gop')) p(policy) where policy = 'full_gop' or unit_type = 5)
select doc_id, policy, count(distinct g) as groups, count(*) as units from po group by 1, 2""")
def storage_policies(t):
    """What each policy keeps of a stream: key units alone, or groups that a key unit opens."""
    u = _lines(t).select("doc_id", F.posexplode(scalars.split_units(scalars.to_annex_b(F.col("sample"), 4))).alias("position", "u")).select("doc_id", "position", "u.unit_type")
    kept = [ingest.stored(u, ["doc_id"], p).withColumn("policy", F.lit(p)) for p in ("idr_only", "full_gop")]
    return kept[0].unionByName(kept[1]).groupBy("doc_id", "policy").agg(F.countDistinct("group").alias("groups"), F.count(F.lit(1)).alias("units"))


@query("parameter_sets", "select doc_id, cast(4 as int) as length_size, '00000001' || hex(left(lang, 2)) || '00000001' || hex(source) as stream from documents where lang is not null and lang <> '' and source is not null and source <> ''")
def parameter_sets(t):
    """Configuration records, one set of each sort, as start-code streams with the size of their length prefix."""
    d = t.table("documents").filter("lang is not null and lang <> '' and source is not null and source <> ''").select("doc_id", F.hex(F.substring("lang", 1, 2)).alias("s"), F.hex("source").alias("p"))
    size = lambda c: F.lpad(F.hex((F.length(c) / 2).cast("long")), 4, "0")
    record = F.unhex(F.concat(F.lit("0142C01EFFE1"), size("s"), F.col("s"), F.lit("01"), size("p"), F.col("p")))
    return d.select("doc_id", scalars.parameter_sets(record).alias("x")).select("doc_id", "x.length_size", F.hex("x.stream").alias("stream"))


# -- options and single records -------------------------------------------------
_OPT = "op as (select event_id, cast(event_id % 20 as int) as gop_size, cast(user_id % 19 as int) as max_b_frames, cast(event_id * 7 % 4 as int) as adaptive, cast(user_id % 12 as int) as lookahead, cast(event_id % 18 as int) as reference_frames, case event_id % 3 when 0 then 'hierarchical_b' when 1 then 'chained_p' else 'shared_anchor' end as policy from events)"


@query("option_violations", f"""with {_OPT} select * from (select event_id, case when gop_size < 2 then 'group too small' when policy = 'hierarchical_b' and max_b_frames > 16 then 'too many b frames' when policy = 'hierarchical_b' and max_b_frames >= gop_size then 'b frames fill the group'
  when policy = 'hierarchical_b' and adaptive > 2 then 'unknown adaptive mode' when policy = 'hierarchical_b' and adaptive > 0 and lookahead < max_b_frames + 1 then 'lookahead too short' when policy = 'hierarchical_b' and (reference_frames = 0 or reference_frames > 16) then 'reference frames out of range'
  when policy <> 'hierarchical_b' and (max_b_frames, adaptive, lookahead, reference_frames) <> (7, 0, 0, 1) then 'b settings without their policy' when policy = 'shared_anchor' and gop_size > 17 then 'group exceeds the anchor limit' end as reason from op) where reason is not null""")
def option_violations(t):
    e, f = t.table("events"), F.col
    policy = F.element_at(F.array(*map(F.lit, ("hierarchical_b", "chained_p", "shared_anchor"))), (f("event_id") % 3 + 1).cast("int"))
    o = e.select("event_id", (f("event_id") % 20).alias("gop_size"), (f("user_id") % 19).alias("max_b_frames"), (f("event_id") * 7 % 4).alias("adaptive"), (f("user_id") % 12).alias("lookahead"), (f("event_id") % 18).alias("reference_frames"), policy.alias("policy"))
    return o.select("event_id", ingest.option_problem().alias("reason")).filter("reason is not null")


@query("lookup_one", sql("select video_id, frame_type as tier, record_id from catalog qualify row_number() over (partition by video_id, frame_type order by md5(cast(record_id as varchar) || ':7'), record_id) = 1", "catalog"))
def lookup_one(t):
    """One record of each stream and tier, drawn by a seed."""
    return resolve.one_of(t.catalog.withColumnRenamed("frame_type", "tier"), ["video_id", "tier"], "record_id", 7)


# -- broker windows, releases, barriers -----------------------------------------
_BW = """
br as (select window_id, sample_id, arrival_us as arrival, sample_id % 5 < 2 as saturated, cast(sample_id * 7919 % 900000000 as bigint) as service, row_number() over (partition by window_id order by arrival_us, sample_id) as n from requests),
bw as (select window_id, n, sample_id, arrival, 0 as broker_window, arrival as opened, 1 as k, arrival + case when saturated then greatest(120000000, 300000000, service) else 120000000 end as until from br where n = 1
 union all select b.window_id, b.n, b.sample_id, b.arrival, case when j then w.broker_window else w.broker_window + 1 end, case when j then w.opened else b.arrival end, case when j then w.k + 1 else 1 end,
   case when j then w.opened else b.arrival end + case when b.saturated then greatest(120000000, 300000000, b.service) else 120000000 end
 from bw w join br b on b.window_id = w.window_id and b.n = w.n + 1, lateral (select w.k < 8 and b.arrival < w.until as j) x)"""


@query("broker_windows", sql(f"with {_BW} select window_id, sample_id, arrival, broker_window, opened from bw", "catalog", "requests", recursive=True))
def broker_windows(t):
    s = F.col("sample_id")
    r = t.requests.select("window_id", "sample_id", F.col("arrival_us").alias("arrival"), (s % 5 < 2).alias("saturated"), (s * 7919 % 900_000_000).alias("service"))
    return delivery.broker_windows(r, WIN, 8, 120_000_000, 300_000_000).drop("saturated", "service")


@query("early_release", sql(f"""with {_READY}, b as (select window_id, batch_id, max(ready_ns) as ready from rd group by 1, 2), c as (select distinct window_id, batch_id, caller from targets),
 x as (select c.*, ready, count(*) over (partition by c.window_id, caller) = 1 as single, max(ready) over (partition by c.window_id) as last from c join b on b.window_id = c.window_id and b.batch_id = c.batch_id)
select window_id, batch_id, caller, ready, single, case when single then ready else last end as released from x""", "needed"))
def early_release(t):
    ready = _ready(t).groupBy("window_id", "batch_id").agg(F.max("ready_ns").alias("ready"))
    return delivery.released(t.targets.select("window_id", "batch_id", "caller").distinct().join(ready, ["window_id", "batch_id"]), WIN, "caller")


@query("barriers", sql("""with c as (select window_id, arrival_us as a, arrival_us + 1000000 * (60 + sample_id * 13 % 600) as b from requests), m as (select window_id, sample_id as barrier, arrival_us as at from requests where pos = 31)
select m.window_id, m.barrier, m.at, greatest(m.at, coalesce(max(c.b), m.at)) as passed from m left join c on c.window_id = m.window_id and c.a < m.at group by 1, 2, 3""", "catalog", "requests"))
def barriers(t):
    """A barrier after each batch's last request."""
    calls = t.requests.select("window_id", F.col("arrival_us").alias("submitted"), (F.col("arrival_us") + 1_000_000 * (F.lit(60) + F.col("sample_id") * 13 % 600)).alias("ended"))
    return delivery.barriers(calls, WIN, t.requests.filter("pos = 31").select("window_id", F.col("sample_id").alias("barrier"), F.col("arrival_us").alias("at")))


# -- profiles -------------------------------------------------------------------
@query("codec_profile", sql("""with st as (select window_id, unnest(['packet_copy', 'send', 'receive']) as stage, length, record_id from needed),
 a as (select window_id, stage, cast(sum(length * case stage when 'packet_copy' then 1 when 'send' then 3 else 5 end) as bigint) as wall_ns, cast(coalesce(sum(length) filter (record_id % 3 > 0), 0) as bigint) as thread_cpu_ns, count(*) as calls, count(*) filter (record_id % 3 > 0) as cpu_samples, cast(sum(length) as bigint) as bytes from st group by 1, 2),
 k as (select * from (select distinct window_id from needed), (values ('decoder_setup'), ('packet_copy'), ('send'), ('receive'), ('flush'), ('rgb_convert'), ('rgb_copy')) s(stage))
select k.window_id, k.stage, coalesce(wall_ns, 0) as wall_ns, coalesce(thread_cpu_ns, 0) as thread_cpu_ns, coalesce(calls, 0) as calls, coalesce(cpu_samples, 0) as cpu_samples, coalesce(bytes, 0) as bytes from k left join a on a.window_id = k.window_id and a.stage = k.stage""", "needed"))
def codec_profile(t):
    """Totals of every stage of a window's decoding; a third of the calls has no clock of its own thread."""
    s = t.needed.select("window_id", "record_id", "length", F.explode(F.array(*map(F.lit, ("packet_copy", "send", "receive")))).alias("stage"))
    wall = F.col("length") * F.when(F.col("stage") == "packet_copy", 1).when(F.col("stage") == "send", 3).otherwise(5)
    return kernels.profile(s.select("window_id", "stage", wall.alias("wall_ns"), F.when(F.col("record_id") % 3 > 0, F.col("length")).alias("thread_cpu_ns"), F.col("length").alias("bytes")), WIN)


@query("stats_map", sql('select window_id, cast(count(*) as bigint) as records, cast(sum(length) as bigint) as bytes, cast(max("offset") as bigint) as last from needed group by 1', "needed"))
def stats_map(t):
    """Counters as a map from names to numbers, and back."""
    n = t.needed.groupBy("window_id").agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes"), F.max("offset").alias("last"))
    m = n.select("window_id", F.create_map(*(x for c in ("records", "bytes", "last") for x in (F.lit(c), F.col(c).cast("long")))).alias("m"))
    return m.select("window_id", *(F.col("m")[c].alias(c) for c in ("records", "bytes", "last")))
