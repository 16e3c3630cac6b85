"""Feedback over sessions of windows: the estimator's trace, the models it leaves, and the plans chosen under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import DEFAULT
from ..operators import costing, feedback
from .relations import Relations, query, sql
from .span_queries import _PLANS, _islands, plans
from .state_queries import _OBS, WIN, _observed

#: Windows in turn form a session.
SESSION = 64
IO_START, DECODE_START = [100_000.0, 1.0, 65_536.0], [20_000.0, 48_000.0]


def _clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _moved(theta: str, x: str, shared: str, clipped: str, norm: str, start: float) -> str:
    limit = f"(0.5 * greatest(abs({theta}), {shared}))"
    step = _clamp(f"0.25 * {clipped} * {x} / {norm}", f"-{limit}", limit)
    return _clamp(f"{theta} + {step}", "1.0", repr(max(50 * start, 1e6)))


_BAD = "(active and not fallback and io_bad2 >= 8)"
_WELL = "(active and fallback and io_good2 >= 8 and de_good2 >= 8)"
_FRESH = f"(not was_active and active or {_WELL})"


def _kept(new: str, reset: str) -> str:
    return f"case when {_BAD} then {reset} else {new} end"


def _ratios(r: str) -> str:
    return f"case when {_BAD} or {_FRESH} then [] else {r} end"


def _tail(r: str) -> str:
    return f"case when active and not fallback and len({r}) >= 16 then greatest(1.0, list_sort({r})[cast(ceil(len({r}) * 0.95::double) as int)]) else 16.0 end"


# one observation a step: forecasts, clipped errors, moved coefficients, streaks, the latch, and what it resets
_TRACE = f"""{_OBS},
fo as (select cast(floor(window_id / {SESSION}) as bigint) as session, window_id as seq, row_number() over (partition by floor(window_id / {SESSION}) order by window_id) as n,
  ceil(ranges / 8.0::double) as x0, greatest(ranges - ceil(ranges / 8.0::double), 0) / 8.0::double as x1, bytes / 65536.0::double as x2, units / 16.0::double as x3,
  io_ns::double as y, 30000.0::double + units * 3500.0::double as z from ob),
tr as (
  select distinct session, 0::bigint as n, null::bigint as seq, 0.0::double as ip, 0.0::double as dp, {IO_START[0]}::double as a0, {IO_START[1]}::double as a1, {IO_START[2]}::double as a2, {DECODE_START[0]}::double as b0, {DECODE_START[1]}::double as b1,
    null::double as si, null::double as sd, 0 as io_n, 0 as de_n, 0 as io_good, 0 as io_bad, 0 as de_good, []::double[] as ri, []::double[] as rd, false as active, false as fallback from fo
  union all
  select session, n, seq, ip, dp, {_kept('c0', str(IO_START[0]))}, {_kept('c1', str(IO_START[1]))}, {_kept('c2', str(IO_START[2]))}, {_kept('e0', str(DECODE_START[0]))}, {_kept('e1', str(DECODE_START[1]))},
    {_kept('si2', 'null')}, {_kept('sd2', 'null')}, {_kept('io_n2', '0')}, {_kept('de_n2', '0')}, {_kept('io_good2', '0')}, {_kept('io_bad2', '0')}, {_kept('de_good2', '0')},
    {_ratios('ri2')}, {_ratios('rd2')}, active, case when {_BAD} then true when {_WELL} then false else fallback end
  from (
    select *, was_active or (io_n2 >= 16 and de_n2 >= 16 and io_good2 >= 4 and de_good2 >= 4) as active from (
    select *, io_n + 1 as io_n2, de_n + 1 as de_n2, case when abs(y - ip) / y <= 0.5 then io_good + 1 else 0 end as io_good2, case when abs(y - ip) / y <= 0.5 then 0 else io_bad + 1 end as io_bad2,
      case when abs(z - dp) / z <= 0.5 then de_good + 1 else 0 end as de_good2,
      case when si is null then greatest(abs(y - ip), 1000.0) else 0.98::double * si + (1 - 0.98::double) * abs(y - ip) end as si2,
      case when sd is null then greatest(abs(z - dp), 1000.0) else 0.98::double * sd + (1 - 0.98::double) * abs(z - dp) end as sd2,
      case when ip > 0 then list_append(ri, {_clamp('y / ip', '0.25', '16.0')})[-128:] else ri end as ri2, case when dp > 0 then list_append(rd, {_clamp('z / dp', '0.25', '16.0')})[-128:] else rd end as rd2,
      {_moved('a0', 'x0', 'hi', 'ki', 'ni', IO_START[0])} as c0, {_moved('a1', 'x1', 'hi', 'ki', 'ni', IO_START[1])} as c1, {_moved('a2', 'x2', 'hi', 'ki', 'ni', IO_START[2])} as c2,
      {_moved('b0', '1.0', 'hd', 'kd', 'nd', DECODE_START[0])} as e0, {_moved('b1', 'x3', 'hd', 'kd', 'nd', DECODE_START[1])} as e1 from (
    select *, {_clamp('y - ip', '-3.0 * gi', '3.0 * gi')} as ki, {_clamp('z - dp', '-3.0 * gd', '3.0 * gd')} as kd, greatest(abs(ip / sqrt(ni)), 1000.0) as hi, greatest(abs(dp / sqrt(nd)), 1000.0) as hd from (
    select *, coalesce(si, greatest(0.25 * abs(ip), 1000.0)) as gi, coalesce(sd, greatest(0.25 * abs(dp), 1000.0)) as gd, x0 * x0 + x1 * x1 + x2 * x2 + 1e-9::double as ni, 1.0::double + x3 * x3 + 1e-9::double as nd from (
    select fo.*, tr.a0, tr.a1, tr.a2, tr.b0, tr.b1, tr.si, tr.sd, tr.io_n, tr.de_n, tr.io_good, tr.io_bad, tr.de_good, tr.ri, tr.rd, tr.active as was_active, tr.fallback,
      greatest(0.0, a0 * x0 + a1 * x1 + a2 * x2) as ip, greatest(0.0, b0 + b1 * x3) as dp
    from tr join fo on fo.session = tr.session and fo.n = tr.n + 1)))))),
tt as (select *, {_tail('ri')} as io_tail, {_tail('rd')} as decode_tail from tr where n > 0),
md as (select session, seq, u as in_use, case when u then w0 else {DEFAULT.latency_ns}::double end as wave_first_ns, case when u then w1 / 8.0::double else 0.0 end as wave_step_ns,
    case when u then 65536.0::double / greatest(w2, 1.0) else {DEFAULT.bytes_per_ns}::double end as bytes_per_ns, case when u then v0 else {DEFAULT.decode_fixed_ns}::double end as decode_fixed_ns,
    case when u then v1 / 16.0::double else {DEFAULT.decode_unit_ns}::double end as decode_unit_ns, io_tail, decode_tail
  from (select session, seq, coalesce(lag(active and not fallback) over w, false) as u, lag(a0) over w as w0, lag(a1) over w as w1, lag(a2) over w as w2, lag(b0) over w as v0, lag(b1) over w as v1,
    coalesce(lag(io_tail) over w, 16.0) as io_tail, coalesce(lag(decode_tail) over w, 16.0) as decode_tail from tt window w as (partition by session order by seq)))"""


def _trace(t: Relations):
    f = feedback.features(_observed(t), 8).withColumn("session", F.floor(F.col("window_id") / SESSION).cast("long")).withColumn("seq", F.col("window_id"))
    f = f.withColumn("decode_ns", F.lit(30_000.0) + F.col("units") * 3_500.0).withColumn("io_ns", F.col("io_ns").cast("double"))
    return feedback.trace(f.select("session", "seq", "f_waves", "f_extra", "f_pages", "f_units", "io_ns", "decode_ns"), IO_START, DECODE_START)


def _rounded(df, *keep: str):
    return df.select(*(c if c in keep else F.round(c, 3).alias(c) for c in df.columns))


@query("feedback_trace", sql(f"""with {_TRACE} select session, seq, round(ip, 3) as io_predicted_ns, round(dp, 3) as decode_predicted_ns, round(io_tail, 3) as io_tail, round(decode_tail, 3) as decode_tail, active, fallback,
  round(a0, 3) as wave_ns, round(a1, 3) as extra_ns, round(a2, 3) as page_ns, round(b0, 3) as fixed_ns, round(b1, 3) as units_ns from tt""", "needed", recursive=True))
def feedback_trace(t):
    return _rounded(_trace(t), "session", "seq", "active", "fallback")


@query("feedback_models", sql(f"with {_TRACE} select session, seq, in_use, round(wave_first_ns, 3) as wave_first_ns, round(wave_step_ns, 3) as wave_step_ns, round(bytes_per_ns, 3) as bytes_per_ns, round(decode_fixed_ns, 3) as decode_fixed_ns, round(decode_unit_ns, 3) as decode_unit_ns, round(io_tail, 3) as io_tail, round(decode_tail, 3) as decode_tail from md", "needed", recursive=True))
def feedback_models(t):
    """The cost model each window is planned with: the start's, or what the session has learned."""
    return _rounded(feedback.models(_trace(t), DEFAULT), "session", "seq", "in_use")


def _own(t: Relations, tail: bool = False):
    by_window = feedback.models(_trace(t), DEFAULT).withColumnRenamed("seq", "window_id").drop("session", "in_use")
    return feedback.priced(plans(t), WIN, by_window, DEFAULT, tail)


def _under(io_x: str, decode_x: str) -> str:
    wave = "(wave_first_ns + ({n} - 1) * wave_step_ns)".format
    io = f"(floor(ranges / 8) * {wave(n=8)} + case when ranges % 8 > 0 then {wave(n='(ranges % 8)')} else 0.0 end + bytes / bytes_per_ns) * {io_x}"
    decode = f"case when units > 0 then decode_fixed_ns + units * decode_unit_ns else 0.0 end * {decode_x}"
    return f"""{_PLANS}, {_TRACE.replace(_islands(16384) + ', ', '')}, op as (select s.*, {io} as i_ns, {decode} as d_ns from shape s join md on md.seq = s.window_id), oq as (select *, i_ns + d_ns - {DEFAULT.overlap} * least(i_ns, d_ns) as total_ns from op)"""


@query("feedback_choice", sql(f"""with {_under('1.0', '1.0')}, rated as (select *, min(total_ns) over (partition by window_id) as low, min(total_ns) filter (kind = 'fixed') over (partition by window_id) as fixed_total_ns from oq)
select window_id, kind, threshold, ranges, bytes, units, round(total_ns, 3) as total_ns from rated where total_ns <= low + {DEFAULT.tolerance_ns} and total_ns <= fixed_total_ns and kind <> 'fixed'
qualify row_number() over (partition by window_id order by bytes, units, ranges, total_ns, kind desc, threshold nulls first) = 1""", "marked", recursive=True))
def feedback_choice(t):
    """Plans chosen under the model that the session's earlier windows left."""
    out = costing.choose(_own(t), WIN, DEFAULT)
    return out.select("window_id", "kind", "threshold", "ranges", "bytes", "units", F.round("total_ns", 3).alias("total_ns"))


@query("feedback_risk", sql(f"with {_under('io_tail', 'decode_tail')} select window_id, kind, count(*) as plans, count(*) filter (total_ns <= 20000000.0) as within, round(min(total_ns), 3) as least_ns from oq group by 1, 2", "marked", recursive=True))
def feedback_risk(t):
    """Plans that keep a latency promise even at the bad end of what was observed."""
    p = _own(t, tail=True)
    return p.groupBy("window_id", "kind").agg(F.count(F.lit(1)).alias("plans"), F.count_if(F.col("total_ns") <= 20_000_000.0).alias("within"), F.round(F.min("total_ns"), 3).alias("least_ns"))


# -- branches -------------------------------------------------------------------
@query("branch_stats", sql("""with b as (select window_id, record_id % 2 as branch, count(*) as records, cast(sum(length) as bigint) as bytes, count(distinct (video_id, gop_id)) as decode_groups, max(packet_index) as last_packet, cast(100000 + sum(length) as bigint) as fetch_ns, min(length) as first_ready_ns from needed group by 1, 2)
select window_id, cast(sum(records) as bigint) as records, cast(sum(bytes) as bigint) as bytes, cast(sum(decode_groups) as bigint) as decode_groups, max(last_packet) as last_packet, max(fetch_ns) as fetch_ns, coalesce(min(first_ready_ns) filter (first_ready_ns > 0), 0) as first_ready_ns from b group by 1""", "needed"))
def branch_stats(t):
    """Counters of two branches of a window that run side by side, as one."""
    b = t.needed.groupBy("window_id", (F.col("record_id") % 2).alias("branch")).agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes"), F.countDistinct("video_id", "gop_id").alias("decode_groups"), F.max("packet_index").alias("last_packet"), (F.sum("length") + 100_000).alias("fetch_ns"), F.min("length").alias("first_ready_ns"))
    return feedback.merged(b, WIN, ["records", "bytes", "decode_groups"], ["last_packet", "fetch_ns"], ["first_ready_ns"])
