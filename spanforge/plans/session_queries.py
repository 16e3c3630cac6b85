"""Whole windows through a session: resolve, plan, fetch, cut, decode, restore."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels
from ..session import Session, plan_byte_ranges
from .relations import Relations, query, sql
from .span_queries import _islands

_DECODED = "dg as (select cl.target_id, sha256(string_agg(c.text, '' order by cl.packet_index)) as digest, cast(sum(strlen(c.text)) as bigint) as width from closure cl join catalog_text c on c.record_id = cl.dep_id group by 1)"
_ALL = sql(f"with {_DECODED} select window_id, batch_id, pos, sample_id, record_id, digest, width from targets t join dg on dg.target_id = t.record_id", "targets", "closure")


def _session(t: Relations) -> Session:
    return Session(t.catalog, t.placed_closure, t.payloads.withColumnRenamed("text", "data"))


for _action in ("calibrated_closure", "exact_closure", "fixed_gap_closure", "region_all", "keyframe_prefix"):
    query(f"execute_{_action}", _ALL)(lambda t, a=_action: _session(t).execute(t.requests, a))


@query("execute_portfolio", _ALL)
def execute_portfolio(t):
    done = kernels.digest(kernels.jobs(t.closure, t.payloads, t.catalog)).select(F.col("target_id").alias("record_id"), "digest", "width")
    return _session(t).execute_portfolio(t.requests, done.filter(F.col("record_id") % 3 == 0))


@query("plan_byte_ranges", sql(f'with {_islands(512)} select window_id, span, record_id, "offset", length, "offset" - min("offset") over (partition by window_id, span) as relative_offset from i_512', "needed"))
def byte_ranges(t):
    return plan_byte_ranges(t.needed.select("window_id", "record_id", "offset", "length"), 512, keys=["window_id"], empty=True)


@query("session_plan", sql("select window_id, count(*) as targets, count(distinct record_id) as unique_targets from targets group by 1", "targets"))
def session_plan(t):
    """Windows that got a plan, with what they asked for."""
    s = _session(t)
    n = s.resolve(t.requests).groupBy("window_id").agg(F.count(F.lit(1)).alias("targets"), F.countDistinct("record_id").alias("unique_targets"))
    return n.join(s.plan(t.requests).select("window_id"), "window_id")
