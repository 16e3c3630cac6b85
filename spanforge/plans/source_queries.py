"""Chunk files and streams: queries that write their input to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut, ensure_checkpoint_dir
from ..sources import chunkfile
from ..streaming import pipeline
from .relations import Relations, query, sql


def _folder(t: Relations, name: str) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


#: Streams are cut every so many bytes here; small, so that the test tables have streams of several chunks.
PART = 1 << 16


def _placed(t: Relations):
    records = t.catalog_text.withColumn("payload", F.coalesce("payload", F.lit("")).cast("binary"))
    return chunkfile.placed(records, PART)


def _written(t: Relations) -> tuple[str, DataFrame]:
    """All records as chunk files in the shared folder; the folder and one row a file."""
    folder = _folder(t, "chunks")
    path = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(t.spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder, cut(chunkfile.write(_placed(t), folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder))


_PART = f"""pt as (select *, cast(floor((record_offset - min(record_offset) over (partition by video_id)) / {PART}) as bigint) as part from catalog_text)"""


@query("write_chunks", sql(f"with {_PART} select video_id, part, count(*) as records, cast(sum(record_length) as bigint) as bytes from pt group by 1, 2", "catalog"))
def write_chunks(t):
    return _written(t)[1].drop("object_key")


@query("scan_header", sql(f"with {_PART} select 'SPFC' as magic, cast(1 as int) as version, 'text' as codec, cast(6 as bigint) as config_bytes, cast(sum(record_length) as bigint) as payload_bytes from pt group by video_id, part", "catalog"))
def scan_header(t):
    """The headers of chunk files that hold the whole catalog."""
    return chunkfile.headers(t.spark, _written(t)[0] + "/*.chunk").select("magic", "version", "codec", "config_bytes", "payload_bytes")


@query("validate_header", sql(f"with {_PART} select count(distinct (video_id, part)) as files, count(distinct (video_id, part)) as valid from pt", "catalog"))
def validate_header(t):
    h = chunkfile.headers(t.spark, _written(t)[0] + "/*.chunk")
    good = (F.col("magic") == chunkfile.MAGIC) & (F.col("version") == chunkfile.VERSION) & (F.col("payload_bytes") > 0) & (F.col("index_bytes") > 0) & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("fps_num") > 0) & (F.col("fps_den") > 0)
    return h.agg(F.count(F.lit(1)).alias("files"), F.count_if(good).alias("valid"))


@query("read_ranges", "select doc_id as sample_id, left(sha256(text), 16) as digest, cast(strlen(text) as bigint) as bytes from documents where strlen(text) > 0")
def read_ranges(t):
    """Every record's bytes read back from the chunk files by object, offset and length."""
    folder = _written(t)[0]
    wanted = _placed(t).filter("length > 0").select("object_key", "offset", "length", F.col("id").alias("sample_id"))
    got = chunkfile.ranges(chunkfile.payloads(t.spark, folder + "/*.chunk"), wanted, "sample_id")
    return got.select("sample_id", F.substring(F.sha2("data", 256), 1, 16).alias("digest"), F.octet_length("data").cast("long").alias("bytes"))


@query("pipeline_stream", "select user_id, count(*) as events, round(sum(value), 6) as total from events group by 1")
def pipeline_stream(t):
    """Events as a stream of files, taken in order in micro-batches, summed over what was appended."""
    events, base = t.table("events"), _folder(t, "stream")
    events.select("event_id", "user_id", "value").repartitionByRange(4, "event_id").write.parquet(f"{base}/in")
    done = pipeline.drain(t.spark, f"{base}/in/*.parquet", "event_id long, user_id long, value double", lambda b: b, f"{base}/out", f"{base}/ckpt")
    return done.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))
