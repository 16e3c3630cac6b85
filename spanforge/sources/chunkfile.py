"""A single-file chunk: length-prefixed header, parameter sets, payload, Parquet index.

Files are read by Spark (``binaryFile``), so any store that Spark reaches serves; the
header's section lengths must add up to the file's length.
"""

from __future__ import annotations

import io
import json
import struct
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = "SPFC", 1
HEADER = "path string, magic string, version int, codec string, width int, height int, fps_num int, fps_den int, config_bytes long, payload_bytes long, index_bytes long, created_at long"
_FIELDS = ("magic", "version", "codec", "width", "height", "fps_num", "fps_den", "config_bytes", "payload_bytes", "index_bytes", "created_at")


def build(config: bytes, payload: bytes, index: pa.Table, codec: str = "text", width: int = 1, height: int = 1, fps: tuple[int, int] = (25, 1), created_at: int = 0) -> bytes:
    """The bytes of a chunk."""
    sink = io.BytesIO()
    pq.write_table(index, sink)
    tail = sink.getvalue()
    head = json.dumps(dict(zip(_FIELDS, (MAGIC, VERSION, codec, width, height, *fps, len(config), len(payload), len(tail), created_at), strict=True))).encode()
    return struct.pack(">I", len(head)) + head + config + payload + tail


def parse(data: bytes) -> dict:
    """The header of a chunk; errors name what is wrong."""
    if len(data) < 4:
        raise ValueError("chunk is shorter than its length prefix")
    (n,) = struct.unpack(">I", data[:4])
    if 4 + n > len(data):
        raise ValueError("chunk header is cut")
    head = json.loads(data[4 : 4 + n])
    if problem := invalid(head):
        raise ValueError(problem)
    if 4 + n + head["config_bytes"] + head["payload_bytes"] + head["index_bytes"] != len(data):
        raise ValueError("section lengths don't add up to the file's length")
    return head | {"payload_start": 4 + n + head["config_bytes"]}


def invalid(head: dict) -> str | None:
    if head.get("magic") != MAGIC:
        return "wrong magic"
    if head.get("version") != VERSION:
        return "unknown version"
    if not head.get("codec"):
        return "no codec"
    if any(head.get(k, 0) <= 0 for k in ("width", "height", "fps_num", "fps_den", "payload_bytes", "index_bytes")):
        return "dimensions, rate and sections must be positive"
    return None


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a chunk file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                head = parse(batch.column(1)[i].as_py())
                row = {"path": batch.column(0)[i].as_py(), **{k: head[k] for k in _FIELDS}}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(HEADER))
    return files.mapInArrow(run, HEADER)


#: Bytes after which a stream goes on in its next chunk, so that a chunk fits a worker whatever the stream's size.
PART_BYTES = 64 << 20

#: Columns of a chunk's index.
INDEX = ("record_id", "frame_idx", "gop_id", "packet_index", "frame_type", "offset", "length")


def placed(records: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Records with their chunk and their offset in its payload.

    records: video_id, record_id, record_offset (in the whole catalog), record_length. A record belongs to the
    part of its stream in which it begins. Two small aggregates and no window over a stream.
    """
    first = records.groupBy("video_id").agg(F.min("record_offset").alias("_v"))
    r = records.join(first, "video_id").withColumn("part", F.floor((F.col("record_offset") - F.col("_v")) / part_bytes).cast("long"))
    base = r.groupBy("video_id", "part").agg(F.min("record_offset").alias("_b"))
    r = r.join(base, ["video_id", "part"]).withColumn("offset", F.col("record_offset") - F.col("_b")).withColumnRenamed("record_length", "length")
    return r.withColumn("object_key", F.concat_ws("-", F.sha2("video_id", 256).substr(1, 16), F.col("part").cast("string"))).drop("_v", "_b")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write placed records (with ``payload`` bytes) as chunk files; one row a file: object_key, video_id, part, records, bytes.

    Each file appears whole or not at all: it is written beside its place and moved there. Names follow from the
    records, so a task that runs again writes the same file. The folder must be one that all executors share.
    """
    columns = ["object_key", "video_id", "part", *INDEX, "payload"]

    def run(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        table = table.sort_by("offset")
        lengths = [len(b) for b in table.column("payload").to_pylist()]
        if lengths != table.column("length").to_pylist() or any(a + n != b for a, n, b in zip(table.column("offset").to_pylist(), lengths, table.column("offset").to_pylist()[1:], strict=False)):
            raise ValueError("payloads don't fill their places")
        key = table.column("object_key")[0].as_py()
        data = build(b"config", b"".join(table.column("payload").to_pylist()), table.select(list(INDEX)))
        store, base = fs.FileSystem.from_uri(folder)
        beside = f"{base}/.{key}.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as out:
            out.write(data)
        store.move(beside, f"{base}/{key}.chunk")
        return pa.table({"object_key": [key], "video_id": [table.column("video_id")[0].as_py()], "part": [table.column("part")[0].as_py()], "records": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([sum(lengths)], pa.int64())})

    return records.select(*columns).groupBy("object_key").applyInArrow(run, "object_key string, video_id string, part long, records long, bytes long")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """object_key and payload of each chunk file; a file that is cut or isn't a chunk fails the query."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = parse(data)
                at = head["payload_start"]
                yield pa.RecordBatch.from_pydict({"object_key": [name.rsplit("/", 1)[1].removesuffix(".chunk")], "content": [data[at : at + head["payload_bytes"]]]}, schema=pa.schema([("object_key", pa.string()), ("content", pa.binary())]))

    return files.mapInArrow(run, "object_key string, content binary")


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Bytes of one chunk's payload, bounds checked."""
    data = spark.read.format("binaryFile").load(path).first()["content"]
    head = parse(bytes(data))
    if offset < 0 or length <= 0 or offset + length > head["payload_bytes"]:
        raise ValueError("range is outside the payload")
    start = head["payload_start"] + offset
    return bytes(data[start : start + length])


def ranges(files: DataFrame, wanted: DataFrame, *keep: str) -> DataFrame:
    """Bytes of many ranges (object_key, offset, length) of whole files (object_key, content), ranges outside left null."""
    both = wanted.join(files, "object_key")
    fits = (F.col("offset") >= 0) & (F.col("length") > 0) & (F.col("offset") + F.col("length") <= F.octet_length("content"))
    return both.select("object_key", "offset", "length", *keep, F.when(fits, F.expr("substring(content, cast(offset as int) + 1, cast(length as int))")).alias("data"))
