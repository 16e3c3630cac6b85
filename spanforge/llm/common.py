"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORKER: dict = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod`` (the fold of a row)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def fold(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is named and all runs in one process (tests), set one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanforge-ckpt-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder, for tables of one run."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under the shared folder: like ``cut``, for wide rows of which few columns are read again."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a run, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The files outlive executors, so a lost one costs no recomputation of what
    stands before the cut, and later passes all see the very same rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str) -> tuple[str, str]:
    """A key of its own for one model, to keep it by in the workers."""
    return name, uuid.uuid4().hex


def per_worker(key: tuple, build: Callable):
    """Build once in each Python worker; of one kind (the key's first part) only the latest is kept, three in all."""
    if key not in _WORKER:
        for old in [k for k in _WORKER if k[0] == key[0]]:
            del _WORKER[old]
        while len(_WORKER) >= 3:
            del _WORKER[next(iter(_WORKER))]
        _WORKER[key] = build()
    return _WORKER[key]


def filter_rows(df: DataFrame, column: str, decide: Callable[[list], list[bool]], rows: int = 1000) -> DataFrame:
    """The rows of ``df``, all columns, whose value in ``column`` the function keeps; it gets at most ``rows`` values at once."""
    at = df.columns.index(column)
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(decide(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches to Python have at most ``rows`` rows: texts can be long, and two batches per task are held at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def map_rows(df: DataFrame, columns: list[str], schema: str, work: Callable[[dict], dict], rows: int = 2000) -> DataFrame:
    """``mapInArrow`` over the named columns only.

    ``work`` gets a dict of Python lists for at most ``rows`` rows, so a batch of
    long texts stays small, and returns a dict of lists in the order of ``schema``.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
