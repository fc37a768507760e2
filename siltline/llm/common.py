"""What the operators of this subpackage share: words, row ids, and tables in the shared folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: White space between words, as a character class for Java's, DuckDB's and Python's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"


def words(raw: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a UTF-8 text with A-Z lower-cased (``bytes.split`` splits at just these six)."""
    return raw.translate(ASCII_LOWER).split()


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of one Arrow batch to a Python worker, where the session leaves Spark's default of 64 MB: rows with long texts
#: would fill memory otherwise, in the worker and beside the executor's heap.
BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a session on one machine may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "/tmp/checkpoints").rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session has its own size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


#: Tables of the open ``scratch`` blocks of each thread, innermost last.
_open = threading.local()


def _removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at its end, but those that are kept, which are an outer block's, if there is one.

    Only for tables that have been read by then: what a DataFrame that outlives the block still reads must be kept.
    """
    blocks, own = _open.__dict__.setdefault("blocks", []), []
    blocks.append(own)
    try:
        yield
    finally:
        blocks.pop()
        for path in own:
            _removed(spark, path)


def written(df: DataFrame, name: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Pages are packed by ``codec``, or by the session's.
    The table is removed at the end of the ``scratch`` block that it belongs to, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/siltline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    blocks = _open.__dict__.get("blocks", [])[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(df: DataFrame) -> None:
    """Removes a table that ``written`` has returned, once nothing reads it any more."""
    _removed(df.sparkSession, df.written_to)


#: A key is hot if it has at least one in so many of the rows: there are no more hot keys than that.
HOT = 1024


def hot_keys(counted: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """Of ``counted`` (a row for each key, with the number ``n`` of its rows), the hot keys: at most ``HOT``."""
    return counted.where(F.col(n) * HOT >= total).select(key)


def joined(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has at most a row for each key.

    Rows of the keys ``hot`` (at most ``HOT``) stay where they are and meet a broadcast of those keys' rows of ``one``; all
    others are shuffled by key. So no task gets more than its share of a key that a third of all rows have.
    """
    hot = F.broadcast(hot)
    near = many.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key, how)
    return many.join(hot, key, "left_anti").join(one, key, how).unionByName(near)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if ``df`` has such a column (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches of about ``most`` bytes of the column ``text`` each, so that memory doesn't follow the batch."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(most, batch.column(text).nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
