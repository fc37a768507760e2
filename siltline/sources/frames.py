"""From bytes to frames: newline, octet counting, datagrams, multi-line records, batches; and directory drops.

A frame keeps its raw bytes and what stood around them, so that prefix, raw and suffix of all frames in order are the
input again. Files are read as binary; a byte stream is framed in one pass.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMING = "struct<method:string,raw_prefix:binary,raw_suffix:binary,truncation_status:string,confidence:string,original_length:bigint,batch_hash:string,batch_index:int,batch_size:int,fragments:int>"
FRAME = f"array<struct<raw:binary,framing:{FRAMING}>>"
MOST_BYTES = 1 << 16


def _frame(raw: bytes, method: str, prefix: bytes = b"", suffix: bytes = b"", truncation: str = "none", confidence: str = "high", length: int | None = None, **batch: object) -> dict:
    about = {"method": method, "raw_prefix": prefix, "raw_suffix": suffix, "truncation_status": truncation, "confidence": confidence, "original_length": length, "batch_hash": None, "batch_index": None, "batch_size": None, "fragments": 1}
    return {"raw": raw, "framing": about | batch}


def line_frames(line: bytes, end: bytes, most: int, ended: bool, method: str = "newline") -> Iterator[dict]:
    """One line: whole, or in pieces of ``most`` bytes of which all but the last are truncated and the last continues."""
    if len(line) <= most:
        yield _frame(line, method, suffix=end, confidence="high" if ended else "low")
        return
    for at in range(0, len(line), most):
        last = at + most >= len(line)
        yield _frame(line[at : at + most], method, suffix=end if last else b"", truncation="continuation" if last else "truncated", confidence="low", length=len(line))


def newline(data: bytes, most: int = MOST_BYTES) -> Iterator[dict]:
    at = 0
    while at < len(data):
        stop = data.find(b"\n", at)
        ended = stop >= 0
        line, after = data[at : stop if ended else len(data)], stop + 1 if ended else len(data)
        end = b"\n" if ended else b""
        if ended and line.endswith(b"\r"):
            line, end = line[:-1], b"\r\n"
        yield from line_frames(line, end, most, ended)
        at = after


COUNT = re.compile(rb"([1-9][0-9]{0,8}) ")


def octet(data: bytes, most: int = MOST_BYTES) -> Iterator[dict]:
    """RFC 6587: each frame is counted if it starts with a count, else a line."""
    at = 0
    while at < len(data):
        m = COUNT.match(data, at)
        if not m:
            stop = data.find(b"\n", at)
            stop = len(data) if stop < 0 else stop
            ended = stop < len(data)
            yield from line_frames(data[at:stop], b"\n" if ended else b"", most, ended, "octet_newline")
            at = stop + ended
            continue
        n, at = int(m[1]), m.end()
        raw = data[at : at + n]
        at += n
        short = len(raw) < n
        if len(raw) > most:
            pieces = [raw[i : i + most] for i in range(0, len(raw), most)]
            for k, piece in enumerate(pieces):
                yield _frame(piece, "octet_counted", prefix=m[0] if not k else b"", truncation="continuation" if k == len(pieces) - 1 else "truncated", confidence="low", length=n)
        else:
            yield _frame(raw, "octet_counted", prefix=m[0], truncation="truncated" if short else "none", confidence="low" if short else "high", length=n if short else None)


def datagram(data: bytes, most: int = MOST_BYTES) -> Iterator[dict]:
    over = len(data) > most
    yield _frame(data[:most], "udp_datagram", truncation="truncated" if over else "none", confidence="low" if over else "high", length=len(data) if over else None)


def debatch(data: bytes, most: int = 100_000) -> list[dict]:
    """The elements of a JSON array with their own bytes; anything else is one frame, as it is."""
    whole = [_frame(data, "whole")]
    space = len(data) - len(data.lstrip(b" \t\r\n"))
    if data[space : space + 1] != b"[":
        return whole
    try:
        text = data.decode()
        size = len(json.loads(text))
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError):
        return whole
    if not 0 < size <= most:
        return whole
    decoder, at, spans = json.JSONDecoder(), text.index("[") + 1, []
    blank = re.compile(r"[ \t\r\n]*")
    for _ in range(size):
        at = blank.match(text, at).end()
        _, stop = decoder.raw_decode(text, at)
        spans.append((at, stop))
        at = blank.match(text, stop).end() + 1
    about = {"batch_hash": "sha256:" + hashlib.sha256(data).hexdigest(), "batch_size": size}
    out = []
    for n, (a, b) in enumerate(spans):
        before = text[: spans[0][0]] if not n else ""
        after = text[b : spans[n + 1][0]] if n + 1 < size else text[b:]
        out.append(_frame(text[a:b].encode(), "json_batch", prefix=before.encode(), suffix=after.encode(), batch_index=n, **about))
    return out


METHODS = {"newline": newline, "octet": octet, "datagram": datagram, "debatch": debatch, "whole": lambda data: iter([_frame(data, "whole")])}


def frames(df: DataFrame, method: str = "newline", content: str = "content", **options) -> DataFrame:
    """A row for each frame: the other columns of ``df``, frame_index, raw, framing. Null content has no frames."""
    others = [c for c in df.columns if c != content]
    rows = df.where(F.col(content).isNotNull()).select(F.struct(*(others or [F.lit(0).alias("_none")])).alias("row"), F.col(content).cast("binary").alias("content"))
    schema = rows.select("row", F.lit(None).cast(FRAME).alias("frames")).schema
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["frames"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [list(METHODS[method](raw, **options)) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["row", "frames"])

    made = rows.mapInArrow(run, schema).select("row", F.posexplode("frames").alias("frame_index", "f"))
    return made.select(*(F.col("row")[c].alias(c) for c in others), "frame_index", "f.raw", "f.framing")


def one_of_each(framing: str = "framing") -> Column:
    """True for one frame of each line, counted message, datagram or element, however many pieces it came in.

    A counted message's first piece has its count before it; of a line, the last piece is the one that isn't truncated.
    """
    f = F.col(framing)
    counted = F.when(f["method"] == "octet_counted", F.octet_length(f["raw_prefix"]) > 0)
    return counted.when(f["method"].isin("newline", "octet_newline"), f["truncation_status"] != "truncated").otherwise(True)


def files(spark: SparkSession, path: str, stream: bool = False, schema: str | None = None) -> DataFrame:
    """Files of a drop folder as (path, modificationTime, length, content); hidden and ``.done`` ones are left out."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    return reader.format("binaryFile").load(path).where(~F.col("path").rlike(r"(?:/\.[^/]*|\.done)$"))


def multiline(df: DataFrame, start: str, partition: list[str], order: str, text: str = "raw", most_lines: int = 512, end: str | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """Lines joined into records: each line that matches ``start`` begins one.

    One row for each record: ``partition``, record, first (the order of its first line), n_lines, raw (the lines' bytes with
    their own terminators between them, which the binary column ``end`` has; LF without one), suffix (the last one's), text (raw as
    a string, null if it isn't UTF-8), confidence (low where no start began it, or where ``most_lines`` lines or
    ``most_bytes`` bytes ended it: a record goes on in the next row at every such many lines, or bytes before a line).
    """
    w = Window.partitionBy(*partition).orderBy(order)
    bytes_, ends = F.col(text).cast("binary"), F.col(end).cast("binary") if end else F.lit(b"\n")
    own = df.withColumn("_b", bytes_).withColumn("_e", F.coalesce(ends, F.lit(b"")))
    marked = own.withColumn("_s", F.coalesce(F.col("_b").cast("string").rlike(start), F.lit(False)).cast("int")).withColumn("_r", F.sum("_s").over(w))
    within = Window.partitionBy(*partition, "_r").orderBy(order)
    size = F.octet_length("_b") + F.octet_length("_e")
    before = F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("_l", F.floor((F.row_number().over(within) - 1) / most_lines)).withColumn("_p", F.floor(before / most_bytes))
    groups = marked.groupBy(*partition, "_r", "_l", "_p").agg(
        F.min(order).alias("first"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex("_b").alias("h"), F.hex("_e").alias("e")))).alias("l")
    )
    last = F.get("l", F.size("l") - 1)
    hexed = F.concat(F.array_join(F.transform(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: F.concat(x["h"], x["e"])), ""), last["h"])
    low = (F.col("_r") == 0) | (F.col("_l") + F.col("_p") > 0) | (F.col("n_lines") >= most_lines)
    out = groups.withColumn("raw", F.unhex(hexed))
    return out.select(*partition, F.col("_r").alias("record"), "first", "n_lines", "raw", F.unhex(last["e"]).alias("suffix"), F.try_validate_utf8(F.col("raw").cast("string")).alias("text"), F.when(low, "low").otherwise("high").alias("confidence"))


def reconstructed(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): prefix, raw and suffix of all frames in order, byte for byte."""
    hexed = F.concat(*(F.hex(c) for c in ("framing.raw_prefix", "raw", "framing.raw_suffix")))
    parts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_index", hexed.alias("h")))).alias("p"))
    return parts.select(*keys, F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("content"))
