"""Delivery: NDJSON, HTTP, syslog over TCP, and bulk indexing, from micro-batches. UDP is not offered: it can't be acknowledged.

Every sink is given whole batches by ``foreachBatch`` and sends them from the executors, partition by partition; what it
repeats after a failure carries the same ids, so that receivers which index by id stay exact.
"""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Rejected(Exception):
    """The receiver refuses what it was sent."""


def ndjson(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def chunks(rows: Iterator[Row], most: int) -> Iterator[list[Row]]:
    part: list[Row] = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield part
            part = []
    if part:
        yield part


def retried(send: Callable[[], int], tries: int = 5, wait: float = 0.2) -> None:
    """Until ``send`` gives a status below 300; 429 and 5xx, and a lost connection, are tried again."""
    for n in range(tries):
        try:
            status = send()
            if status < 300:
                return
            if status != 429 and status < 500:
                raise Rejected(status)
        except OSError:
            if n == tries - 1:
                raise
        time.sleep(wait * 2**n)
    raise Rejected("no more tries")


def post(url: str, body: bytes, kind: str = "application/x-ndjson", headers: dict[str, str] | None = None) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, {"Content-Type": kind} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def http(url: str, column: str = "value", most: int = 500, **headers: str) -> Callable[[DataFrame, int], None]:
    """POSTs lines; a 2xx takes the whole request."""

    def send(df: DataFrame, batch: int) -> None:
        def partition(rows: Iterator[Row]) -> None:
            for n, part in enumerate(chunks(rows, most)):
                body = "".join(r[column] + "\n" for r in part).encode()
                retried(lambda: post(url, body, headers=headers | {"X-Batch": f"{batch}-{n}"})[0])

        df.select(column).foreachPartition(partition)

    return send


def syslog_tcp(host: str, port: int, column: str = "value") -> Callable[[DataFrame, int], None]:
    """Octet-counted frames. There is no acknowledgement: a broken connection sends its chunk again."""

    def send(df: DataFrame, batch: int) -> None:
        def partition(rows: Iterator[Row]) -> None:
            for part in chunks(rows, 200):
                body = b"".join(b"%d %b" % (len(x), x) for x in (r[column].encode() for r in part))

                def once() -> int:
                    with socket.create_connection((host, port), timeout=30) as s:
                        s.sendall(body)
                    return 200

                retried(once)

        df.select(column).foreachPartition(partition)

    return send


def bulk(url: str, column: str = "value", most: int = 500, on_reject: Callable[[str, object], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Bulk upserts by event id: documents that come back with 429 or 5xx are sent again, others are rejected for good;
    a request that is too large is sent in halves."""

    def send(df: DataFrame, batch: int) -> None:
        def deliver(part: list[str], tries: int = 5) -> list[tuple[str, object]]:
            if not part:
                return []
            status, answer = post(url, "".join(part).encode())
            if status == 413 and len(part) > 1:
                return deliver(part[: len(part) // 2], tries) + deliver(part[len(part) // 2 :], tries)
            if status == 429 or status >= 500:
                if not tries:
                    raise Rejected(status)
                time.sleep(0.1)
                return deliver(part, tries - 1)
            if status >= 300:
                raise Rejected(status)
            items = [next(iter(i.values())) for i in json.loads(answer)["items"]]
            again = [p for p, i in zip(part, items, strict=True) if i["status"] == 429 or i["status"] >= 500]
            refused = [(p, i.get("error")) for p, i in zip(part, items, strict=True) if 300 <= i["status"] < 500 and i["status"] != 429]
            if again and not tries:
                raise Rejected("documents stay refused")
            return refused + (deliver(again, tries - 1) if again else [])

        def partition(rows: Iterator[Row]) -> None:
            for part in chunks(rows, most):
                for document, why in deliver([r[column] for r in part]):
                    if on_reject:
                        on_reject(document, why)

        df.select(column).foreachPartition(partition)

    return send
