"""Datagrams and connections as a streaming source: a Python data source that listens on a port.

    spark.dataSource.register(network.Listener)
    spark.readStream.format("siltline-listen").option("protocol", "tcp").option("port", 5514).load()

The listener runs on the driver and keeps what it received until a micro-batch is committed; a receiver that must survive
the driver belongs in front of a drop folder (``frames.files``). At ``maxFrames`` held frames it stops reading, which TCP
senders feel as back-pressure; datagrams are then lost, and counted.
"""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from siltline.sources import frames

SCHEMA = "peer string, received_ms long, raw binary, method string, truncation_status string, confidence string"


class Inbox:
    """Received frames by number, and the threads that fill it."""

    def __init__(self, protocol: str, host: str, port: int, most: int, method: str, connections: int, idle_s: float):
        self.rows: dict[int, tuple] = {}
        self.next, self.most, self.method, self.lost, self.idle_s = 0, most, method, 0, idle_s
        self.lock, self.open = threading.Lock(), threading.Semaphore(connections)
        kind = socket.SOCK_STREAM if protocol == "tcp" else socket.SOCK_DGRAM
        self.socket = socket.socket(socket.AF_INET, kind)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        self.port = self.socket.getsockname()[1]
        if protocol == "tcp":
            self.socket.listen(128)
        threading.Thread(target=self.accept if protocol == "tcp" else self.receive, daemon=True).start()

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def put(self, peer: str, found: Iterator[dict]) -> None:
        with self.lock:
            for f in found:
                about = f["framing"]
                self.rows[self.next] = (peer, int(time.time() * 1000), f["raw"], about["method"], about["truncation_status"], about["confidence"])
                self.next += 1

    def receive(self) -> None:
        while True:
            data, peer = self.socket.recvfrom(1 << 16)
            if self.full():
                self.lost += 1
            else:
                self.put(f"{peer[0]}:{peer[1]}", frames.datagram(data))

    def accept(self) -> None:
        while True:
            connection, peer = self.socket.accept()
            if self.open.acquire(blocking=False):
                threading.Thread(target=self.serve, args=(connection, f"{peer[0]}:{peer[1]}"), daemon=True).start()
            else:
                connection.close()

    def serve(self, connection: socket.socket, peer: str) -> None:
        held = b""
        connection.settimeout(self.idle_s)
        try:
            with connection:
                while True:
                    while self.full():
                        time.sleep(0.01)
                    part = connection.recv(1 << 16)
                    if not part:
                        break
                    held += part
                    cut = held.rfind(b"\n") + 1 if self.method == "newline" else self.counted(held)
                    if cut or len(held) > 4 * frames.MOST_BYTES:
                        cut = cut or len(held)
                        self.put(peer, frames.METHODS[self.method](held[:cut]))
                        held = held[cut:]
        except OSError:
            pass
        finally:
            if held:
                self.put(peer, frames.METHODS[self.method](held))
            self.open.release()

    @staticmethod
    def counted(held: bytes) -> int:
        """Where the last whole frame ends."""
        at = 0
        while m := frames.COUNT.match(held, at):
            if m.end() + int(m[1]) > len(held):
                break
            at = m.end() + int(m[1])
        return at


_inboxes: dict[tuple, Inbox] = {}


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        key = (options.get("protocol", "tcp"), options.get("host", "127.0.0.1"), int(options["port"]))
        if key not in _inboxes:
            _inboxes[key] = Inbox(*key, int(options.get("maxframes", 100_000)), options.get("framing", "newline"), int(options.get("maxconnections", 64)), float(options.get("idleseconds", 60)))
        self.inbox = _inboxes[key]

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        with self.inbox.lock:
            stop = self.inbox.next
            return iter([self.inbox.rows[n] for n in range(start["next"], stop) if n in self.inbox.rows]), {"next": stop}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with self.inbox.lock:
            return iter([self.inbox.rows[n] for n in range(start["next"], end["next"]) if n in self.inbox.rows])

    def commit(self, end: dict) -> None:
        with self.inbox.lock:
            for n in [n for n in self.inbox.rows if n < end["next"]]:
                del self.inbox.rows[n]


class Listener(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltline-listen"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> Reader:
        return Reader(self.options)



