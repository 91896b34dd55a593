"""Events over UDP: a sender, a receiver that collects what comes in a window of wall time, and a streaming source.

    spark.dataSource.register(UdpEvents)
    live = spark.readStream.format("udp-events").option("port", 3333).load()
"""

from __future__ import annotations

import socket
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..schema import EVENT_SCHEMA
from ..stream import EventStream
from . import codecs
from .files import by_ranges, from_numpy


class UdpSender:
    def __init__(self, host: str, port: int, *, timestamps: bool = False) -> None:
        self.address, self.timestamps = (host, port), timestamps
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)

    def send(self, s: EventStream) -> int:
        """Send a window's events in order; returns the number of datagrams.  The driver has a stretch of them at a time."""
        n = 0
        for x, y, t, p in by_ranges(s.df.select("x", "y", "t", "p", "seq").orderBy("seq").select("x", "y", "t", "p")):
            for packet in codecs.encode_udp(x, y, p, t if self.timestamps else None):
                self.socket.sendto(packet, self.address)
                n += 1
        return n


class UdpReceiver:
    def __init__(self, spark: SparkSession, host: str, port: int, sensor_size: tuple[int, int]) -> None:
        self.spark, self.sensor_size = spark, sensor_size
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((host, port))

    @property
    def address(self) -> tuple[str, int]:
        return self.socket.getsockname()

    def recv(self, dt_ms: float = 30.0) -> EventStream:
        """The events of the next ``dt_ms``; those without a time get that of their arrival."""
        begun, rows = time.monotonic(), []
        while (left := dt_ms / 1000 - (time.monotonic() - begun)) > 0:
            self.socket.settimeout(left)
            try:
                x, y, p, t = codecs.decode_udp(self.socket.recv(65535))
            except TimeoutError:
                break
            now = int((time.monotonic() - begun) * 1e6)
            rows.append(np.column_stack([x, y, np.full(len(x), now) if t is None else t[: len(x)], p]))
        return from_numpy(self.spark, np.concatenate(rows) if rows else np.zeros((0, 4)), sensor_size=self.sensor_size)


class UdpEventsReader(SimpleDataSourceStreamReader):
    """What arrives at a port, numbered; events stay in memory until their batch is committed, as a datagram comes once."""

    def __init__(self, options: dict) -> None:
        self.address = options.get("host", "127.0.0.1"), int(options["port"])
        self.wait, self.most = float(options.get("wait_ms", 50)) / 1000, int(options.get("max_events", 500_000))
        self.socket: socket.socket | None = None
        self.held: list[tuple] = []
        self.begun = 0.0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.begun = time.monotonic()
        rows, n, until = [], start["n"], time.monotonic() + self.wait
        while (left := until - time.monotonic()) > 0 and len(rows) < self.most:
            self.socket.settimeout(left)
            try:
                x, y, p, t = codecs.decode_udp(self.socket.recv(65535))
            except TimeoutError:
                break
            if t is None:
                t = np.full(len(x), int((time.monotonic() - self.begun) * 1e6))
            for row in zip(x.tolist(), y.tolist(), t.tolist(), p.tolist()):
                rows.append((*row, n))
                n += 1
        self.held += rows
        return iter(rows), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for r in self.held if start["n"] <= r[4] < end["n"]])

    def commit(self, end: dict) -> None:
        self.held = [r for r in self.held if r[4] >= end["n"]]


class UdpEvents(DataSource):
    """Options: ``port``, ``host``, ``wait_ms`` of a batch, ``max_events`` of a batch or so (what comes faster waits in the socket)."""

    @classmethod
    def name(cls) -> str:
        return "udp-events"

    def schema(self) -> StructType:
        return EVENT_SCHEMA

    def simpleStreamReader(self, schema: StructType) -> UdpEventsReader:
        return UdpEventsReader(dict(self.options))
