"""Mail-filter sessions as a keyed stateful stream.

Rows are packets (conn_id, seq, cmd, payload); replies are (conn_id, seq, action, payload).  State is
one message per connection, bounded by the size limit, and times out when a connection goes quiet.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.engine import Engine
from ..functions.mime import clean_message_fail_open, header_block, safe_value

ADD_HEADERS, CHANGE_BODY, CHUNK, VERSION, MAX_PACKET = 0x01, 0x02, 60_000, 6, 256 << 20
OUTPUT = "conn_id string, seq long, action string, payload binary"


class Session:
    """What one connection has sent of its message, and the replies to a packet."""

    def __init__(self, limit: int):
        self.limit, self.actions = limit, ADD_HEADERS | CHANGE_BODY
        self.reset()

    def reset(self) -> None:
        self.headers: list[tuple[bytes, bytes]] = []
        self.body, self.size, self.over = bytearray(), 0, False

    def feed(self, cmd: str, payload: bytes, engine: Engine) -> list[tuple[str, bytes]]:
        if cmd == "O":
            if len(payload) >= 8:
                self.actions = struct.unpack(">I", payload[4:8])[0] & (ADD_HEADERS | CHANGE_BODY)
            return [("O", struct.pack(">III", VERSION, self.actions, 0))]
        if cmd == "L":
            name, _, value = payload.partition(b"\0")
            name = bytes(b for b in name if b > 32 and b not in (58, 127))
            if name:
                self.headers.append((name, safe_value(value.rstrip(b"\0").decode("latin-1")).encode("latin-1")))
                self._grow(len(name) + len(value))
        elif cmd == "B":
            self._grow(len(payload))
            if not self.over:
                self.body += payload
        elif cmd in ("M", "A"):
            self.reset()
        elif cmd == "E":
            out = self.end(engine)
            self.reset()
            return out
        return [] if cmd in ("D", "A", "Q") else [("c", b"")]

    def _grow(self, n: int) -> None:
        self.size += n
        if self.size > self.limit:
            self.over, self.body = True, bytearray()

    def end(self, engine: Engine) -> list[tuple[str, bytes]]:
        if self.over:
            return [("t", b"")]
        raw = b"".join(k + b": " + v + b"\r\n" for k, v in self.headers) + b"\r\n" + bytes(self.body)
        done = clean_message_fail_open(raw, engine)
        if done.modified and not self.actions & CHANGE_BODY:
            return [("t", b"")]
        out = []
        if done.modified:
            body = done.cleaned[header_block(done.cleaned, 0, len(done.cleaned))[1] :]
            out += [("b", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
        if self.actions & ADD_HEADERS:
            out += [("h", k.encode() + b"\0" + v.encode() + b"\0") for k, v in done.headers]
        return [*out, ("c", b"")]


def frames(raw: bytes, limit: int = MAX_PACKET) -> list[tuple[str, bytes]]:
    """(command, payload) of every packet of a connection's bytes: a length of four bytes, a command and its payload.

    A packet without a command or above ``limit`` ends the connection: it becomes a quit, and so does one that is cut short.
    """
    out, at = [], 0
    while at + 4 <= len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        if not 0 < n <= limit or at + 4 + n > len(raw):
            return [*out, ("Q", b"")]
        out.append((chr(raw[at + 4]), raw[at + 5 : at + 4 + n]))
        at += 4 + n
    return out


def framed(action: str, payload: bytes) -> bytes:
    """A reply as it goes back over the connection."""
    return (len(payload) + 1).to_bytes(4, "big") + action.encode("latin-1") + payload


def read_packets(spark: SparkSession, path: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """Packets (conn_id, seq, cmd, payload) from a folder with a file of bytes for each connection, as a table or as a stream of files as they come."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                every = frames(raw or b"")
                yield pa.RecordBatch.from_pydict({"conn_id": pa.array([name] * len(every), pa.string()), "seq": pa.array(range(len(every)), pa.int64()), "cmd": pa.array([c for c, _ in every], pa.string()), "payload": pa.array([p for _, p in every], pa.binary())})

    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("conn_id"), "content").mapInArrow(run, "conn_id string, seq long, cmd string, payload binary")


def replies(packets: DataFrame, engine: Engine, quiet_ms: int = 3_600_000) -> DataFrame:
    """The replies of every session of a stream of packets."""
    limit = engine.config.max_message_size

    def handle(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = pickle.loads(state.get[0]) if state.exists else Session(limit)
        rows = sorted((r for f in frames for r in zip(f["seq"], f["cmd"], f["payload"])), key=lambda r: r[0])
        out, quit_ = [], False
        for seq, cmd, payload in rows:
            out += [(key[0], seq, a, p) for a, p in session.feed(cmd, bytes(payload or b""), engine)]
            quit_ = cmd == "Q"
        if quit_:
            state.remove()
        else:
            state.update((pickle.dumps(session),))
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=["conn_id", "seq", "action", "payload"])

    return packets.groupBy("conn_id").applyInPandasWithState(handle, OUTPUT, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
