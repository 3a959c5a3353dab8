"""Request and reply streaming: an HTTP server as a source, and a sink that answers.

The source's server runs beside the driver. Every request is an offset: a micro-batch holds the requests
since the last one, a batch that is run again gets the same ones, and a commit drops those before it. The
caller's connection stays open until a reply comes. Rows carry the address of the server that holds the
connection, so any task of any executor can answer it, and several servers (``start`` with other ports)
can feed one job by union.
"""

from __future__ import annotations

import http.client
import json
import threading
import time
import uuid
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from stagekit.sources.http import RESPONSE, make_response

SCHEMA = "id string, origin string, method string, url string, headers map<string,string>, body binary"
REPLY = "/__reply__/"


class RequestServer:
    """Requests in the order they came, by number, and the connections that wait."""

    def __init__(self, host: str = "localhost", port: int = 8888, path: str = "/", attempts: int = 10, timeout: float = 60.0):
        self.lock, self.rows, self.first = threading.Lock(), [], 0
        self.waiting: dict[str, list] = {}
        self.timeout, self.path = timeout, path
        server = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *_) -> None:
                pass

            def answer(self, code: int, headers: dict, body: bytes) -> None:
                self.send_response(code)
                for k, v in headers.items():
                    if k.lower() not in ("content-length", "transfer-encoding", "connection"):
                        self.send_header(k, v)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:  # noqa: N802
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.path.startswith(REPLY):
                    found = server.reply(self.path[len(REPLY) :], json.loads(body))
                    self.answer(200 if found else 404, {}, b"")
                elif not self.path.startswith(server.path):
                    self.answer(404, {}, b"")
                else:
                    self.answer(*server.take(self.command, self.path, dict(self.headers.items()), body))

            do_POST = do_PUT = do_DELETE = do_GET  # noqa: N815

        for i in range(attempts):
            try:
                self.http = ThreadingHTTPServer((host, port + i if port else 0), Handler)
                break
            except OSError:
                if i == attempts - 1:
                    raise
        self.http.daemon_threads = True
        self.origin = f"http://{host}:{self.http.server_address[1]}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def take(self, method: str, url: str, headers: dict, body: bytes) -> tuple[int, dict, bytes]:
        """Queues a request and waits for its reply; 504 without one."""
        name = uuid.uuid4().hex
        event: list = [threading.Event(), None]
        with self.lock:
            self.waiting[name] = event
            self.rows.append((name, self.origin, method, url, headers, body))
        event[0].wait(self.timeout)
        with self.lock:
            self.waiting.pop(name, None)
        return event[1] or (504, {}, b"")

    def reply(self, name: str, said: dict) -> bool:
        with self.lock:
            event = self.waiting.get(name)
        if event is None:
            return False
        event[1] = (said["code"], said["headers"], bytes.fromhex(said["body"]))
        event[0].set()
        return True

    def end(self) -> int:
        with self.lock:
            return self.first + len(self.rows)

    def between(self, start: int, end: int) -> list[tuple]:
        with self.lock:
            return self.rows[max(0, start - self.first) : max(0, end - self.first)]

    def forget(self, end: int) -> None:
        """Requests before ``end`` will not be asked for again."""
        with self.lock:
            gone = max(0, min(end - self.first, len(self.rows)))
            del self.rows[:gone]
            self.first += gone

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()


_servers: dict[tuple, RequestServer] = {}


class _Reader(SimpleDataSourceStreamReader):
    """Goes from process to process, so it names its server, which the one that reads starts."""

    def __init__(self, options: dict):
        self.key = (options.get("host", "localhost"), int(options.get("port", 8888)), options.get("path", "/"))
        self.more = (int(options.get("maxPortAttempts", 10)), float(options.get("replyTimeout", 60)))

    @property
    def server(self) -> RequestServer:
        if self.key not in _servers:
            _servers[self.key] = RequestServer(*self.key, *self.more)
        return _servers[self.key]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max(start["next"], self.server.end())
        return iter(self.server.between(start["next"], end)), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self.server.between(start["next"], end["next"]))

    def commit(self, end: dict) -> None:
        self.server.forget(end["next"])


class ServingSource(DataSource):
    """``spark.readStream.format("stagekit_server")`` with host, port, path, maxPortAttempts, replyTimeout."""

    @classmethod
    def name(cls) -> str:
        return "stagekit_server"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


def start(spark: SparkSession, host: str = "localhost", port: int = 8888, path: str = "/", **options) -> DataFrame:
    """A stream of requests: id, origin, method, url, headers, body."""
    spark.dataSource.register(ServingSource)
    reader = spark.readStream.format("stagekit_server").option("host", host).option("port", str(port)).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def parse_request(df: DataFrame, schema: str | T.StructType, check: str = "none") -> DataFrame:
    """The JSON of the body as columns beside ``id`` and ``origin``.

    ``none`` gives nulls for what cannot be read, ``full`` answers 400 to such requests and leaves them
    out, ``partial`` only to bodies of which nothing can be read.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if check not in ("none", "full", "partial"):
        raise ValueError(f"unknown check {check}")
    wide = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(F.decode("body", "UTF-8"), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = df.select("id", "origin", parsed.alias("parsed"))
    if check == "partial":
        empty = F.lit(True)
        for f in kind.fields:
            empty = empty & F.col("parsed")[f.name].isNull()
        bad = F.col("parsed").isNull() | empty
    else:
        bad = F.col("parsed").isNull() | F.col("parsed")["_corrupt_record"].isNotNull()
    if check != "none":
        refused = F.struct("id", "origin", F.lit(400).alias("code"))
        out = out.withColumn("bad", F.when(bad, refused))

        def refuse(batches):
            for batch in batches:
                for r in batch.column(batch.schema.get_field_index("bad")).to_pylist():
                    if r is not None:
                        send_reply(r["origin"], r["id"], r["code"], {}, b"the body cannot be read")
                keep = pa.array([r is None for r in batch.column(batch.schema.get_field_index("bad")).to_pylist()])
                yield batch.filter(keep)

        out = out.mapInArrow(refuse, out.schema).drop("bad")
    return out.select("id", "origin", *[F.col("parsed")[f.name].alias(f.name) for f in kind.fields])


def make_reply(df: DataFrame, value_col: str, reply_col: str = "reply", code: int = 200) -> DataFrame:
    """A response made of the value by its type, see ``sources.http.make_response``."""
    return df.withColumn(reply_col, make_response(F.col(f"`{value_col}`"), df.schema[value_col].dataType, code))


def send_reply(origin: str, name: str, code: int, headers: dict, body: bytes, tries: int = 3) -> bool:
    """Hands a reply to the server that holds the connection; False if it holds it no longer."""
    place = urlsplit(origin)
    for i in range(tries):
        try:
            link = http.client.HTTPConnection(place.hostname, place.port, timeout=30)
            link.request("POST", REPLY + name, json.dumps({"code": code, "headers": headers, "body": body.hex()}))
            done = link.getresponse().status == 200
            link.close()
            return done
        except OSError:
            time.sleep(0.1 * (i + 1))
    return False


def send_replies(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Answers every row's request from the tasks; one row (sent, late) a batch of rows."""

    def run(batches):
        for batch in batches:
            names, origins, replies = (batch.column(i).to_pylist() for i in range(3))
            done = [send_reply(o, n, r["code"], dict(r["headers"] or []), r["body"] or b"") for n, o, r in zip(names, origins, replies) if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([sum(done)], pa.int64()), pa.array([len(done) - sum(done)], pa.int64())], names=["sent", "late"])

    return df.select("id", "origin", F.col(f"`{reply_col}`").cast(RESPONSE).alias("reply")).mapInArrow(run, "sent long, late long")


def reply_to(df: DataFrame, checkpoint: str, reply_col: str = "reply", name: str | None = None, interval: str = "0 seconds"):
    """Runs the stream and answers each request with its reply; the query.

    A batch that is run again answers again; connections that were answered already do not mind.
    """

    def answer(batch: DataFrame, _: int) -> None:
        send_replies(batch, reply_col).agg(F.sum("sent")).collect()

    writer = df.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(processingTime=interval)
    return (writer.queryName(name) if name else writer).start()
