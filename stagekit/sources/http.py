"""HTTP as a column: requests to responses, parsers around them, and the retry rules.

A request is a struct (method, url, headers, body), a response (code, reason, headers, body); bodies are
bytes, headers a map. Tasks keep the order of their rows and have ``concurrency`` requests open at a time.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagekit.plans.session import fresh

REQUEST = "struct<method:string,url:string,headers:map<string,string>,body:binary>"
RESPONSE = "struct<code:int,reason:string,headers:map<string,string>,body:binary>"
_RESPONSE = pa.struct([("code", pa.int32()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
#: Waits before the next tries, in milliseconds.
BACKOFFS = (100, 500, 1000)
#: Answers that end the tries: others, and no answer, are tried again.
FINAL = (200, 201, 202, 204, 400, 401, 403, 404)


# Requests and responses as columns ----------------------------------------------------------------

def request(url: Column | str, body: Column | None = None, method: str = "POST", headers: dict[str, str | Column] | None = None) -> Column:
    """A request struct; a text body becomes UTF-8. Without a url the request is null."""
    url = F.lit(url) if isinstance(url, str) else url
    pairs = [v if isinstance(v, Column) else F.lit(v) for item in (headers or {}).items() for v in item]
    fields = [F.lit(method).alias("method"), url.alias("url"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("headers"),
              (F.lit(None).cast("binary") if body is None else body.cast("binary")).alias("body")]
    return F.when(url.isNotNull(), F.struct(*fields)).cast(REQUEST)


def json_request(value: Column, url: Column | str, method: str = "POST", headers: dict | None = None) -> Column:
    """A request with ``value`` as JSON in the body; null for a null value."""
    sent = request(url, F.to_json(value), method, {"Content-type": "application/json", **(headers or {})})
    return F.when(value.isNotNull(), sent)


def body_text(response: Column) -> Column:
    return F.decode(response["body"], "UTF-8")


def json_response(response: Column, schema: str | T.DataType) -> Column:
    """The body read as JSON of the given type; null where it is not."""
    return F.from_json(body_text(response), schema)


def make_response(value: Column, kind: T.DataType, code: int = 200) -> Column:
    """A response struct by the type of the value: bytes and texts as they are, others as JSON."""
    name = kind.typeName()
    if name == "binary":
        body, content = value, "application/octet-stream"
    elif name == "string":
        body, content = value.cast("binary"), "text/plain"
    else:
        text = F.to_json(value) if name in ("struct", "array", "map") else F.to_json(F.struct(value.alias("value")))
        body, content = text.cast("binary"), "application/json"
    fields = [F.lit(code).alias("code"), F.lit("OK" if code == 200 else "").alias("reason"), F.create_map(F.lit("Content-type"), F.lit(content)).alias("headers"), body.alias("body")]
    return F.struct(*fields).cast(RESPONSE)


# Clients ------------------------------------------------------------------------------------------

def send_once(row: dict, timeout: float) -> dict | None:
    """The response to one request; None without an answer in time."""
    headers = dict(row["headers"] or [])
    asked = urllib.request.Request(row["url"], data=row["body"], headers=headers, method=row["method"] or "GET")
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            return {"code": got.status, "reason": got.reason, "headers": list(got.headers.items()), "body": got.read()}
    except urllib.error.HTTPError as e:
        return {"code": e.code, "reason": str(e.reason), "headers": list(e.headers.items()), "body": e.read()}
    except (OSError, ValueError):
        return None


def basic(row: dict, timeout: float) -> dict | None:
    return send_once(row, timeout)


def advanced(row: dict, timeout: float, backoffs: tuple[int, ...] = BACKOFFS, most_waits: int = 20) -> dict | None:
    """Tries again after ``backoffs``; 429 waits as long as it says and does not use up a try, ``most_waits`` times at most."""
    got, tries, waits = None, 0, 0
    while True:
        got = send_once(row, timeout)
        if got is not None and got["code"] in FINAL:
            return got
        if got is not None and got["code"] == 429 and waits < most_waits:
            waits += 1
            said = {k.lower(): v for k, v in got["headers"]}.get("retry-after", "")
            time.sleep(float(said) if said.replace(".", "", 1).isdigit() else backoffs[0] / 1000)
            continue
        if tries >= len(backoffs):
            return got
        time.sleep(backoffs[tries] / 1000)
        tries += 1


def polling(inner: Callable = advanced, tries: int = 1000, delay: float = 0.3) -> Callable:
    """For services that answer 202 with the place of the result: asks there until the work is done."""

    def run(row: dict, timeout: float) -> dict | None:
        import json

        got = inner(row, timeout)
        if got is None or got["code"] != 202:
            return got
        place = {k.lower(): v for k, v in got["headers"]}.get("operation-location")
        kept = [(k, v) for k, v in dict(row["headers"] or []).items() if k.lower() != "content-type"]
        for _ in range(tries if place else 0):
            got = inner({"method": "GET", "url": place, "headers": kept, "body": None}, timeout)
            state = ""
            if got is not None and got["body"]:
                try:
                    state = str(json.loads(got["body"]).get("status", "")).lower()
                except (ValueError, AttributeError):
                    state = ""
            if state not in ("running", "notstarted"):
                return got
            time.sleep(delay)
        return got

    return run


def send(df: DataFrame, input_col: str, output_col: str, concurrency: int = 1, timeout: float = 60.0, handler: Callable = advanced) -> DataFrame:
    """A response for each request, in order; null for a null request and where no answer came."""

    def run(requests: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(concurrency) as pool:
            got = list(pool.map(lambda r: None if r is None else handler(r, timeout), requests.to_pylist()))
        return pa.array(got, _RESPONSE)

    return df.withColumn(output_col, F.arrow_udf(run, RESPONSE)(F.col(f"`{input_col}`")))


def call_json(
    df: DataFrame, input_cols: list[str], url: Column | str, output_col: str, schema: str | T.DataType, error_col: str = "errors", method: str = "POST", headers: dict | None = None,
    concurrency: int = 1, timeout: float = 60.0, handler: Callable = advanced, batch_size: int | None = None, pick: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The columns as JSON to ``url``, and the answer read as ``schema`` into ``output_col``.

    Answers other than 200 give a null output, and their body and status in ``error_col``. With
    ``batch_size`` rows go out as arrays and the array that comes back, of as many, is laid out again.
    ``pick`` takes the output from the parsed answer.
    """
    from stagekit.operators.columns import fixed_minibatch, flatten_batch

    sent, got = fresh([*df.columns, output_col, error_col], "request", "response")
    names = df.columns
    if batch_size:
        df = fixed_minibatch(df, batch_size).drop("batch_id")
        value = F.arrays_zip(*[F.col(f"`{c}`") for c in input_cols])
        schema = T.ArrayType(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
    else:
        value = F.struct(*[F.col(f"`{c}`") for c in input_cols])
    out = send(df.withColumn(sent, json_request(value, url, method, headers)), sent, got, concurrency, timeout, handler)
    fine = F.col(got)["code"] == 200
    parsed = json_response(F.col(got), schema)
    if batch_size:
        picked = F.transform(parsed, pick) if pick else parsed
    else:
        picked = pick(parsed) if pick else parsed
    out = out.withColumn(output_col, F.when(fine, picked))
    trouble = F.struct(body_text(F.col(got)).alias("response"), F.struct(F.col(got)["code"].alias("code"), F.col(got)["reason"].alias("reason")).alias("status"))
    out = out.withColumn(error_col, F.when(F.col(got).isNotNull() & ~fine, trouble)).drop(sent, got)
    if batch_size:
        out = flatten_batch(out, [*names, output_col])
    return out


def write_rows(df: DataFrame, url: str, batch_size: int = 10, concurrency: int = 1, timeout: float = 30.0, headers: dict | None = None, handler: Callable = advanced) -> DataFrame:
    """Rows posted to ``url`` as JSON arrays of ``batch_size``; (code, reason) of each batch."""
    from stagekit.operators.columns import fixed_minibatch

    names = df.columns
    batched = fixed_minibatch(df, batch_size)
    body = F.arrays_zip(*[F.col(f"`{c}`") for c in names])
    out = send(batched.select(json_request(body, url, "POST", headers).alias("request")), "request", "response", concurrency, timeout, handler)
    return out.select(F.col("response")["code"].alias("code"), F.col("response")["reason"].alias("reason"))


def stream_rows(df: DataFrame, url: str, checkpoint: str, **options):
    """A stream's rows posted batch by batch; the query."""

    def post(rows: DataFrame, _: int) -> None:
        bad = write_rows(rows, url, **options).where("code IS NULL OR code >= 300").count()
        if bad:
            raise OSError(f"{bad} batches were not taken")

    return df.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint).start()
