"""Requests to a remote page analyser and its answers.

Requests are columns: the address and the multipart body are expressions, so they
can be looked at, written or repeated like any data. Only `posted` talks to the
network, an Arrow batch at a time, one opener a task; an answer that fails is a row
with its error, not a lost job.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.functions.workers import per_worker, ship
from pagelayout.sources.analyser import content_type

#: Separates the parts of a body; it must not occur in an image.
BOUNDARY = "pagelayout-7f1c2e9a5b3d"


def address(server: str, path: str, **parameters: Column) -> Column:
    """The endpoint with its parameters, form-encoded, in the order given; those that are null or empty texts are left out."""
    pairs = [F.when(F.length(p.cast("string")) > 0, F.concat(F.lit(f"{k}="), F.url_encode(p.cast("string")))) for k, p in parameters.items()]
    end = server.rstrip("/") + path
    return F.concat(F.lit(end + "?"), F.concat_ws("&", *pairs)) if pairs else F.lit(end)


def flag(on: Column) -> Column:
    return F.when(on, "true").otherwise("false")


def page_address(server: str, page_width: Column, zoom: Column, lang: Column, binary: Column, toc: Column) -> Column:
    """A4, A5: the address that analyses one page; `lang` may be null."""
    return address(server, "/page", page_width=page_width, zoom_factor=zoom, bin=flag(binary), toc_algorithm=toc, lang=lang)


def ocr_address(server: str, no_formulas: Column, cache_key: Column) -> Column:
    """The address that answers with a page's HTML. An empty cache key is sent as such."""
    key = F.coalesce(F.url_encode(cache_key), F.lit(""))
    return F.concat(address(server, "/ocr_page", no_pix2tex=flag(no_formulas)), F.lit("&cache_key="), key)


def stream_address(server: str) -> Column:
    """The address that starts a page and answers with where to watch it."""
    return address(server, "/ocr_page_stream")


def multipart(image: Column, filename: Column, boundary: str = BOUNDARY) -> Column:
    """The body of a form with the one field `image`, as bytes."""
    head = F.concat(F.lit(f'--{boundary}\r\nContent-Disposition: form-data; name="image"; filename="'), filename, F.lit('"\r\nContent-Type: '), content_type(filename), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), image.cast("binary"), F.encode(F.lit(f"\r\n--{boundary}--\r\n"), "UTF-8"))


def _open(timeout: float, boundary: str) -> Callable[[str, bytes], str]:
    def send(url: str, body: bytes) -> str:
        request = urllib.request.Request(url, data=body, method="POST", headers={"Content-Type": f"multipart/form-data; boundary={boundary}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode("utf-8")

    return send


def posted(requests: DataFrame, url: str = "url", body: str = "request", timeout: float = 120, boundary: str = BOUNDARY, connect: Callable[[], Callable[[str, bytes], str]] | None = None) -> DataFrame:
    """`requests` without the request's bytes, with `answer` (text) and `error` (null where there is an answer).

    `connect` runs once a worker and returns the call; the default posts over HTTP.
    Calls must stand being repeated, as tasks are.
    """
    ship(requests.sparkSession)
    kept = [c for c in requests.columns if c != body]
    schema = T.StructType([*(requests.schema[c] for c in kept), T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    at = {c: i for i, c in enumerate(requests.columns)}
    opened = per_worker(connect or (lambda: _open(timeout, boundary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = opened()
        for batch in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for where, sent in zip(batch.column(at[url]).to_pylist(), batch.column(at[body]).to_pylist(), strict=True):
                try:
                    answers.append(send(where, sent))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in kept), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    return requests.mapInArrow(run, schema)


def stream_tickets(answers: DataFrame, answer: str = "answer", strict: bool = False) -> DataFrame:
    """Answers with stream_url, token and `missing`: whether either is absent or empty (then both are null).

    With `strict` such an answer is an error when its row is read.
    """
    url, token = (F.get_json_object(F.col(answer), f"$.{k}") for k in ("stream_url", "token"))
    whole = F.coalesce((F.length(url) > 0) & (F.length(token) > 0), F.lit(False))
    if strict:
        fail = F.raise_error(F.concat(F.lit("answer without stream_url or token: "), F.coalesce(F.col(answer), F.lit("none"))))
        url, token = (F.when(whole, x).otherwise(fail.cast("string")) for x in (url, token))
    return answers.withColumns({"stream_url": F.when(whole, url) if not strict else url, "token": F.when(whole, token) if not strict else token, "missing": ~whole})
