"""WARC archives of pages, and a globally ordered index of captures.

Archives are written by Spark's text writer: a row is a record's headers and block, and the
line separator is the blank pair of lines that ends a record. So they go to any store that
Spark writes to, and a lost task is written again. Reading takes the files' bytes and follows
each record's Content-Length.

The index is an external merge: every archive that is read gives a locally sorted run of
captures, ranges of (URL key, time, record) are dealt to tasks, and each task merges the runs'
shares with a loser tree. Over the tasks in order the captures of each URL follow in time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonefold.llm.common import unused, written

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_END = "\r\n\r\n"
#: The digits of RFC 4648's base 32, beside those of Spark's conv.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
FIRST_DATE = "2024-01-01 00:00:00"

INDEX = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("url_key", T.StringType()), T.StructField("captured", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("file", T.StringType()), T.StructField("place", T.LongType()), T.StructField("payload", T.StringType()),
])


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: five bytes at a time are eight digits."""
    digest = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of the records with one payload of at least least_bytes bytes, that with the largest page_id is
    the response and the others revisit it; shorter ones are responses. A null payload is empty; of
    rows that share the largest page_id each is a response, and so is a row without an id.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": sha1_base32(body.cast("binary"))})
    same, last = ["payload_digest", "payload_bytes"], unused(pages, "_last")
    shared = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.max(page_id).alias(last), F.count(F.lit(1)).alias(f"{last}_n"))
    rows = rows.join(shared.filter(F.col(f"{last}_n") > 1).drop(f"{last}_n"), same, "left")
    again = F.col(page_id) < F.col(last)
    return rows.withColumns({"record_type": F.when(again, F.lit("revisit")).otherwise(F.lit("response")), "refers_to": F.when(again, F.col(last))}).drop(last)


def record(page_id: str, url: str, payload: str) -> Column:
    """A record's text up to its end mark. A revisit's block is its HTTP header alone."""
    clean = F.regexp_replace(F.col(url), r"[\r\n]", " ")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.expr(f"timestamp '{FIRST_DATE}'") + F.make_dt_interval(secs=F.coalesce(F.col(page_id), F.lit(0)) % 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(F.lit(HTTP), F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.coalesce(F.col(payload), F.lit(""))))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col(page_id))), line("WARC-Target-URI", clean), line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("X-Payload-Length", F.col("payload_bytes")),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", most_records: int = 2000) -> None:
    """Gzipped archives under path, each of at most most_records records. A null URL leaves its header out."""
    rows = with_revisits(pages, page_id, payload)
    value = rows.select(record(page_id, url, payload).alias("value"))
    value.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", most_records).text(path)


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query: keys of a site lie together."""
    found = re.match(r"[^:/?#]+://([^/?#]*)([^#]*)", url or "")
    if not found:
        return (url or "").lower()
    host, rest = found[1].lower(), found[2] or "/"
    return ",".join(reversed(host.split("."))) + ")" + rest


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def run_of(file: str, content: bytes, with_payload: bool) -> list[tuple]:
    """One archive's captures as rows of INDEX, sorted. Length and digest are those of the payload that was read, or what a revisit names."""
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    out = []
    for place, (h, block) in enumerate(records(gzip.GzipFile(fileobj=io.BytesIO(content)))):
        payload, body = block.partition(b"\r\n\r\n")[2], None
        if h["warc-type"] == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            body = payload.decode("utf-8", "replace") if with_payload else None
            if (size, f"sha1:{digest}") != (int(h["x-payload-length"]), h["warc-payload-digest"]):
                raise ValueError(f"record {place} of {file} does not hold the payload that its header names")
        else:
            size, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
        url = h.get("warc-target-uri")
        out.append((number(h["warc-record-id"]), url, url_key(url), h["warc-date"], h["warc-type"], size, digest, number(h.get("warc-refers-to")), file, place, body))
    return sorted(out, key=capture_key)


def capture_key(row: tuple) -> tuple:
    return row[2], row[3], -1 if row[0] is None else row[0], row[8], row[9]


def read_runs(df: DataFrame, with_payload: bool = False) -> DataFrame:
    """The captures of the archives of df (binaryFile), a sorted run for each file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in INDEX])
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                if run := run_of(file.as_py(), content.as_py(), with_payload):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*run), kind.types)], schema=kind)

    return df.select("path", "content").mapInArrow(read, INDEX)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root's winner comes next."""

    def __init__(self, runs: list[list], key) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.keys = [self.head(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self.replay(i, filling=True)

    def head(self, i: int):
        return (0, self.key(self.runs[i][self.at[i]])) if self.at[i] < len(self.runs[i]) else (1,)

    def replay(self, i: int, filling: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if filling and other < 0:
                self.losers[node] = i
                return
            if self.keys[other] < self.keys[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k:
            i = self.losers[0]
            if self.at[i] >= len(self.runs[i]):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.keys[i] = self.head(i)
            self.replay(i)


def ascending_runs(rows: list[tuple], key) -> list[list]:
    """Cuts rows where they descend: each part is sorted."""
    out: list[list] = []
    last = None
    for row in rows:
        k = key(row)
        if last is None or k < last:
            out.append([])
        out[-1].append(row)
        last = k
    return out


def resolved(runs: DataFrame) -> DataFrame:
    """runs whose revisits have length and digest from the response that they refer to: null where it isn't there, or has another payload."""
    named, found = ["refers_to", "payload_bytes", "payload_digest"], ["page_id", "payload_bytes", "payload_digest"]
    responses = runs.filter("record_type = 'response'").select(*[F.col(a).alias(b) for a, b in zip(found, named)]).distinct().withColumn("here", F.lit(True))
    both = runs.join(responses, named, "left")
    known = (F.col("record_type") == "response") | F.col("here")
    return both.withColumns({c: F.when(known, F.col(c)) for c in named[1:]}).select(*runs.columns)


#: Captures that a task of the merge holds, about.
RANGE_ROWS = 200_000


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in the order of (url_key, captured, page_id), partition after partition.

    A task holds its range of the index, of which there are as many as range_rows asks for; a URL with
    very many captures spans several ranges. Null and repeated page_ids stay; no capture gives no rows.
    """
    runs = written(runs, "runs")
    ranges = -(-runs.count() // range_rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=arrow_schema)
        by_file: dict[str, list] = {}
        keys = [table[n].to_pylist() for n in ("page_id", "url_key", "captured", "file", "place")]
        for row, (page, url, at, file, place) in enumerate(zip(*keys)):
            by_file.setdefault(file, []).append(((url, at, -1 if page is None else page, file, place), row))
        parts = [x for rows in by_file.values() for x in ascending_runs(rows, lambda r: r[0])]
        order = [row for _, row in LoserTree(parts, lambda r: r[0])]
        yield from table.take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)

    fields = [f for f in INDEX if f.name in runs.columns]
    arrow_schema = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in fields])
    dealt = runs.select(*arrow_schema.names).repartitionByRange(max(1, ranges), "url_key", "captured", "page_id", "place")
    return dealt.mapInArrow(merge, T.StructType(fields))
