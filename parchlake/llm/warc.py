"""WARC archives with an externally merged capture index (operator 1).

Writing: one record per page, as Spark text files whose lines end with the record separator, so the bytes on disk
are the archive's own (gzip-compressed); an archive has at most ``RECORDS_PER_FILE`` records, fewer where the longest payload
times their number would be over ``BYTES_PER_FILE``. Of pages with equal payloads the one with the largest id is a `response`
that holds the payload; the others are `revisit` records that refer to it. Reading parses the archives by their
content lengths, checks payload digests, and makes of each archive a capture run sorted by (URL key, time, id).
The index merge deals all runs into ranges of these keys (sampled splitters, a bounded number of rows each) and
merges the pieces of the k runs in each range with a loser tree: partitions in order hold the global history. The
id is part of the key, so a URL with any number of captures is spread over ranges.

Cases: a null payload is empty (0 bytes); a null URL has no target and the key ``)``; repeated ids with equal
payloads that are largest are all responses; an id that is null is below all others; an empty table gives an empty
archive and result; columns other than those named are ignored. Line breaks in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_arrow, shared_dir, table

RECORDS_PER_FILE, BYTES_PER_FILE = 2000, 1 << 28
BROADCAST_ROWS = 500_000
ROWS_PER_RANGE = 50_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id long, url string, urlkey string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, run string"


def base32_of_hex(h: Column) -> Column:
    """Base32 of a digest of 40 hexadecimal digits: five digits make four characters."""
    alphabet, parts = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for k in range(8):
        v = F.conv(F.substring(h, 1 + 5 * k, 5), 16, 10).cast("int")
        parts += [F.substr(alphabet, F.shiftright(v, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None) -> str:
    """Writes the archives and returns their folder. `ts_col`: a timestamp; without it all captures share one."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    ts = F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if ts_col else F.lit("2020-01-01T00:00:00Z")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), ts.alias("ts"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"))
    # only payloads that come more than once need another row; their digests are broadcast if they are counted to be few
    again = cut(rows.groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("most")), "warc-payloads")
    most = again.agg(F.max("most").alias("m")).first()["m"] or 1
    again = again.where("n > 1").select("sha", "top", F.lit(True).alias("again"))
    rows = rows.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "sha", "left").withColumn("top", F.when(F.col("again"), F.col("top")).otherwise(F.col("id")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    revisit = ~F.col("id").eqNullSafe(F.col("top"))
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")), header("WARC-Record-ID", name(F.col("id"))), header("WARC-Date", F.col("ts")),
        F.coalesce(header("WARC-Target-URI", url), F.lit("")), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))),
        F.when(revisit, F.concat(header("WARC-Refers-To", name(F.col("top"))), header("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        header("Content-Type", F.lit("application/http;msgtype=response")), header("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string")),
        F.lit("\r\n"), http, F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, BYTES_PER_FILE // most))).text(path)
    return path


def url_key(url: str | None) -> str:
    """The sort-friendly form: host labels from the right, then path and query."""
    m = re.match(r"[^:]*://([^/?#]*)([^#]*)", url or "", re.S)
    return f"{','.join(reversed(m[1].lower().split(':')[0].split('.')))}){m[2] or '/'}" if m else f"){url or ''}"


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip-compressed archive, read as a stream."""
    f = gzip.GzipFile(fileobj=io.BytesIO(archive))
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[key] = value
        block = f.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]) or f.read(4) != END.encode():
            raise ValueError("a WARC record is cut off")
        yield headers, block


def _id(name: str | None) -> int | None:
    text = (name or "")[len("<urn:x-page:") : -1]
    return int(text) if text and text != "null" else None


def capture(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(END.encode())
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, url = headers["WARC-Type"], headers.get("WARC-Target-URI")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest")
    return _id(headers["WARC-Record-ID"]), url, url_key(url), headers["WARC-Date"], size, digest, kind, _id(headers.get("WARC-Refers-To"))


def order_of(row: tuple) -> tuple:
    return row[2], row[3], row[0] is not None, row[0] or 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; those of an archive are a run: together, and sorted by (URL key, time, id)."""
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in CAPTURE.split(", ")]

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                run = name.as_py().rpartition("/")[2]
                rows = sorted((capture(h, x) for h, x in records(content.as_buffer().to_pybytes())), key=order_of)
                if rows:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)), pa.array([run] * len(rows))], names)

    return in_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content"), fn, CAPTURE)


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of its match, so a step replays one path of log k matches."""

    def __init__(self, runs: list[list], key) -> None:  # noqa: ANN001
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.key = key
        self.heads = [key(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._less(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_index(runs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows of all runs in global order of (urlkey, ts, page_id), over as many partitions as ranges."""
    ranges = -(-runs.count() // rows_per_range) or 1
    keys = ["urlkey", "ts", F.col("page_id").asc_nulls_first()]

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[tuple]] = []
        last, schema = None, None
        for b in batches:  # one range: about rows_per_range rows
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[-1] != last:
                    last = row[-1]
                    pieces.append([])
                pieces[-1].append(row)
        if pieces:
            cols = zip(*LoserTree(pieces, order_of), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema.names)

    return in_arrow(runs.repartitionByRange(ranges, *keys).sortWithinPartitions("run", *keys), fn, runs.schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_warc(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    merged = merge_index(cut(read_runs(spark, path), "warc-runs"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM m
"""
