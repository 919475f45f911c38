"""WARC archives and their index, merged externally.

Writing: a payload that stands in several records, of MIN_REVISIT bytes or more, is stored once, in the record with the
largest key; the others are revisit records that refer to it. Records are composed by Spark and written by its text
writer with the record separator CRLF CRLF, so archives go to whatever file system Spark writes to. Records are written
by classes of size (CLASSES), so that a file holds some 128 MB of payloads, or one payload of more than 4 MB.

Reading: each archive is read in one piece and parsed by the records' lengths. Payload digests are computed anew and
must agree with the headers'.

Index: the captures of an archive are a run, sorted by url key (the host's labels from the last to the first, then the
rest), time and key. The runs are written, cut at common bounds (by range, so that no range holds many more than
MERGE_ROWS captures, however often a url was captured), and merged range by range with a k-way tree of losers; in
range order that is the global order of all capture histories.

Rows: a null payload counts as empty; empty payloads and payloads under MIN_REVISIT bytes are always responses; rows
that repeat the largest key of a payload are all responses; a null key is written and read back as null, and is never
the one referred to unless all keys are null (then all are responses); a null url has an empty url key; payloads of any
length are whole; any long is a key; a line break in a url is written as %0D or %0A, and the url as it was in a header
of its own; an empty table gives no archives and an empty index; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, shared_path, table, written

MIN_REVISIT = 1000
#: Bytes from which a payload belongs to a class, and the records of a file of that class.
CLASSES = ((0, 2048), (1 << 16, 32), (1 << 22, 1))
#: Captures of a merged range, about.
MERGE_ROWS = 50_000
#: Payloads that recur, up to which their list is broadcast: 30 MB.
LIST_ROWS = 300_000
CRLF = "\r\n"
#: The time of captures that come without one.
EPOCH = "2024-01-01T00:00:00Z"
#: The header of a url that cannot stand in a header as it is.
OWN_URI = "X-Percent-Encoded-URI"
CAPTURE = "urlkey string, timestamp string, key bigint, url string, kind string, refers_to bigint, payload_bytes bigint, digest string, file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """`com,example,www)/path?query`; upper-case letters A-Z count as lower-case."""
    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, rest = F.regexp_extract(low, r"(?s)^.*?://([^/?#]*)", 1), F.regexp_replace(low, r"(?s)^.*?://[^/?#]*", "")
    return F.when(host == "", low).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def planned(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """pages with payload_bytes, digest, kind and refers_to."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    sized = pages.withColumns({"_bytes": F.octet_length(body).cast("bigint"), "_digest": F.sha1(body)})
    large = F.col("_bytes") >= MIN_REVISIT
    last = sized.where(large).groupBy("_digest", "_bytes").agg(F.max(key).alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    last = written(last.select(F.concat_ws("-", "_digest", "_bytes").alias("_on"), "_last", "_n"), "payloads")
    # Payloads that can have no partner meet nothing, and not each other either.
    on = F.when(large, F.concat_ws("-", "_digest", "_bytes")).otherwise(F.hex(F.xxhash64(key)))
    both = keyed_join(sized.withColumn("_on", on), last, ["_on"], LIST_ROWS, "left", n="_n").drop("_on")
    revisit = F.col("_last").isNotNull() & ~F.col(key).eqNullSafe(F.col("_last"))
    return both.withColumns({"_kind": F.when(revisit, "revisit").otherwise("response"), "_refers": F.when(revisit, F.col("_last"))}).drop("_last")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None) -> None:
    """Archives of pages in folders of path. date: a column with the captures' times, in UTC."""
    time = F.lit(None).cast("timestamp") if date is None else F.col(date).cast("timestamp")
    pages = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"), time.alias("time"))
    df = planned(pages, "key", "payload")
    line = lambda head, v: F.when(v.isNotNull(), F.concat(F.lit(f"{head}: "), v, F.lit(CRLF))).otherwise(F.lit(""))
    name = lambda k: F.concat(F.lit("<urn:page:"), k.cast("string"), F.lit(">"))
    unnamed = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(" ", "url", "_digest")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    stamp = F.coalesce(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(EPOCH))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(F.col("_kind") == "response", F.coalesce(F.col("payload").cast("string"), F.lit(""))).otherwise(F.lit(""))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("_kind"), F.lit(CRLF), line("WARC-Record-ID", F.coalesce(name(F.col("key")), unnamed)), line("WARC-Target-URI", uri), line(OWN_URI, F.when(uri != F.col("url"), F.url_encode("url"))),
        F.lit("WARC-Date: "), stamp, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}"),
        line("WARC-Refers-To", name(F.col("_refers"))), F.when(F.col("_kind") == "revisit", f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}").otherwise(""),
        F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(CRLF * 2),
    )
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    bounds = [*(low for low, _ in CLASSES), None]
    within = [(size >= low) & (F.lit(True) if high is None else size < high) for low, high in zip(bounds, bounds[1:], strict=False)]
    count = pages.agg(*[F.count(F.when(w, 1)) for w in within]).first()
    for i, (_, records) in enumerate(CLASSES):
        if count[i] or not i:  # the first one leaves a folder to read, even if it's empty
            df.where(within[i]).select(F.concat(head, http, body).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(f"{path}/class={i}")


def parse(data: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, headers and block of each record of an archive."""
    at, n = 0, len(data)
    raw = data.obj if isinstance(data.obj, bytes) else bytes(data)
    while at < n:
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        heads = dict(x.split(": ", 1) for x in lines[1:])
        block, size = end + 4, int(heads["Content-Length"])
        if raw[block + size : block + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, block + size + 4 - at, heads, data[block : block + size]
        at = block + size + 4


def _number(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def _captures(file: str, data: bytes) -> list[tuple]:
    out = []
    for offset, length, heads, block in parse(memoryview(data)):
        http, _, body = bytes(block).partition(b"\r\n\r\n")
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
        if heads["WARC-Type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError(f"{file}, {offset}: the payload is not the one that was written")
        time = "".join(filter(str.isdigit, heads["WARC-Date"]))
        url = unquote_plus(heads[OWN_URI]) if OWN_URI in heads else heads.get("WARC-Target-URI")
        out.append((None, time, _number(heads.get("WARC-Record-ID")), url, heads["WARC-Type"], _number(heads.get("WARC-Refers-To")), size, digest, file, offset, length))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SCHEMA = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in CAPTURE.split(", ")])
_ORDER = ("urlkey", "timestamp", "key", "file", "offset")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives in path; those of a file together, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield _batch(_captures(file, data.as_py()), _SCHEMA)

    parsed = files.mapInArrow(run, CAPTURE).withColumn("urlkey", url_key(F.col("url")))
    return parsed.sortWithinPartitions("file", *_ORDER[:3])


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, so a step compares along one path only."""

    def __init__(self, runs: list[Iterator], by: Callable):
        self.runs, self.by, self.k = runs, by, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else by(h) for h in self.heads]
        self.tree = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.by(self.heads[w])
            node = (w + self.k) // 2
            while node:
                if self._first(self.tree[node], w):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.winner = w


def _sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def merge(runs: DataFrame) -> DataFrame:
    """The captures of all runs in the order of url key, time and key; position rises in that order, with gaps."""
    parts = max(1, math.ceil(runs.count() / MERGE_ROWS))
    ranges = runs.repartitionByRange(parts, *_ORDER).sortWithinPartitions("file", *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[list[tuple]] = []
        file = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not slices or row[8] != file:
                    slices.append([])
                    file = row[8]
                slices[-1].append(row)
        held: list[tuple] = []
        for row in LoserTree([iter(s) for s in slices], _sort_key):
            held.append(row)
            if len(held) == 8192:
                yield _batch(held, _SCHEMA)
                held = []
        if held:
            yield _batch(held, _SCHEMA)

    return ranges.mapInArrow(run, CAPTURE).withColumn("position", F.monotonically_increasing_id())


def archive_and_index(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None, date: str | None = None) -> DataFrame:
    """Writes the archives (to path, or a folder of their own in the shared one), reads them back, and merges their index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write(pages, path, key, url, payload, date)
    return merge(written(read_runs(spark, path), "runs"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_and_index(table(spark, sf_dir, "pages"))
    return captures.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP5_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as last, payload_bytes >= {MIN_REVISIT} as large from d)
select page_id, payload_bytes, payload_digest, case when large and last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when large and page_id is distinct from last then last end as refers_to
from g
"""
