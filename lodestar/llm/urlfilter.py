"""URL filter over a sorted digest array.

Entries are strings `host/path`, each with a verdict. Their 64-bit xxhash keys lie sorted in a file, beside the strings
themselves; a file holds FILE_ENTRIES at most, and a longer list is dealt over as many files as it needs. Workers memory-map the files that Spark hands to each executor once, hash what a batch's urls could match
(each parent domain of no more labels than some entry's host, with each prefix of the path that is as long as some
entry's path), probe all of it with one vectorised binary search a file, and compare the stored strings, so that a
collision of keys changes nothing. A long list is given as a table: it is sorted by Spark and passes the driver file by
file.

An entry fits its host and all subdomains if the url's path starts with the entry's path. Of the fitting rules the
longest string decides (of equally long ones that with the longer host). Where no rule fits, the url is blocked if an
entry of the block list fits, and allowed otherwise.

Rows: a null url, or one without `://`, has an empty host and path and is allowed; very long urls are judged whole;
repeated rows get equal verdicts; nulls elsewhere and other columns don't matter; an empty table gives an empty one;
without any entries all urls are allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, extended, put_bytes, shared_path, table, written

#: The rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: The filter's own block list: hosts that serve advertisements only.
BLOCKED = ("googlesyndication.com/", "adnxs.com/", "taboola.com/", "outbrain.com/", "criteo.com/", "popcash.net/")
#: Entries of one index file: some 200 MB, and as much memory where it is built.
FILE_ENTRIES = 2_000_000
RULE_BLOCK, RULE_ALLOW, LISTED = 0, 1, 2


def digest(strings: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64)


def build(entries: list[tuple[str, int]]) -> bytes:
    """A file of (string, kind): four counts, then sorted keys, string offsets, kinds, path lengths, strings."""
    keys = digest(s for s, _ in entries)
    order = np.argsort(keys, kind="stable")
    raw = [entries[i][0].encode("utf-8", "surrogatepass") for i in order]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
    kinds = np.array([entries[i][1] for i in order], np.int64)
    hosts = [s.split("/", 1)[0] for s, _ in entries]
    lengths = np.array(sorted({len(s) - len(h) for (s, _), h in zip(entries, hosts, strict=True)}), np.int64)
    head = np.array([len(raw), len(lengths), max((h.count(".") + 1 for h in hosts), default=0), max(map(len, hosts), default=0)], np.int64)
    return b"".join([head.tobytes(), keys[order].tobytes(), offsets.tobytes(), kinds.tobytes(), lengths.tobytes(), *raw])


def kinds_of(rules: dict[str, str], blocked: Iterable[str]) -> list[tuple[str, int]]:
    return [(s, RULE_ALLOW if v == "allow" else RULE_BLOCK) for s, v in rules.items()] + [(s, LISTED) for s in dict.fromkeys(blocked)]


def files(spark: SparkSession, rules: dict[str, str], blocked: Iterable[str] | DataFrame, file_entries: int) -> Iterator[bytes]:
    """The index files of the entries, one after the other."""
    if not isinstance(blocked, DataFrame):
        entries = kinds_of(rules, blocked)
        if len(entries) <= file_entries:
            yield build(entries)
            return
        blocked = spark.createDataFrame([(s,) for s, kind in entries if kind == LISTED], "entry string")
    column = blocked.columns[0]
    listed = blocked.select(F.col(column).cast("string").alias("entry")).dropna().distinct()
    yield build(kinds_of(rules, []))
    n = max(1, math.ceil(2 * listed.count() / file_entries))  # ranges are estimated: half full

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        for b in batches:
            held += [(s, LISTED) for s in b.column(0).to_pylist()]
            while len(held) >= file_entries:
                yield pa.RecordBatch.from_arrays([pa.array([build(held[:file_entries])], pa.binary())], names=["file"])
                held = held[file_entries:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build(held)], pa.binary())], names=["file"])

    key = F.xxhash64("entry")
    packed = written(listed.repartitionByRange(n, key).sortWithinPartitions(key).mapInArrow(pack, "file binary"), "urls")
    for r in packed.toLocalIterator():
        yield bytes(r.file)


class Index:
    """Memory-mapped index files."""

    def __init__(self, *paths: str):
        self.parts = []
        lengths: set[int] = set()
        self.labels = self.host = 0
        for path in paths:
            data = np.memmap(path, np.uint8, "r")
            n, m, labels, host = (int(x) for x in data[:32].view(np.int64))
            if not n:
                continue
            at = 32
            keys, offsets = data[at : at + 8 * n].view(np.uint64), data[at + 8 * n : at + 16 * n + 8].view(np.int64)
            kinds = data[at + 16 * n + 8 : at + 24 * n + 8].view(np.int64)
            lengths.update(data[at + 24 * n + 8 : at + 24 * n + 8 + 8 * m].view(np.int64).tolist())
            self.parts.append((keys, offsets, kinds, data[at + 24 * n + 8 + 8 * m :]))
            self.labels, self.host = max(self.labels, labels), max(self.host, host)
        self.lengths = sorted(lengths)

    def find(self, strings: list[str]) -> np.ndarray:
        """Each string's kinds as bits (bit k: it is an entry of kind k)."""
        h = digest(strings)
        out = np.zeros(len(h), np.int64)
        for keys, offsets, kinds, raw in self.parts:
            at = np.searchsorted(keys, h)
            for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h):
                j, want = at[i], strings[i].encode("utf-8", "surrogatepass")
                while j < len(keys) and keys[j] == h[i]:  # equal keys stand side by side
                    if raw[offsets[j] : offsets[j + 1]].tobytes() == want:
                        out[i] |= 1 << int(kinds[j])
                    j += 1
        return out

    def domains(self, host: str) -> Iterator[str]:
        """The host and its parent domains that some entry's host could be."""
        at = len(host)
        for _ in range(self.labels):
            at = host.rfind(".", 0, at)
            if len(host) - at - 1 > self.host:
                return
            if domain := host[at + 1 :]:
                yield domain
            if at < 0:
                return

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str], list[str | None]]:
        """Rule, verdict and entry of the block list for each url."""
        rows, tried, host_length = [], [], []
        for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for domain in self.domains(host):
                for n in self.lengths:
                    if n <= len(path):
                        rows.append(row)
                        tried.append(domain + path[:n])
                        host_length.append(len(domain))
        best: list[tuple[int, int, int] | None] = [None] * len(hosts)
        listed: list[tuple[int, int, int] | None] = [None] * len(hosts)
        found = self.find(tried)
        for i in np.flatnonzero(found).tolist():
            for at in (best,) * bool(found[i] & (1 << RULE_BLOCK | 1 << RULE_ALLOW)) + (listed,) * bool(found[i] & 1 << LISTED):
                at[rows[i]] = max(at[rows[i]] or (0, 0, 0), (len(tried[i]), host_length[i], i))
        rule = [tried[b[2]] if b else None for b in best]
        entry = [tried[b[2]] if b else None for b in listed]
        verdict = [("allow" if found[b[2]] & 1 << RULE_ALLOW else "block") if b else "block" if e else "allow" for b, e in zip(best, entry, strict=True)]
        return rule, verdict, entry


def split_url(url):
    """Host and path columns."""
    match = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, match, 1), UPPER, LOWER), F.regexp_extract(url, match, 2)


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, blocked: Iterable[str] | DataFrame = BLOCKED, url: str = "url", file_entries: int = FILE_ENTRIES) -> DataFrame:
    """pages with host, path, rule, verdict and listed (the longest fitting entry of the block list); columns of these
    names are replaced. blocked: entries, or a table whose first column holds them."""
    out = ["host", "path", "rule", "verdict", "listed"]
    pages = pages.drop(*out)
    spark = pages.sparkSession
    names = []
    for data in files(spark, rules, blocked, file_entries):
        where = put_bytes(spark, shared_path(spark, "urls"), data)
        names.append(where.rsplit("/", 1)[1])
        spark.sparkContext.addFile(where)
    host, path = split_url(F.col(url))
    df = pages.withColumns({"host": host, "path": path})
    schema = extended(df.schema, "rule string, verdict string, listed string")
    at = [df.columns.index("host"), df.columns.index("path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*map(SparkFiles.get, names))
        for b in batches:
            made = index.judge(*(b.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in made)], names=[*b.schema.names, *out[2:]])

    return df.mapInArrow(run, schema)


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _values(names: Iterable[str]) -> str:
    return ", ".join(f"('{s}')" for s in names)


OP1_SQL = rf"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path, row_number() over () as row_id from pages),
e as (
  select rule, verdict, string_split(rule, '/')[1] as e_host, substr(rule, length(string_split(rule, '/')[1]) + 1) as e_path
  from (values {", ".join(f"('{r}', '{v}')" for r, v in RULES.items())}, {", ".join(f"('{b}', 'listed')" for b in BLOCKED)}) t(rule, verdict)),
f as (
  select row_id, rule, verdict, row_number() over (partition by row_id, verdict = 'listed' order by length(rule) desc, length(e_host) desc) as k
  from u join e on (host = e_host or ends_with(host, '.' || e_host)) and starts_with(path, e_path))
select page_id, host, path, r.rule as rule, coalesce(r.verdict, case when l.rule is null then 'allow' else 'block' end) as verdict, l.rule as listed
from u left join (select * from f where k = 1 and verdict <> 'listed') r using (row_id) left join (select * from f where k = 1 and verdict = 'listed') l using (row_id)
"""
