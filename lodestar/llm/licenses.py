"""License scan by diagonal voting.

All rolling word k-gram hashes of a text are joined with the positions at which the templates have them. A hit of
template position t at word p lies on the diagonal p - t: a passage copied from a template votes for one diagonal, one
with words put in or left out for a few neighbouring ones. Votes are aggregated by diagonal, diagonals at most GAP
apart are merged to spans, and the spans are verified in the text's words: a span's score is the share of the
template's k-grams that it really has, and SIMILAR of them make a label. Base phrases are templates too: a diagonal
with all of a phrase's k-grams is a place of it, once its words are verified. A template of fewer than k words has
k-grams of its own length.

Only hashes leave the workers, and of them only those of templates are shuffled. The templates' k-grams are broadcast up
to SET_ROWS of them, and the texts that claim a label up to LIST_ROWS; beyond that both joins are shuffled, the k-grams'
with the frequent ones split.

Rows: a null text counts as empty: no words, no labels, score 0; texts of any length are scanned whole; rows that
repeat doc_id and text get equal results; doc_id may be null; an empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, keyed_join, short, table, written

K, GAP, SIMILAR = 3, 3, 0.7
#: The phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words of public licences and of the notices that refer to them, and labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "all rights reserved": "reserved",
}
#: k-grams of templates, of 24 bytes, and texts, of about 100, up to which a side is broadcast: 50 and 30 MB.
SET_ROWS, LIST_ROWS = 2_000_000, 300_000
#: Words hashed at once.
CHUNK = 1 << 18

_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; every ASCII character but letters and digits separates."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def grams(w: list[bytes], k: int = K) -> np.ndarray:
    """Hash of the k words from each position on."""
    x = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    n = max(0, len(w) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ x[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _rolling(df: DataFrame, kind: str, sizes: list[int]) -> DataFrame:
    """A row for each text (size and at -1, gram its number of words), and for each position and size of gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(whole.num_rows):
                b = whole.slice(row, 1)
                w = words(b.column(2)[0].as_py())
                for size, h in [(-1, np.array([len(w)], np.int64)), *((k, grams(w, k).view(np.int64)) for k in sizes)]:
                    for a in range(0, len(h), CHUNK):
                        part = h[a : a + CHUNK]
                        at = np.arange(a, a + len(part), dtype=np.int32) if size > 0 else np.array([-1], np.int32)
                        index = pa.array(np.zeros(len(at), np.int32))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(index), b.column(1).take(index), pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(part)], names=["key", "print", "size", "at", "gram"])

    return df.mapInArrow(_gathered(run), f"key {kind}, print bigint, size int, at int, gram bigint")


def _gathered(run, rows: int = 65_536):
    """run with its small batches put together."""

    def inner(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return inner


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", k: int = K, gap: int = GAP, similar: float = SIMILAR, set_rows: int = SET_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per row of docs: key, n_words, places (start and label of each phrase) and spans (template label, score, first and
    last word of each verified span)."""
    spark = docs.sparkSession
    known = [(p.encode().split(), label, True) for p, label in phrases.items()] + [(t.encode().split(), label, False) for t, label in templates.items()]
    known = [x for x in known if x[0]]
    sizes = sorted({min(k, len(w)) for w, _, _ in known}) or [k]
    posted = [(min(k, len(w)), h, t, i, len(w) - min(k, len(w)) + 1) for t, (w, _, _) in enumerate(known) for i, h in enumerate(grams(w, min(k, len(w))).view(np.int64).tolist())]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    posted = spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in zip(list(zip(*posted, strict=True)) or [()] * 5, kinds, strict=True)], names=["size", "gram", "t", "i", "need"]))
    docs = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()

    rolled = _rolling(docs, kind, sizes)
    if short(posted, set_rows):
        hits = written(rolled.join(F.broadcast(posted), ["size", "gram"], "left").where("at = -1 or t is not null"), "hits")
        texts, hits = hits.where("at = -1"), hits.where("at >= 0")
    else:
        rolled = written(rolled, "rolled")
        texts, rolled = rolled.where("at = -1"), rolled.where("at >= 0")
        lists = posted.groupBy("size", "gram").agg(F.collect_list(F.struct("t", "i", "need")).alias("posted"))  # the templates' own places
        counts = rolled.groupBy("size", "gram").agg(F.count("*").alias("n"))
        found = keyed_join(rolled, written(counts.join(lists, ["size", "gram"]), "posted"), ["size", "gram"], 0)
        hits = written(found.select("key", "print", "at", F.explode("posted").alias("p")).select("key", "print", "at", "p.*"), "hits")
    texts = texts.select("key", "print", F.col("gram").alias("n_words"))
    votes = hits.groupBy("key", "print", "t", "need", (F.col("at") - F.col("i")).alias("diagonal")).agg(F.collect_set("i").alias("positions"))
    by = Window.partitionBy("key", "print", "t").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int")
    merged = votes.withColumn("span", F.sum(F.coalesce(fresh, F.lit(0))).over(by)).groupBy("key", "print", "t", "need", "span")
    merged = merged.agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("votes"))
    merged = merged.where(F.col("votes") >= F.col("need") * similar)
    claims = written(merged.groupBy("key", "print").agg(F.array_sort(F.collect_list(F.struct("t", "low", "high"))).alias("claims")), "claims")
    few = short(claims, list_rows)
    claims = claims.select(F.col("key").alias("c_key"), F.col("print").alias("c_print"), "claims")
    same = F.col("key").eqNullSafe(F.col("c_key")) & (F.col("print") == F.col("c_print"))
    held = docs.join(F.broadcast(claims) if few else claims, same).select("key", "print", "text", "claims")
    out = "places array<struct<at:bigint,label:string>>, spans array<struct<label:string,score:double,first:bigint,last:bigint>>"
    kinds = [pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, spans = [], []
            for t, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, s = _verified(words(t), [(x["t"], x["low"], x["high"]) for x in c], known, k, similar)
                places.append(p)
                spans.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, kinds[0]), pa.array(spans, kinds[1])], names=["key", "print", "places", "spans"])

    found = held.mapInArrow(verify, f"key {kind}, print bigint, {out}").groupBy("key", "print").agg(F.first("places").alias("places"), F.first("spans").alias("spans"))
    found = found.select(F.col("key").alias("c_key"), F.col("print").alias("c_print"), "places", "spans")
    return texts.join(found, same, "left").select("key", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (x.split(" ", 1) for x in out.split(", "))])


def _verified(w: list[bytes], claims: list[tuple[int, int, int]], known: list, k: int, similar: float) -> tuple[list, list]:
    places, spans = [], []
    for t, low, high in claims:
        template, label, phrase = known[t]
        size = min(k, len(template))
        n = len(template) - size + 1
        has = [(d + i, i) for d in range(low, high + 1) for i in range(n) if 0 <= d + i and w[d + i : d + i + size] == template[i : i + size]]
        if phrase:
            places += [{"at": d, "label": label} for d in range(max(low, 0), high + 1) if w[d : d + len(template)] == template]
        if len({i for _, i in has}) >= n * similar:
            spans.append({"label": label, "score": len({i for _, i in has}) / n, "first": min(p for p, _ in has), "last": max(p for p, _ in has) + size - 1})
    return sorted(places, key=lambda x: (x["at"], x["label"])), spans


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["at"])
    base, more = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        F.col("key").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, more)).alias("labels"), score.alias("score"),
    )


def _sql_templates() -> str:
    rows = [*((p, label, True) for p, label in PHRASES.items()), *((t, label, False) for t, label in TEMPLATES.items())]
    return ", ".join(f"({i}, '{t}', '{label}', {str(phrase).lower()})" for i, (t, label, phrase) in enumerate(rows))


OP10_SQL = rf"""
with d as (
  select row_number() over () as row_id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
x as (select t, string_split(words, ' ') as words, label, phrase from (values {_sql_templates()}) v(t, words, label, phrase)),
tg as (select t, label, phrase, len(words) - {K - 1} as n, i - 1 as i, array_to_string(list_slice(words, i, i + {K - 1}), ' ') as gram from (select *, unnest(range(1, len(words) - {K - 2})) as i from x)),
dg as (select row_id, p - 1 as p, array_to_string(list_slice(words, p, p + {K - 1}), ' ') as gram from (select row_id, words, unnest(range(1, len(words) - {K - 2})) as p from d where len(words) >= {K})),
hits as (select row_id, t, label, phrase, n, p, i, p - i as diagonal from dg join tg on dg.gram = tg.gram),
diagonals as (select row_id, t, label, phrase, n, diagonal, count(distinct i) as votes from hits group by row_id, t, label, phrase, n, diagonal),
spans as (
  select *, sum(fresh) over (partition by row_id, t order by diagonal) as span
  from (select *, case when diagonal - lag(diagonal) over (partition by row_id, t order by diagonal) > {GAP} then 1 else 0 end as fresh from diagonals)),
scored as (
  select row_id, label, count(distinct i) / n::double as score from (select hits.row_id, hits.t, hits.label, hits.n, hits.i, spans.span from hits join spans on hits.row_id = spans.row_id and hits.t = spans.t and hits.diagonal = spans.diagonal)
  group by row_id, t, label, n, span having count(distinct i) >= n * {SIMILAR}),
base as (select row_id, label, diagonal from diagonals where phrase and votes = n),
b as (select row_id, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by row_id),
l as (select row_id, string_agg(distinct label, ',' order by label) as labels from (select row_id, label from base union select row_id, label from scored) group by row_id),
s as (select row_id, max(score) as score from scored group by row_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join b using (row_id) left join l using (row_id) left join s using (row_id)
"""
