"""Benchmark decontamination with a broadcast hash set of normalised test n-grams, in DataFrame operations only.

A test item's windows are its runs of `window` words; an item of fewer words, but not none, is one window. To scan a
text without making each of its windows, the hash set holds the items' half windows: blocks of L = ceil(m / 2) words
for windows of m words. Of m - L + 1 blocks that start in a row, one starts at a multiple of m - L + 1, so every
occurrence of a window holds one of the text's blocks at those multiples: only these are hashed and probed. Texts with
a block in the set are verified: all their windows are compared with the items' windows as strings, so neither hash
collisions nor half matches count. Both scans cover the whole of every text.

The set is broadcast after a count shows at most SET_ROWS grams, and the list of texts to verify at most LIST_ROWS;
beyond these both are shuffle joins.

Rows: null texts have no words, and empty ones none; texts of any length count whole; rows that repeat doc_id and text
get the same figures; doc_id may be null; items with a null or empty text have no windows; windows of items with a null
item_id hit, and the item is not listed; repeated item_ids count once; no documents give no rows; without items nothing
is hit; other columns are not read, or kept as they are by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CASED_WORD, ascii_lower, table, words_of, written

WINDOW = 10
#: Grams of 8 bytes, and texts of about 20, up to which a side is broadcast: 20 MB.
SET_ROWS, LIST_ROWS = 2_000_000, 1_000_000


def _folded_words(text: Column) -> Column:
    """Words that are equal wherever the contract's are: lower-cased beyond A-Z too, letter by letter, which no word's
    bounds depend on. Much cheaper than A-Z alone, and good enough to find what to verify."""
    return words_of(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))))


def _block(m: int) -> tuple[int, int]:
    """Words of a half window, and the step between a text's blocks."""
    return (length := (m + 1) // 2), m - length + 1


def _blocks(words: Column, length: int, step: int) -> Column:
    """Hashes of the runs of `length` words that start at multiples of `step`."""
    last = F.floor((F.size(words) - length) / step).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i * step + 1, length)))
    return F.when(F.size(words) >= length, hashes).otherwise(F.array().cast("array<bigint>"))


def _windows(words: Column, lengths: list[int]) -> Column:
    """Structs of each window's start, length and words."""

    def of(m: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(words) - m), lambda i: F.struct(i.alias("at"), F.lit(m).alias("m"), F.array_join(F.slice(words, i + 1, m), " ").alias("gram")))
        return F.when(F.size(words) >= m, made)

    none = F.array().cast("array<struct<at:int,m:int,gram:string>>")
    return F.concat(none, *[F.coalesce(of(m), none) for m in lengths])


def _own_length(window: int) -> Column:
    return F.least(F.size("words"), F.lit(window))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: key, print (a hash of the text), n_words, spans (start and length in words of each occurrence)
    and items (the item ids with occurrences, as sorted strings)."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    items = items.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    lengths = sorted(r[0] for r in items.select(words_of(ascii_lower(F.col("text"))).alias("words")).select(_own_length(window)).distinct().collect() if r[0])

    folded = items.select(_folded_words(F.col("text")).alias("words"))
    grams = [folded.where(_own_length(window) == m).select(F.explode(_blocks(F.col("words"), _block(m)[0], 1)).alias("gram")) for m in lengths]
    found = docs.select("key", "print", _folded_words(F.col("text")).alias("words"))
    blocks = F.concat(F.array(F.lit(None).cast("bigint")), *[_blocks(F.col("words"), *_block(m)) for m in lengths])
    found = found.select("key", "print", F.size("words").cast("bigint").alias("n_words"), F.explode(blocks).alias("gram"))
    # One row for each text (gram is null), and one for each of its blocks in the set.
    if grams:
        known = grams[0]
        for g in grams[1:]:
            known = known.unionByName(g)
        known = known.distinct().withColumn("known", F.lit(True))
        small = known.limit(SET_ROWS + 1).count() <= SET_ROWS
        found = found.join(F.broadcast(known) if small else known, "gram", "left").where("gram is null or known")
    rows = written(found.select("key", "print", "n_words", F.col("gram").isNull().alias("is_text")), "scanned")
    texts = rows.where("is_text").select("key", "print", "n_words")
    suspects = rows.where("not is_text").select("key", "print").distinct()

    small = suspects.limit(LIST_ROWS + 1).count() <= LIST_ROWS
    s = suspects.select(F.col("key").alias("s_key"), F.col("print").alias("s_print"))
    held = docs.join(F.broadcast(s) if small else s, F.col("key").eqNullSafe(F.col("s_key")) & (F.col("print") == F.col("s_print")), "left_semi")
    seen = held.select("key", "print", words_of(ascii_lower(F.col("text"))).alias("words"))
    seen = seen.select("key", "print", F.explode(_windows(F.col("words"), lengths)).alias("w")).select("key", "print", "w.*")
    tested = items.select("item", words_of(ascii_lower(F.col("text"))).alias("words"))
    tested = tested.select("item", _own_length(window).alias("own"), F.explode(_windows(F.col("words"), lengths)).alias("w")).where("own = w.m")
    tested = tested.groupBy(F.col("w.m").alias("m"), F.col("w.gram").alias("gram")).agg(F.collect_set("item").alias("items"))
    hits = seen.join(tested, ["m", "gram"]).groupBy("key", "print").agg(
        F.array_sort(F.collect_set(F.struct("at", "m"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    hits = hits.select(F.col("key").alias("h_key"), F.col("print").alias("h_print"), "spans", "items")
    both = texts.join(hits, F.col("key").eqNullSafe(F.col("h_key")) & (F.col("print") == F.col("h_print")), "left")
    return both.select(
        "key", "print", "n_words",
        F.coalesce("spans", F.array().cast("array<struct<at:int,m:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["at"] + s["m"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], s["at"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def _merged(spans: Column) -> Column:
    """Sorted spans as disjoint ones, each with its start and end."""
    kind = "array<struct<at:int,end:int>>"

    def add(acc: Column, s: Column) -> Column:
        last, end = F.element_at(acc, -1), s["at"] + s["m"]
        apart = F.concat(acc, F.array(F.struct(s["at"].alias("at"), end.alias("end"))))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["end"], end).alias("end"))))
        return F.when(F.size(acc) == 0, apart).when(s["at"] > last["end"], apart).otherwise(joined)

    return F.aggregate(spans, F.array().cast(kind), lambda acc, s: add(acc, s).cast(kind))


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a test window (mode documents), or without the words inside test windows and
    what stands before each of them (mode spans). Columns and other rows stay as they are."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode} is neither documents nor spans")
    hit = contamination(docs, items, window, key, text, item, item_text).where(F.size("spans") > 0)
    hit = hit.groupBy("key", "print").agg(_merged(F.first("spans")).alias("spans"))
    names = {c: f"_hit_{c}" for c in hit.columns}
    hit = hit.withColumnsRenamed(names)
    same = docs[key].eqNullSafe(F.col("_hit_key")) & (F.xxhash64(docs[text]) == F.col("_hit_print"))
    if mode == "documents":
        return docs.join(hit, same, "left_anti")
    both = docs.join(hit, same, "left")
    # Each word with what stands before it; what stands after the last word comes with a null word.
    pairs = F.arrays_zip(F.split(F.col(text), CASED_WORD).alias("before"), F.regexp_extract_all(F.col(text), F.lit(f"({CASED_WORD})"), 1).alias("word"))
    inside = lambda i: F.exists("_hit_spans", lambda s: (i >= s["at"]) & (i < s["end"]))
    clean = F.array_join(F.transform(pairs, lambda p, i: F.when(inside(i), "").otherwise(F.concat(p["before"], F.coalesce(p["word"], F.lit(""))))), "")
    return both.withColumn(text, F.when(F.col("_hit_key").isNotNull() | F.col("_hit_print").isNotNull(), clean).otherwise(F.col(text))).select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = hit_words(F.col("spans"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


OP7_SQL = r"""
with d as (
  select row_number() over () as row_id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from documents),
b as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from benchmark),
bw as (
  select item_id, least(len(words), 10) as m, i, array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') as gram
  from (select item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) as i from b where len(words) > 0)),
grams as (select distinct item_id, m, gram from bw),
ms as (select distinct m from grams),
dw as (
  select row_id, m, i, array_to_string(list_slice(words, i, i + m - 1), ' ') as gram
  from (select row_id, words, m, unnest(range(1, len(words) - m + 2)) as i from d, ms where len(words) >= m)),
hits as (select row_id, dw.m, i, item_id from dw join grams on dw.m = grams.m and dw.gram = grams.gram),
hit_words as (select row_id, count(distinct p) as n_hit from (select row_id, unnest(range(i, i + m)) as p from (select distinct row_id, m, i from hits)) group by row_id),
hit_items as (select row_id, count(distinct item_id) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct row_id, item_id from hits where item_id is not null) group by row_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (row_id) left join hit_items using (row_id)
"""
