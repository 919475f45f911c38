"""Language identification with language-bitmask n-gram filters.

Training finds the letter n-grams that stand in a fair share of a language's documents. They go into Bloom filters of
all languages at once, bit-sliced: slot s of the table is a mask with bit l set if language l's filter has bit s. For
an n-gram the masks at its slots are ANDed: what is left are all languages that contain it (some falsely). A text's
counts per language are the set bits over its n-grams; each count c of n is corrected for its filter's rate f of false
positives, (c - f n) / (1 - f), and the largest decides, ties by the smaller name. The score is that corrected count's
share of n.

Training reads whole texts of at most SAMPLE documents of each language, those with the smallest hashes of their keys, and
learns the LANGUAGES most frequent languages (of equally frequent ones the smaller name); prediction reads every whole
text. What the driver gets is the names and the table, of SLOTS masks at most.

Rows: null texts and texts without a letter are `und` with score 0; with no language learned every text is; a text with
letters but no known n-gram gets the first language by name, with score 0; very long texts are counted in blocks; rows
with a null key are predicted, not learned from; repeated rows get equal predictions; an empty table gives an empty one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import extended, table, written

#: Documents of a language that are learned from, at most; its share of them that an n-gram must stand in.
SAMPLE, SHARE = 1000, 0.005
#: Languages that are learned, at most: a column of anything else than languages doesn't make masks without bound.
LANGUAGES = 1024
#: From so many documents of a language on an n-gram must stand in two at least.
FEW = 20
SIZES, SLOTS, HASHES = (3, 4), 1 << 18, 3
#: Code points that are hashed at once.
BLOCK = 1 << 19
UNKNOWN = "und"
#: A text is rejected below this score: less than that share of its n-grams belongs to its language.
MIN_SCORE = 0.3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as code points with a 0 around each, in blocks of about BLOCK; each code point's row; and whether n-grams
    may start there: a block repeats the first code points of a long text's next block."""
    points, rows, own, size = [], [], [], 0
    for row, text in enumerate(texts):
        x = np.frombuffer(f"\0{(text or '').lower()}\0".encode("utf-32-le", "surrogatepass"), np.uint32)
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK + max(SIZES) - 1]
            points.append(part)
            rows.append(np.full(len(part), row))
            own.append(np.arange(len(part)) < BLOCK)
            size += len(part)
            if size >= BLOCK:
                yield np.concatenate(points), np.concatenate(rows), np.concatenate(own)
                points, rows, own, size = [], [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(rows), np.concatenate(own)


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the texts' n-grams and their rows. An n-gram is a run of letters; its first and last place may also be
    a word's bound."""
    for points, rows, own in _blocks(texts):
        letter = _letters()[points]
        c = np.where(letter, points, 0).astype(np.uint64)
        for n in SIZES:
            if len(c) < n:
                continue
            m = len(c) - n + 1
            ok = own[:m] & (rows[:m] == rows[n - 1 :])
            for i in range(1, n - 1):
                ok &= letter[i : m + i]
            at = np.flatnonzero(ok)
            h = np.full(len(at), n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[at + i] + np.uint64(1)
                h ^= h >> np.uint64(31)
            yield h * np.uint64(0xD6E8FEB86659FD93), rows[at]


def slots(h: np.ndarray, n_slots: int = SLOTS, hashes: int = HASHES) -> list[np.ndarray]:
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(n_slots)).astype(np.int64) for i in range(hashes)]


class Filters:
    """The bit-sliced table; languages by name, language l at bit l % 64 of word l // 64."""

    def __init__(self, languages: list[str], masks: np.ndarray, hashes: int = HASHES):
        self.languages, self.masks, self.hashes = languages, masks, hashes
        fill = np.array([self._bit(masks, i).mean() for i in range(len(languages))])
        self.false_rate = fill**hashes

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        narrow = len(self.languages) <= 8
        lut = self.masks[:, 0].astype(np.uint8) if narrow else self.masks
        for h, rows in ngrams(texts):
            held = None
            for s in slots(h, len(self.masks), self.hashes):
                held = lut[s] if held is None else held & lut[s]
            total += np.bincount(rows, minlength=len(texts))
            for i in range(len(self.languages)):
                has = (held >> np.uint8(i)) & np.uint8(1) if narrow else self._bit(held, i)
                counts[:, i] += np.bincount(rows[has.astype(bool)], minlength=len(texts))
        f = np.minimum(self.false_rate, 1 - 1e-9)
        share = np.clip((counts - f * total[:, None]) / (1 - f), 0, None) / np.maximum(total, 1)[:, None]
        best = share.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        known = [bool(self.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        name = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)]
        return name, [float(min(1.0, share[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), known, strict=True))]


def held_out(key: str):
    """A fifth of the keys by CRC-32, which is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, share: float = SHARE, most: int = LANGUAGES) -> Filters:
    """Learns from text and lang of documents that are not held out, at most `sample` of each of `most` languages."""
    mine = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    mine = mine.where(~held_out("key") & F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = mine.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    languages = sorted(r.lang for r in counts)
    if not languages:
        return Filters([], np.zeros((SLOTS, 1), np.uint64))
    index = {name: i for i, name in enumerate(languages)}
    # Before ranking, each language is cut to about twice the sample, so that no task ranks more, whatever the input.
    sizes = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * sample / r["n"]) if r["n"] > 2 * sample else 1.1) for r in counts], "lang string, part double")
    mine = mine.join(F.broadcast(sizes), "lang")  # `most` rows
    near = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40) < F.col("part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "print"))
    few = mine.where(near).select("lang", "key", F.xxhash64("text").alias("print")).distinct()
    chosen = written(few.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank"), "sample")
    picked = chosen.select("key", "print").distinct()
    texts = mine.withColumn("print", F.xxhash64("text")).join(F.broadcast(picked), ["key", "print"], "left_semi").groupBy("lang", "key", "print").agg(F.first("text").alias("text")).select("lang", "text")  # at most `sample` keys of each language

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's distinct n-grams."""
        for b in batches:
            for name, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.unique(np.concatenate([x for x, _ in ngrams([text_])] or [np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), index[name], np.int32)), pa.array(h.view(np.int64))], names=["l", "h"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = slots(b.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(b.column(0).to_numpy(), HASHES)), pa.array(np.concatenate(at))], names=["l", "slot"])

    docs_of = chosen.groupBy("lang").agg(F.count("*").alias("docs"))
    numbers = docs.sparkSession.createDataFrame(list(index.items()), "lang string, l int")
    docs_of = docs_of.join(F.broadcast(numbers), "lang").select("l", F.greatest(F.ceil(F.col("docs") * share), F.when(F.col("docs") < FEW, 1).otherwise(2)).alias("least"))
    common = texts.mapInArrow(seen, "l int, h bigint").groupBy("l", "h").agg(F.count("*").alias("n"))
    common = common.join(F.broadcast(docs_of), "l").where("n >= least").select("l", "h")  # a row for each language
    word = F.floor(F.col("l") / 64).cast("int")
    bits = common.mapInArrow(placed, "l int, slot bigint").groupBy("slot", word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, l % 64)")).alias("mask")).collect()
    masks = np.zeros((SLOTS, (len(languages) + 63) // 64), np.uint64)
    for slot, w, mask in bits:
        masks[slot, w] = mask & 0xFFFFFFFFFFFFFFFF
    return Filters(languages, masks)


def identify(docs: DataFrame, filters: Filters, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and its score; columns of these names are replaced."""
    docs = docs.drop(lang_pred, score)
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))  # SLOTS masks
    at = docs.columns.index(text)
    schema = extended(docs.schema, f"`{lang_pred}` string, `{score}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Filters(*shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                names, scores = mine.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_pred, score])

    return docs.mapInArrow(run, schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), fit(docs)).drop("text")
