"""Documents for training: language ID, line dedup, near-dedup, decontamination, tokens. Each stage is written as
Parquet and read again as the next one's documents.

Every stage keeps rows with nulls unless it says otherwise, and handles empty tables, empty and very long texts,
repeated rows and further columns as its operator's docstring says. All but the last return the columns they get."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontaminate, langid, line_dedup, simhash
from lodestar.llm.common import free_name, keyed_join, ship, shared_path, short, table, written
from lodestar.scratch import cleaned


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null ones among them) and those that fit no learned language."""
    ship(spark)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    judged = langid.identify(docs, langid.fit(docs), lang_pred=lang, score=score)
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= langid.MIN_SCORE)).select(*docs.columns)


#: Fixed value of the line-dedup stage: a document with this share of its words in passages that stand elsewhere is left to
#: near-dedup, which sees a copy whole and not what would be left of it.
COPY_SHARE = 0.4


def no_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates, passages that stand in two documents, and documents of which no word is left.
    Copies of documents keep their passages."""
    n_lines, n_dropped, n_cut = (free_name(docs, c) for c in ("n_lines", "n_dropped", "n_cut"))
    out = line_dedup.dedup_lines(docs, whole=COPY_SHARE, n_lines=n_lines, n_dropped=n_dropped, n_cut=n_cut)
    return out.where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]")).select(*docs.columns)


#: Fixed values of the near-dedup stage: words of a shingle, and the least Jaccard similarity of near copies.
NEAR_WORDS, NEAR_LEAST = 5, 0.8
#: Rows of 24 bytes up to which the list of documents that go is broadcast.
MARK_ROWS = 1_000_000


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with a component's smallest doc_id (null last); of texts that share that id, the one with the
    smallest hash, and of equal rows any one. Near copies are what op4 links and texts of which NEAR_LEAST of the shingles of
    NEAR_WORDS words are shared. Texts are shuffled only if more than MARK_ROWS of them go."""
    ship(spark)
    rows = simhash.near_duplicates(docs, words=NEAR_WORDS, least=NEAR_LEAST).groupBy("root", F.col("key").isNull().alias("no_key"), "key", "print").agg(F.count("*").alias("n"))
    rows = written(rows, "members")
    kept = rows.groupBy("root").agg(F.min(F.struct("no_key", "key", "print")).alias("least"), F.max("n").alias("most"), F.count("*").alias("members")).where("most > 1 or members > 1")
    kept = written(kept, "kept")
    # What changes: rows that go (0), and rows of which one stays (1).
    marks = keyed_join(rows, kept, ["root"], MARK_ROWS, n="members").select("key", "print", "n", (F.col("print") == F.col("least.print")) & F.col("key").eqNullSafe(F.col("least.key")))
    marks = marks.toDF("key", "print", "n", "stays").where("not stays or n > 1")
    mark, key, text = free_name(docs, "mark"), free_name(docs, "mark_key"), free_name(docs, "mark_print")
    marks = written(marks.select(F.col("key").alias(key), F.col("print").alias(text), F.col("stays").cast("int").alias(mark)), "marks")
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text))
    found = docs.join(F.broadcast(marks) if short(marks, MARK_ROWS) else marks, same, "left")
    single = found.where(F.col(mark).isNull())
    if not marks.where(F.col(mark) == 1).limit(1).count():
        return single.select(*docs.columns)
    rank = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(F.xxhash64(*docs.columns)))
    several = found.where(F.col(mark) == 1).withColumn(mark, rank).where(F.col(mark) == 1)
    return single.unionByName(several).select(*docs.columns)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of its token ids and digests of these and of the decoded text."""
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", no_recurring_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", no_benchmark_items),
    ("bpe", tokens),
]

#: Bloom filters, connected components and merges by rank have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage puts into the shared folder goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with cleaned(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
