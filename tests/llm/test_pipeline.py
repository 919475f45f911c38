"""The pipeline against a plain Python version of its stages, and each stage on edge cases."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import jaccard, langid, line_dedup, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_near_copies(docs):
    """By all pairs: fingerprints of three-word shingles within 3 bits, or five-word shingles with a Jaccard similarity of 0.8."""
    docs = sorted(docs, key=lambda d: d["doc_id"])
    fps, sets = [], []
    for d in docs:
        words = d["text"].encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=int) if len(h) else np.zeros(64, int)
        fps.append(np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0])
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group, values = list(range(len(docs))), np.array(fps, np.uint64)
    for n in range(len(docs)):
        near = set(np.flatnonzero(np.bitwise_count(values[:n] ^ values[n]) <= 3).tolist())
        near |= {m for m in range(n) if (both := len(sets[m] & sets[n])) and both >= 0.8 * (len(sets[m]) + len(sets[n]) - both)}
        roots = {group[m] for m in near} | {n}
        group = [min(roots) if g in roots else g for g in group]
    return [docs[g] for g in sorted(set(group))]


def test_pipeline_equals_plain_python(spark, sf):
    """Stages 1 and 2 are taken from their operators, which have tests of their own; the others are done anew."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.known_language(spark, docs, sf)
    second = [r.asDict() for r in corpus_pipeline.no_recurring_lines(spark, first, sf).collect()]
    third = plain_near_copies(second)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        grams.setdefault(n, set()).update(tuple(w[a : a + n]) for a in range(len(w) - n + 1 if n else 0))
    clean = [d for d in third if (w := words(d["text"])) is not None and not any(tuple(w[a : a + n]) in g for n, g in grams.items() for a in range(len(w) - n + 1))]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d in clean:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        want[d["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
    assert len(third) < len(second) and len(clean) < len(third)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edges(spark, sf, name, stage):
    long = "the cat and the dog " * 20_000
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the house is here", "en", None, 1), (3, "the house is here", "en", None, 1), (None, "the house is here", None, "s", 1), (None, "quite another text of words", None, "s", 1), (None, "and a third one it is now", None, "s", 1), (4, long, "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"score": F.lit("mine"), "n_dropped": F.lit("mine"), "key": F.lit(1), "print": F.lit(1), "row": F.lit(1)})
    out = stage(spark, docs, sf)
    rows_out = out.collect()
    if name != "bpe":
        assert out.columns == docs.columns
        assert all(r.score == "mine" and r.n_dropped == "mine" for r in rows_out)
    # what a few texts teach knows the texts that recur only
    count = {"language_id": 4, "line_dedup": 8, "near_dedup": 5, "decontamination": 8, "bpe": 8}
    assert len(rows_out) == count[name]
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_one_of_each_group_of_copies_stays(spark, sf):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i, text if i % 2 else f"document {i} says something of its own {i * 7} times", "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    ids = sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect())
    components = {r.component for r in simhash.near_duplicates(docs).collect()}
    assert ids == sorted(components) and 1 in ids and 3 not in ids


def test_edited_copies_are_near_copies(spark, sf):
    """Six of 300 words changed: a five-word Jaccard similarity of 266 / 326."""
    words = [f"w{i * i % 9973}x{i}" for i in range(300)]
    edit = lambda n: " ".join(f"new{i}" if i % 40 == 20 and i // 40 < n else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, edit(0)), (2, edit(6)), (3, " ".join(f"v{i}" for i in range(300)))], "doc_id long, text string")
    assert len({r.fp for r in simhash.near_duplicates(docs).collect()}) == 3
    assert len({r.component for r in simhash.near_duplicates(docs).collect()}) == 3
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()) == [1, 3]
    # 1 and 4 are too far apart to be linked, but both are near 2
    chain = [(1, edit(0)), (2, edit(4)), (4, edit(4) + " " + " ".join(f"u{i}" for i in range(60)))]
    a, b, c = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in chain)
    assert len(a & b) >= 0.8 * len(a | b) and len(b & c) >= 0.8 * len(b | c) and len(a & c) < 0.8 * len(a | c)
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()] == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs.where("doc_id <> 2"), sf).collect()) == [1, 4]


def test_long_lines_of_few_documents_are_dropped(spark, sf):
    line = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(93))
    numbers = lambda i: " ".join(str(i * 1000 + n) for n in range(200))
    docs = spark.createDataFrame([(i, f"own {i} here\n{line}\n{numbers(i)}" if i < 4 else f"own {i}\nshort line of two documents") for i in range(6)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.no_recurring_lines(spark, docs, sf).collect()}
    assert line in out[0] and all(out[i] == f"own {i} here\n{numbers(i)}" for i in (1, 2, 3))
    assert out[4] == "own 4\nshort line of two documents" and out[5] == "own 5\nshort line of two documents"


def test_copies_are_left_to_near_dedup(spark, sf):
    """A copy with an edit in its second sentence is whole for near_dedup, which keeps one of both."""
    text = lambda e: " ".join(f"{' '.join(f'w{s * 20 + i}x' for i in range(20))}{' edited' if s == 1 and e else ''}." for s in range(10))
    docs = spark.createDataFrame([(1, text(False)), (2, text(True)), (3, " ".join(f"v{i}" for i in range(200)))], "doc_id long, text string")
    lines = corpus_pipeline.no_recurring_lines(spark, docs, sf)
    assert {r.doc_id: r.text for r in lines.collect()}[2] == text(True)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, lines, sf).collect()) == [1, 3]


def test_a_large_group_of_near_copies(spark, sf, monkeypatch):
    """Each copy with edits of its own, far from most others: found over hubs, and pair by pair at last."""
    words = [f"w{i * i % 997}x{i}" for i in range(200)]
    edit = lambda d: " ".join(f"new{d}x{i}" if i in (7 + d % 30, 60 + 2 * d % 70, 140 + d % 50) else w for i, w in enumerate(words))
    rows = [(d, edit(d)) for d in range(60)] + [(100 + d, " ".join(f"own{d}x{i}" for i in range(50))) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both >= 0.8 * len(sets[i] | sets[j]) or (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() <= 3) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    want = sorted(rows[g][0] for g in set(group))
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()) == want
    monkeypatch.setattr(jaccard, "HUBS", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # many blocks within a band
    monkeypatch.setattr(jaccard, "LIST_ROWS", 0)
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 5)
    monkeypatch.setattr(corpus_pipeline, "MARK_ROWS", 0)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()) == want


def test_short_lines_of_many_documents_are_dropped(spark, sf):
    own = lambda i: f"own{chr(97 + i % 26)}{chr(97 + i // 26)} text"
    docs = spark.createDataFrame([(i, own(i) + "\nAll rights reserved." + ("\nChance." if i < 15 else "")) for i in range(30)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.no_recurring_lines(spark, docs, sf).collect()}
    assert out[0] == own(0) + "\nAll rights reserved.\nChance."
    assert all(out[i] == own(i) + ("\nChance." if i < 15 else "") for i in range(1, 30))


def test_near_dedup_equals_all_pairs(spark, sf):
    """On the documents as they are, against every pair's fingerprints and shingle sets."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    words = [(r.text or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    fps = [simhash.fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    only_sets = 0
    for j in range(len(rows)):
        for i in range(j):
            bits, shared = (fps[i] ^ fps[j]).bit_count() <= 3, len(sets[i] & sets[j])
            similar = shared > 0 and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)
            only_sets += similar and not bits
            if (bits or similar) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert only_sets
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()) == sorted({rows[r].doc_id for r in root})


def test_stage_order_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert langid.UNKNOWN == "und" and line_dedup.MIN_DOCS > 1
