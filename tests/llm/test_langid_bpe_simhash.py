import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import bpe, common, graph, jaccard, langid, simhash

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "ab " * 200_000
#: Of LONG every shingle is the same.
LONG_PRINT = xxhash.xxh64_intdigest(b"ab ab ab", 42)
#: doc_id, text, lang, and columns whose names the operators use themselves.
EDGES = [(1, None, "en", "x", 5), (2, "", None, None, None), (3, "   \n\t", "en", "x", 1), (4, "one two", "fr", "y", 2), (4, "one two", "fr", "y", 2), (None, "one two", "fr", "y", 3), (5, LONG, "en", "z", 4), (6, "123 !!", "de", None, 0)]
SCHEMA = "doc_id long, text string, lang string, score string, fp int"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


# BPE


@pytest.fixture(scope="module")
def both():
    return bpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_the_library_on_mixed_texts(both):
    mine, library = both
    rng = random.Random(7)
    parts = ["'s", "'T", "Σ", "é", "é", "<|endoftext|>", " ", "\t", "\u0085", "\x1c", "123", "½", "日本", "aaaaaaaa", "the", "-->", "​", "İ", "ſ", "K", "👍🏽", "ß", "՘", "Ᲊ", "𐵀", "\U0010ffff"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids, text
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_only_where_no_token_spans(both):
    mine, library = both
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("abcdexyzqj'é日") for _ in range(rng.randint(1, 60)))
        raw = word.encode()
        bounds = mine.fragment_bounds(raw)
        assert b"".join(raw[a:b] for a, b in bounds) == raw
        assert np.frombuffer(mine._encode_word(word), "<u4").tolist() == np.frombuffer(b"".join(mine._encode_fragment(raw, True) for _ in [0]), "<u4").tolist()
    assert any(len(mine.fragment_bounds(w.encode())) > 1 for w in ("zqxj日é", "日é日é"))


def test_bpe_long_fragment(both):
    mine, library = both
    for text in ("a" * 5000, "ab" * 3000 + "!" * 700):
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_round_trip_of_edges(edges, both, spark):
    library = both[1]
    rows = bpe.round_trip(edges, VOCABULARY).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        text = next(x[1] for x in EDGES if x[0] == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(edges.limit(0), VOCABULARY).count() == 0
    out = bpe.decode(bpe.encode(edges.withColumn("token_ids", F.lit("old")), VOCABULARY), VOCABULARY)
    assert out.where("doc_id = 4").first().decoded == library.decode(library.encode("one two").ids, skip_special_tokens=False)


# SimHash


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_quads_cover_every_five_positions():
    from itertools import combinations

    quads = simhash.quads()
    assert len(quads) == 14
    assert all(any(set(q) <= set(five) for q in quads) for five in combinations(range(8), 5))


def test_fingerprints(edges):
    for r in simhash.fingerprints(edges).collect():
        text = next(x[1] for x in EDGES if x[0] == r.key)
        assert r.fp & (1 << 64) - 1 == (LONG_PRINT if text == LONG else plain_fingerprint(text))


@pytest.mark.parametrize("list_rows", [simhash.LIST_ROWS, 8])
def test_links_equal_brute_force(spark, list_rows):
    """With list_rows 8 the same near copies go through the fifth byte and the blanks."""
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = {c for c in centre} | {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for c in centre:
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
        fps.update(c ^ (1 << b) for b in range(56, 64))
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame(signed, "fp long"), 3, list_rows)).collect()}
    want = plain_components(fps)
    groups = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(found.get(x[0], x[0]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates_of_edges(edges, spark):
    rows = {(r.key, r.fp): r.component for r in simhash.near_duplicates(edges).collect()}
    zero = {k: c for (k, f), c in rows.items() if f == 0}
    assert zero == {1: 1, 2: 1, 3: 1}
    assert {c for (k, f), c in rows.items() if k in (4, None)} == {4}
    assert simhash.near_duplicates(edges).count() == len(EDGES)
    assert simhash.near_duplicates(edges.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash.near_duplicates(alone).first().component is None


def test_op4_on_a_table(spark, sf):
    rows = simhash.op4_simhash(spark, sf).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(f == plain_fingerprint(texts[r.doc_id]) for r, f in list(zip(rows, fps, strict=True)))
    want = plain_components(fps)
    least = {}
    for r, w in zip(rows, want, strict=True):
        least[w] = min(least.get(w, r.doc_id), r.doc_id)
    assert all(r.component_id == least[w] for r, w in zip(rows, want, strict=True))


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_near_duplicates_of_frequent_fingerprints(spark, monkeypatch):
    """One text in half of the rows, with every list too long to broadcast."""
    monkeypatch.setattr(simhash, "POST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(i, "the same words again" if i % 2 else f"other words {i * i} here {i}") for i in range(200)], "doc_id long, text string")
        rows = simhash.near_duplicates(docs)
        assert {r.component for r in rows.where("key % 2 = 1").collect()} == {1}
        assert rows.count() == 200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("chunk", [1 << 20, 16])
def test_components_in_chunks(spark, chunk):
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(500, 501 + i) for i in range(150)] + [(-3, -3)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), chunk, hot_rows=40)
    assert {r.node: r.root for r in found.collect()} == root


def test_bands_of_similar_sets():
    """Sets at a similarity of 0.8 or more share a band, whichever sizes they have."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 40, 500, 520, 600, 700, 5000):
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            k = n // 10  # a tenth of the shingles each has alone: 0.8 of the union is shared
            b = np.concatenate([a[k:], rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2)])
            a, b = np.unique(a), np.unique(b)
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            assert np.intersect1d(jaccard.bands(a), jaccard.bands(b)).size
    shorter, longer = np.unique(rng.integers(0, 1 << 63, 639, np.uint64)), None
    longer = shorter[:511]
    assert np.intersect1d(jaccard.bands(shorter), jaccard.bands(longer)).size


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = graph.components(links).collect()
    assert len(rows) == n + 1 and {r.root for r in rows} == {0}


# Language ID


def test_langid_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = langid.op2_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_edges(edges, spark):
    filters = langid.fit(edges, share=0.0)
    assert filters.languages == ["en", "fr"] or set(filters.languages) <= {"de", "en", "fr"}
    rows = langid.identify(edges, filters).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        if r.doc_id in (1, 2, 3, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in filters.languages
    nothing = langid.fit(edges.limit(0))
    assert {r.lang_pred for r in langid.identify(edges, nothing).collect()} == {"und"}
    assert langid.identify(edges.limit(0), filters).count() == 0


def test_langid_masks_hold_all_languages(spark):
    """More than 64 languages take more than one word of a mask."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    docs = [(i * 200 + j, f"{alphabet[i % 26]}{alphabet[i // 26]}" * 6, f"l{i:03d}") for i in range(70) for j in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    filters = langid.fit(df)
    assert filters.masks.shape[1] == 2
    assert all(r.lang == r.lang_pred for r in langid.identify(df, filters).collect())


def test_langid_equals_plain_sets(spark):
    """The same n-grams in plain sets: counts by the filters' masks are theirs, corrected for what Bloom filters add."""
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("le chat et le chien sont la", "fr"), ("the house is old and the cat too", "en"), ("la maison est vieille et le chat aussi", "fr")] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    filters = langid.fit(df, share=0.0)

    def plain(text):
        x = "\0" + (text or "").lower() + "\0"
        x = [c if c.isalpha() else "" for c in x]
        return [tuple(x[i : i + n]) for n in langid.SIZES for i in range(len(x) - n + 1) if all(x[i + 1 : i + n - 1])]

    known = {lang: {} for lang in filters.languages}
    for i, t, lang in docs:
        if not (zlib.crc32(str(i).encode()) % 5 == 0):
            for g in set(plain(t)):
                known[lang][g] = known[lang].get(g, 0) + 1
    least = {lang: 1 for lang in known}  # under FEW documents one is enough
    for text in ("the dog and the house", "le chien est la", "maison cat", "zzz qqq"):
        grams = plain(text)
        share = {}
        for at, lang in enumerate(filters.languages):
            f = filters.false_rate[at]
            true = sum(known[lang].get(g, 0) >= least[lang] for g in grams)
            share[lang] = max(0.0, (true - f * len(grams)) / (1 - f)) / len(grams)
        name, score = (x[0] for x in filters.predict([text]))
        assert abs(score - max(share.values())) < 0.02 and (max(share.values()) == 0 or share[name] == max(share.values()))


def test_langid_learns_the_most_frequent_languages(spark):
    docs = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "le chat et le chien", "fr") for i in range(20)] + [(200 + i, f"noise {i}", f"x{i}") for i in range(40)]
    filters = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), most=2)
    assert filters.languages == ["en", "fr"]


def test_langid_long_text_in_blocks(monkeypatch):
    text = "der hund und die katze " * 50
    whole = [np.sort(np.concatenate([h for h, _ in langid.ngrams([text, "x"])]))]
    monkeypatch.setattr(langid, "BLOCK", 64)
    parts = [np.sort(np.concatenate([h for h, _ in langid.ngrams([text, "x"])]))]
    assert (whole[0] == parts[0]).all()
