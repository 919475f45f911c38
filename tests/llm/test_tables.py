"""Operators on lines, windows, licences, urls, archives, vectors and grades, against brute force and on edge cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, decontaminate, hnsw, licenses, line_dedup, quality, urlfilter, warc
from lodestar.llm.queries import QUERIES, SQL

TABLES = "documents pages benchmark embeddings labels".split()
LONG = "word " * 100_000


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, want = QUERIES[name](spark, sf), con.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    want = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
    clean = lambda rs: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs), key=repr)
    assert clean(map(tuple, found.select(*columns).collect())) == clean(want)


# Line dedup


def test_lines_recur_and_generalise(spark):
    body = lambda i: f"own line number word{chr(97 + i)} here alone"
    docs = [(i, f"{body(i)}\nVisited on 2024-01-{i:02d} by {i} users today\nplease share this nice long page with user{'abcdefghijkl'[i]} and your many friends") for i in range(12)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].text == docs[0][1] and out[0].n_dropped == 0
    assert all(out[i].text == body(i) and out[i].n_dropped == 2 for i in range(1, 12))


def test_line_dedup_edges(spark):
    same = "a line that everybody has"
    docs = [(i, same, 1) for i in range(12)] + [(None, same, 1), (12, None, 2), (13, "", 3), (14, "  \n\n", 4), (15, LONG, 5), (3, same, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_lines int")
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].text == same and by[3][0].text == "" and len(by[3]) == 2 and by[None][0].text == ""
    assert (by[12][0].text, by[12][0].n_lines) == (None, 0) and (by[13][0].text, by[13][0].n_lines) == ("", 1)
    assert by[14][0].text == "  \n\n" and by[15][0].text == LONG
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_passages_inside_lines_and_over_lines(spark):
    say = lambda *w: " ".join(w) + "."
    passage = [say(*(f"p{chr(97 + s)}{chr(97 + i)}" for i in range(12))) for s in range(4)]
    own = lambda d, n=9: say(*(f"own{chr(97 + d)}{chr(97 + i)}" for i in range(n)))
    docs = [
        (1, f"{own(1)} {' '.join(passage)} {own(2)}"),  # the first place stays
        (2, f"{own(3)} {passage[0]} {passage[1]} Yes! {passage[2]} {passage[3]} {own(4)}\nlast line"),  # inside a line, with a short sentence in it
        (3, f"{own(5)}\n{passage[0]} {passage[1]}\n\n{passage[2]}\n{own(6)}"),  # over lines
        (4, f"{own(7)} {passage[0]} {passage[1]} {own(8)}"),  # 24 words are no passage
        (5, f"\x01a. {passage[0]} {passage[1]} {passage[2]} {own(9)}\x01"),  # the mark itself in the text
        (None, f"{own(10)} {passage[0]} {passage[1]} {passage[2]} {own(11)}"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[1].text == docs[0][1] and out[1].n_cut == 0 and out[4].text == docs[3][1]
    assert out[2].text == f"{own(3)} {own(4)}\nlast line" and (out[2].n_cut, out[2].n_dropped) == (4, 0)
    assert out[3].text == f"{own(5)}\n\n{own(6)}" and (out[3].n_lines, out[3].n_dropped, out[3].n_cut) == (5, 2, 3)
    assert out[5].text == f"\x01a. {own(9)}\x01" and out[5].n_cut == 3
    assert out[None].text == f"{own(10)} {own(11)}"
    whole = {r.doc_id: r for r in line_dedup.dedup_lines(df, whole=0.5).collect()}
    assert whole[2].text == docs[1][1] and whole[2].n_cut == 0 and whole[None].text == docs[5][1]


def test_line_dedup_of_short_lines(spark):
    docs = [(i, f"own{chr(97 + i)} text\nAll rights reserved.") for i in range(25)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1] and all(out[i] == f"own{chr(97 + i)} text" for i in range(1, 25))


def test_line_dedup_of_many_lines(spark):
    """Twelve texts of 20,000 lines that all recur: a row that carried its text would take 12 x 20,000 x 600 KB."""
    text = "\n".join(f"a line of some words no {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(20_000))
    docs = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    plan = line_dedup._by_line(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate posexplode\(lines#\d+\), \[2\], false", plan)
    out = sorted(line_dedup.dedup_lines(docs).collect())
    assert out[0].text == text and all((r.text, r.n_lines, r.n_dropped) == ("", 20_000, 20_000) for r in out[1:])


@pytest.mark.parametrize("rows", [0, 10**6])
def test_keyed_join_splits_frequent_keys(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        one = many.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("k <> 5")
        found = common.keyed_join(many, one, ["k"], rows, "left", hot_rows=50)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(((7 if v % 2 == 0 else v, v, None if v == 5 else 0 if v % 2 == 0 or v == 7 else v) for v in range(3000)), key=repr)
        if not rows:
            sizes = found.groupBy(F.spark_partition_id()).count().collect()
            assert max(r["count"] for r in sizes) < 1500  # half of the rows have one key
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# Decontamination


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "B", "ß", "É", "x1", "K", "ς"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "!"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 3, 4, 9, 10, 14, 25])] + [(99, None), (None, text(6))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, text(5) + " " + t + " " + text(5)) for i, (_, t) in enumerate(items) if t] + [(200, None), (201, "")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, tuple(w[a : a + min(10, len(w))])) for i, t in items if (w := words(t)) for a in range(len(w) - min(10, len(w)) + 1)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.key: r for r in found.withColumn("hit", decontaminate.hit_words(F.col("spans"))).collect()}
    for key, t in docs:
        w, hit, names = words(t), set(), set()
        for i, window in windows:
            for a in range(len(w) - len(window) + 1):
                if tuple(w[a : a + len(window)]) == window:
                    hit |= {*range(a, a + len(window))}
                    names |= {str(i)} if i is not None else set()
        assert (got[key].n_words, got[key].hit, got[key]["items"]) == (len(w), len(hit), sorted(names)), key


def test_decontaminate_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before, {item.upper()}! after."), (2, "clean"), (3, None), (None, item), (4, LONG + item), (4, LONG + item)], "doc_id long, text string").withColumn("key", F.lit(0))
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [2, 3]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, "spans").collect()}
    assert spans[1] == "before! after." and spans[2] == "clean" and spans[None] == "" and spans[3] is None and spans[4].strip() == LONG.strip()
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 6
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


# Licences


def test_licenses_edges(spark):
    mit = next(t for t in licenses.TEMPLATES if licenses.TEMPLATES[t] == "mit")
    changed = mit.replace("free of charge", "at no charge at all").replace("files", "documents")
    docs = [(1, "Under the MIT License, CC-BY-NC cc by nc"), (2, None), (3, ""), (4, "under the mit"), (5, LONG + mit + " " + LONG), (6, changed), (None, "All Rights Reserved"), (7, "apache license version 2"), (7, "apache license version 2")]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("x"))).collect()
    assert len(rows) == len(docs)
    by = {r.key: r for r in rows}
    assert [(p["at"], p["label"]) for p in by[1].places] == [(0, "mit"), (4, "cc-by-nc"), (7, "cc-by-nc")]
    assert by[2].n_words == by[3].n_words == 0 and not by[4].places and not by[4].spans
    assert [(s["label"], s["score"], s["first"]) for s in by[5].spans] == [("mit", 1.0, 100_000)]
    assert by[6].spans[0]["label"] == "mit" and 0.7 <= by[6].spans[0]["score"] < 1
    assert by[None].spans[0]["label"] == "reserved" and by[7].places[0]["label"] == "apache-2"
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(licenses.scan(df, set_rows=0, list_rows=0)) == rows_of(licenses.scan(df))


def test_licenses_of_short_phrases(spark):
    df = spark.createDataFrame([(1, "cc by nc, mit mit"), (2, "by cc"), (3, "a cc by")], "doc_id long, text string")
    for rows in (0, licenses.SET_ROWS):
        found = {r.key: [(p["at"], p["label"]) for p in r.places] for r in licenses.scan(df, {"cc by": "two", "mit": "one", "cc by nc": "three"}, {}, set_rows=rows).collect()}
        assert found == {1: [(0, "three"), (0, "two"), (3, "one"), (4, "one")], 2: [], 3: [(1, "two")]}


# Urls


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "https://www.Example.NET/en/x?y", "http://example.netx/en/", "http://example.com/de", "http://example.com/de/", "x://a.org/fr/z#t", "http://deep.adnxs.com/a", "http://net/", "http://b.com/" + "p/" * 50_000]
    want = ["allow"] * 5 + ["block", "allow", "allow", "allow", "block", "allow", "block", "block", "allow"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = sorted(urlfilter.filter_urls(df).collect())
    assert [r.verdict for r in rows] == want
    assert [r.rule for r in rows][5:7] == ["net/", "example.net/en/"] and rows[11].listed == "adnxs.com/" and rows[4].host == "a.net"
    assert urlfilter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(df, {}, []).collect()} == {"allow"}


def test_url_index_confirms_strings(tmp_path, monkeypatch):
    """All keys collide: stored strings decide."""
    monkeypatch.setattr(urlfilter, "digest", lambda strings: np.zeros(len(list(strings)), np.uint64))
    path = tmp_path / "index"
    path.write_bytes(urlfilter.build(urlfilter.kinds_of({f"h{i}.com/": "block" for i in range(20)}, [])))
    index = urlfilter.Index(str(path))
    assert index.judge(["h7.com", "x.com"], ["/a", "/"])[:2] == (["h7.com/", None], ["block", "allow"])


def test_urls_of_many_files_and_long_hosts(spark):
    """A list that needs many files, given as entries or as a table, and hosts of more labels than any entry has."""
    blocked = [f"h{i}.example/" for i in range(40)] + ["a.b.c.d.e/x/", "org/"]
    urls = [f"http://www.h{i}.example/a" for i in range(0, 60, 3)] + ["http://z.a.b.c.d.e/x/y", "http://b.c.d.e/x/", "http://" + "l." * 20_000 + "h1.example/", "http://" + "x" * 50_000 + "/", "http://fr.org/fr/", "http://h1.example./", "http://..org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    one = rows_of(urlfilter.filter_urls(df, blocked=blocked))
    assert rows_of(urlfilter.filter_urls(df, blocked=blocked, file_entries=3)) == one
    assert rows_of(urlfilter.filter_urls(df, blocked=spark.createDataFrame([(b,) for b in [*blocked, blocked[0], None]], "entry string"), file_entries=5)) == one
    verdicts = [r.verdict for r in sorted(urlfilter.filter_urls(df, blocked=blocked).collect())]
    assert verdicts == ["block" if i < 40 else "allow" for i in range(0, 60, 3)] + ["block", "allow", "block", "allow", "allow", "allow", "block"]
    index = urlfilter.Index()
    index.labels, index.host = 2, 9
    assert list(index.domains("l." * 10_000 + "h1.org")) == ["org", "h1.org"]


# WARC


def test_loser_tree():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_round_trip_and_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", ((0, 3), (1000, 1)))
    monkeypatch.setattr(warc, "MERGE_ROWS", 6)
    big = "é\r\n\r\nWARC/1.1\r\n" * 200
    pages = [(1, "http://b.com/x", big), (2, "http://a.com/\r\ny", big), (2, "http://a.com/\r\ny", big), (3, None, None), (4, "http://b.com/x", ""), (5, "http://b.com/x", "short"), (6, "http://b.com/x", "short"), (None, "u", big), (7, "http://www.a.com/", "<p>ü</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_digest", F.lit(1)).repartition(3)
    found = warc.archive_and_index(df, path=str(tmp_path / "w")).orderBy("position").collect()
    assert len(found) == len(pages)
    assert sorted((r.key or 0, r.payload_bytes, r.digest) for r in found) == sorted((k or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h in pages)
    kinds = sorted((r.key or 0, r.kind, r.refers_to) for r in found if r.payload_bytes > 1000)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert {r.kind for r in found if r.payload_bytes < 1000} == {"response"}
    assert sorted((r.url or "") for r in found) == sorted((u or "") for _, u, _ in pages)
    order = [(r.urlkey, r.timestamp) for r in found]
    assert order == sorted(order) and ("com,a)/\r\ny" in {o[0] for o in order})
    for r in found:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length).startswith(b"WARC/1.1\r\n")
    assert warc.archive_and_index(df.limit(0)).count() == 0


def test_warc_of_extreme_keys_and_large_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "LIST_ROWS", 0)  # recurring payloads are found by a shuffle
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    big = "x" * 5_000_000
    keys = [-(1 << 63), (1 << 63) - 1, 10**13, 0, -5, 7]
    pages = [(k, "http://a.com/", big if k > 0 else "y" * 2000) for k in keys] + [(k, "http://b.com/", "small") for k in (11, 12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.key: (r.kind, r.refers_to, r.payload_bytes) for r in warc.archive_and_index(df).collect()}
    top, low = (1 << 63) - 1, 0
    assert found == {k: (("response", None) if k in (top, low, 11, 12) else ("revisit", top if k > 0 else low)) + (5 if k in (11, 12) else 5_000_000 if k > 0 else 2000,) for k in [*keys, 11, 12]}
    times = df.withColumn("at", F.timestamp_seconds(F.when(F.col("page_id") == 11, 5).otherwise(0)))
    assert [r.key for r in warc.archive_and_index(times, date="at").where("url = 'http://b.com/'").orderBy("position").collect()] == [12, 11]


# Vectors


def plain_neighbours(vectors, k=20, every=20):
    out = {}
    for q, v in vectors:
        if q % every == 0:
            scored = sorted({(-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in vectors if i != q})
            out[q] = [i for _, i in scored[:k]]
    return out


def test_hnsw_recall(spark, sf):
    rows = hnsw.op9_hnsw(spark, sf.replace("sf0.001", "sf0.01")).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/embeddings.parquet").collect()]
    want = plain_neighbours(vectors)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want) and all([r.rank for r in g] == [*range(1, 21)] for g in got.values())
    assert sum(len({r.vec_id for r in got[q]} & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))
    of = dict(vectors)
    assert all(abs(r.score - np.dot(np.float64(of[q]), np.float64(of[r.vec_id]))) < 1e-12 for q, g in got.items() for r in g)


def test_hnsw_one_large_shard_with_norms_and_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) * rng.lognormal(size=(3000, 1))
    x[1000:2000] = x[999]
    vectors = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    rows = hnsw.neighbours(df, shards=1).collect()
    want = plain_neighbours(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_hnsw_blocks_shards_and_ties(spark, monkeypatch):
    """Queries in many blocks, shards by bytes, scores that tie, and clusters that no link would join by nearness alone."""
    monkeypatch.setattr(hnsw, "PACK_BYTES", 8 * 8 * 3)
    grid = [(i, [float(i % 5 == j) for j in range(8)]) for i in range(200)]  # five vectors, 40 copies of each
    df = spark.createDataFrame(grid, "vec_id long, embedding array<double>")
    rows = hnsw.neighbours(df, k=5, query_bytes=500, shard_bytes=2000, shards=2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i in range(0, 200, 5) if i != q][:5] for q in range(0, 200, 20)}
    rng = np.random.default_rng(3)
    far = [(i, (1000 * (i % 7 == 0) + rng.normal(size=6)).tolist()) for i in range(700)]
    rows = hnsw.neighbours(spark.createDataFrame(far, "vec_id long, embedding array<double>"), shards=1).collect()
    want, found = plain_neighbours(far), {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found[q] & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_hnsw_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, [-1.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x"))
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.neighbours(df).collect())
    assert rows == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 40, -1.0), (40, 1, 1, -0.5), (40, 2, 2, -0.5), (40, 3, 0, -1.0)]
    assert hnsw.neighbours(df.limit(0)).count() == 0


# Grades


def test_quality_tells_grades(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    learned = labels.where("doc_id % 5 <> 0")
    model = quality.fit(docs, quality.grades_of(learned))
    held = quality.grades_of(labels.where("doc_id % 5 = 0")).join(quality.score(docs, model), "doc_id").groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("e")).collect()
    held = {r.grade: r for r in held}
    assert held[0].kept < 0.1 and held[1].kept < 0.15 and held[2].kept > 0.9
    assert held[0].e < held[1].e < held[2].e
    assert all(model.cuts[:-1] <= model.cuts[1:])


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, LONG), (None, "x"), (4, "a b")], "doc_id long, text string").withColumn("keep", F.lit("k"))
    none = quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, grade int"))).collect()
    assert all(r.keep and r.expected_grade is None for r in none)
    one = quality.fit(docs, spark.createDataFrame([(1, 2), (2, 2), (None, 0), (3, None)], "doc_id long, grade int"))
    assert {r.expected_grade for r in quality.score(docs, one).collect()} == {2.0}
    two = quality.fit(docs, spark.createDataFrame([(1, 0), (1, 2), (3, 2), (4, 2)], "doc_id long, grade int"))
    rows = quality.score(docs, two).collect()
    assert len(rows) == 5 and all(0 <= r.p_best <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert quality.score(docs.limit(0), two).count() == 0


def test_quality_likelihood_slopes():
    """The slopes are those of the likelihood, by differences; and a fit is at least as likely as its neighbours."""
    rng = np.random.default_rng(4)
    score, cuts, y, weight = rng.normal(size=30), np.array([-0.7, 0.4, 1.5]), rng.integers(0, 4, 30), rng.uniform(0.5, 2, 30)
    plain = lambda s, c: -sum(w * np.log((1 / (1 + np.exp(-(x - c[g - 1]))) if g else 1) - (1 / (1 + np.exp(-(x - c[g]))) if g < 3 else 0)) for x, g, w in zip(s, y, weight, strict=True))
    loss, ds, dc = quality.likelihood(score, cuts, y, weight)
    assert abs(loss - plain(score, cuts)) < 1e-9
    step = lambda n, i: 1e-6 * (np.arange(n) == i)
    assert all(abs((plain(score + step(30, i), cuts) - plain(score - step(30, i), cuts)) / 2e-6 - ds[i]) < 1e-5 for i in range(30))
    assert all(abs((plain(score, cuts + step(3, i)) - plain(score, cuts - step(3, i))) / 2e-6 - dc[i]) < 1e-5 for i in range(3))


def test_quality_bounded_features(spark):
    docs = spark.createDataFrame([(i, f"good{i} words here" if i % 2 else f"BAD{i} !!!! junk 999") for i in range(40)], "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    whole, few = quality.fit(docs, grades), quality.fit(docs, grades, most=100)
    assert np.count_nonzero(few.weights) < np.count_nonzero(whole.weights)
    assert quality.fit(docs, grades, most=1) is not None
    rows = quality.score(docs.withColumns({"expected_grade": F.lit("x"), "p_best": F.lit("y")}), whole).collect()
    assert all((r.expected_grade > 0.5) == (r.doc_id % 2 == 1) for r in rows)


def test_quality_reads_whole_shapes():
    """Tokens that differ after their shape's first twelve signs only have different features."""
    a, b = (set(quality.features(f"a1b2c3d4e5f6g7h8{x}").tolist()) for x in ("i", "9"))
    assert len(a - b) >= 2
