"""Line dedup with a log-template tree of fixed depth, in DataFrame operations only.

Lines. A line's tokens that hold a digit are variable fields (`<*>`). The tree's first level is the number of tokens, the
next DEPTH levels are the leading tokens; what reaches the same leaf shares a candidate template: at each position the
token that at least half of the leaf's lines have (weighted by documents; of equally frequent tokens the smallest), or
else `<*>`. A line of at least GENERAL tokens that equals the leaf's constants in SIMILAR of its positions belongs to that
template; any other line is a template of its own, up to its variable fields. Templates that recur in MIN_DOCS documents
or more are dropped, but for the template's first place (smallest key, then line number), so that nothing that was there
is lost altogether. Lines of fewer than MIN_TOKENS tokens must recur in SHORT_SHARE of the rows and 2 * MIN_DOCS
documents, as a few words may be the same by chance.

Passages. What recurs inside longer lines, or over several lines, is found by sentences, which end after `. `, `! ` or
`? ` and with the line. A sentence of UNIT words or more that stands just as it is in two documents recurs, but for its
first place. Recurring sentences follow each other if at most GAP other ones stand between them (over a line's end: if at
most one line does, and at most GAP sentences of the two lines). A chain of PASSAGE words or more is a passage: its
sentences are cut, and so are those of fewer than UNIT words inside it; a line of which nothing is left goes. Words, here,
are what single spaces separate.

All counts are aggregated partially before they are shuffled, documents per template in two steps, and lists that are too
long to broadcast are joined with their frequent keys split, so a line that stands in a third of all documents is never
gathered in one task; only numbers and hashes of lines are shuffled, and the tokens of leaves that recur.

Rows: a null text stays null and has no lines; an empty text is one line without tokens; lines without tokens are kept;
rows that repeat a key count as one document and lose the same lines; rows with a null key lose recurring lines but count
as no document; texts of any length and any number of lines are handled whole; an empty table gives an empty one; other
columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_join, short, table, written

DEPTH, MIN_TOKENS, GENERAL, SIMILAR, MIN_DOCS = 3, 4, 8, 0.7, 10
#: Share of the rows in which a line of fewer than MIN_TOKENS tokens recurs.
SHORT_SHARE = 0.002
#: Words of a sentence that counts and of a passage, and other sentences between two of a passage.
UNIT, PASSAGE, GAP = 8, 30, 2
#: Rows of some 60 bytes up to which a list of leaves, lines or templates is broadcast: 20 MB.
LIST_ROWS = 300_000
#: The same for templates with their fields, of 1 KB or so.
TEMPLATE_ROWS = 20_000
#: Fixed value: ASCII white space.
SPACE = r"[\x09-\x0D\x20]+"
FIELD = r"[^\x09-\x0D\x200-9]*+[0-9][^\x09-\x0D\x20]*+"
VARIABLE = "<*>"
ENDS = (". ", "! ", "? ")
MARK = "\x01"


def _spaced(line: Column) -> Column:
    """The line's tokens with one space between them. Most lines are like that already, which is cheap to see."""
    other = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\x0b\x0c\r":
        other = other | line.contains(c)
    return F.when(other, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def _words(c: Column) -> Column:
    """Single spaces, and one."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, at, line). Only the split text is exploded: a row that carried the whole text to each of its lines
    would take memory by the square of the lines."""
    split = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.split(text, "\n").alias("lines"))
    return split.select("key", "print", F.posexplode("lines").alias("at", "line"))


def _by_line(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line with a token: the document, the line's number from 0, its place in the tree (leaf and n), its
    own hash and its text with the variable fields masked and single spaces."""
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", FIELD, F.lit(VARIABLE))).otherwise(F.col("line"))
    lines = _lines(docs, key, text).where(F.col("line").rlike(r"[^\x09-\x0D\x20]"))
    lines = lines.select("key", "print", "at", masked.alias("masked")).select("key", "print", "at", _spaced(F.col("masked")).alias("masked")).withColumn("n", _words(F.col("masked")))
    leaf = F.xxhash64("n", F.substring_index("masked", " ", DEPTH))
    return lines.select("key", "print", "at", "n", leaf.alias("leaf"), F.xxhash64("masked").alias("own"), "masked")


def _documents(lines: DataFrame, *by: str) -> DataFrame:
    """Documents that have each template, its first place, and its lines (n_lines)."""
    each = lines.groupBy(*by, "key").agg(F.min("at").alias("at"), F.count("*").alias("n_lines"))
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "at"))
    return each.groupBy(*by).agg(F.count("key").alias("docs"), first.alias("first"), F.sum("n_lines").alias("n_lines"))


def _members(lines: DataFrame, similar: float, min_docs: int) -> DataFrame:
    """(leaf, n, own, n_lines) of the lines that belong to their leaf's template."""
    counted = _documents(lines.where(F.col("n") >= GENERAL), "leaf", "n", "own").drop("first")
    leaves = counted.groupBy("leaf", "n").agg(F.sum("docs").alias("weight"), F.count("*").alias("kinds"), F.sum("n_lines").alias("n_lines"))
    leaves = written(leaves.where((F.col("kinds") > 1) & (F.col("weight") >= min_docs)).drop("kinds"), "leaves")
    kinds = keyed_join(counted, leaves.select("leaf", "n", "weight", "n_lines").withColumnRenamed("n_lines", "of"), ["leaf", "n"], LIST_ROWS, n="of")
    texts = keyed_join(lines.select("leaf", "n", "own", "masked"), leaves.select("leaf", "n", "n_lines"), ["leaf", "n"], LIST_ROWS, n="n_lines").groupBy("leaf", "n", "own").agg(F.min("masked").alias("masked"))
    kinds = written(kinds.join(texts, ["leaf", "n", "own"]).select("leaf", "n", "own", "docs", "weight", "n_lines", F.split("masked", " ").alias("tokens")), "kinds")
    places = kinds.select("leaf", "n", "docs", "weight", F.posexplode("tokens").alias("p", "token"))
    votes = places.groupBy("leaf", "n", "p", "token").agg(F.sum("docs").alias("votes"), F.first("weight").alias("weight"), F.count("*").alias("of"))
    top = votes.groupBy("leaf", "n", "p").agg(F.min(F.struct((-F.col("votes")).alias("less"), "token")).alias("top"), F.first("weight").alias("weight"), F.sum("of").alias("of"))
    constant = F.when(-2 * F.col("top.less") >= F.col("weight"), F.col("top.token"))
    template = top.select("leaf", "n", "of", F.struct("p", constant.alias("token")).alias("field")).groupBy("leaf", "n").agg(F.array_sort(F.collect_list("field")).alias("fields"), F.max("of").alias("of"))
    same = F.size(F.filter(F.zip_with("tokens", "fields", lambda t, f: t == f["token"]), lambda x: x))
    found = keyed_join(kinds, written(template, "fields"), ["leaf", "n"], TEMPLATE_ROWS, n="of")
    return found.where(same >= F.col("n") * similar).select("leaf", "n", "own", "n_lines", F.lit(True).alias("member"))


def recurring(lines: DataFrame, similar: float, min_docs: int, short_docs: int) -> DataFrame:
    """The lines to drop: key, print and at. short_docs: documents for a template of fewer than MIN_TOKENS tokens."""
    least = F.when(F.col("n") < MIN_TOKENS, F.lit(short_docs)).otherwise(F.lit(min_docs))
    members = written(_members(lines, similar, min_docs), "members")
    lines = keyed_join(lines.drop("masked"), members, ["leaf", "n", "own"], LIST_ROWS, "left", n="n_lines")
    lines = lines.select("key", "print", "at", "leaf", "n", F.when(F.col("member"), F.lit(0).cast("bigint")).otherwise(F.col("own")).alias("own"))
    templates = written(_documents(lines, "leaf", "n", "own").where(F.col("docs") >= least), "templates")
    first = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("at") == F.col("first.at"))
    return keyed_join(lines, templates, ["leaf", "n", "own"], LIST_ROWS, n="n_lines").where(~first).select("key", "print", "at")


def _sentences(line: Column) -> Column:
    """The line cut after its sentences; joined, they give it back."""
    marked = line
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    # A line that has the mark itself is cut by a pattern, to the same places.
    return F.when(line.contains(MARK), F.split(line, r"(?<=[.!?] )")).otherwise(F.split(marked, MARK))


def _units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each sentence of UNIT words or more: the document, the numbers of the line and of the sentence in it,
    the line's sentences, the sentence's words and its hash."""
    lines = _lines(docs, key, text).where(_words(F.col("line")) >= UNIT).select("key", "print", "at", _sentences(F.col("line")).alias("sentences"))
    units = lines.select("key", "print", "at", F.size("sentences").alias("of"), F.posexplode("sentences").alias("s", "unit")).withColumn("unit", F.trim("unit"))
    units = units.select("key", "print", "at", "s", "of", _words(F.col("unit")).alias("words"), "unit").where(F.col("words") >= UNIT)
    return units.select("key", "print", "at", "s", "of", "words", F.xxhash64("unit").alias("exact"))


def passages(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Sentences to cut: key, print, at, cut (the sorted numbers of the line's sentences) and words (of these)."""
    units = written(_units(docs, key, text), "units")
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "at", "s")
    found = units.groupBy("exact").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min(place).alias("first"), F.count("*").alias("n"))
    found = written(found.where("low <> high").select("exact", "first", "n"), "repeated")
    first = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("at") == F.col("first.at")) & (F.col("s") == F.col("first.s"))
    again = keyed_join(units, found, ["exact"], LIST_ROWS).where(~first).select("key", "print", "at", "s", "of", "words").distinct()
    by = Window.partitionBy("key", "print").orderBy("at", "s")
    last = lambda c: F.lag(c).over(by)
    other = F.when(F.col("at") == last("at"), F.col("s") - last("s") - 1).when(F.col("at") - last("at") <= 2, last("of") - last("s") - 1 + F.col("s"))
    chain = F.sum(F.when(other <= GAP, 0).otherwise(1)).over(by)
    chained = again.withColumn("chain", chain).withColumn("whole", F.sum("words").over(Window.partitionBy("key", "print", "chain"))).where(F.col("whole") >= least)
    return chained.groupBy("key", "print", "at").agg(F.array_sort(F.collect_list("s")).alias("cut"), F.sum("words").alias("words"))


def _dense(items: Column, at, value, none: Column, between=None) -> Column:
    """A sorted array of rare places as an array with an element for each place up to the last one."""

    def one(x: Column, i: Column) -> Column:
        gap = at(x) - F.when(i == 0, F.lit(-1)).otherwise(at(F.get(items, i - 1))) - 1
        filler = none if between is None else F.when((i > 0) & (gap <= GAP), between).otherwise(none)
        return F.concat(F.array_repeat(filler, gap), F.array(value(x)))

    return F.flatten(F.transform(items, one))


def _cut_line(line: Column, cut: Column) -> Column:
    """The line without the sentences in cut, and the short ones between two of a passage; null if nothing is left."""
    none = F.lit(None).cast("int")
    marks = _dense(cut, lambda x: x, lambda _: F.lit(1), none, F.lit(2))
    kept = F.zip_with(_sentences(line), marks, lambda s, m: F.when((m == 1) | (m == 2) & (_words(F.trim(s)) < UNIT), F.lit(None).cast("string")).otherwise(s))
    left = F.array_join(F.filter(kept, lambda s: s.isNotNull()), "")
    return F.when(F.trim(left) != "", left)


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, min_docs: int = MIN_DOCS, short_share: float = SHORT_SHARE, passage: int = PASSAGE, whole: float | None = None,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped", n_cut: str = "n_cut",
) -> DataFrame:
    """docs with recurring lines and passages dropped from the text, and the numbers of its lines, of the lines that went
    and of the sentences cut as parts of passages (long), which replace columns of these names. whole: documents with at
    least that share of their words in passages keep these, to be told as copies by other means."""
    docs = docs.drop(n_lines, n_dropped, n_cut)
    lines = written(_by_line(docs, key, text), "lines")
    drop = recurring(lines, similar, min_docs, max(2 * min_docs, math.ceil(short_share * docs.count())))
    cuts = passages(docs, key, text, passage)
    both = drop.select("key", "print", "at", F.lit(None).cast("struct<at:int,cut:array<int>>").alias("cut"), F.lit(0).cast("bigint").alias("words"))
    both = both.unionByName(cuts.select("key", "print", F.lit(None).cast("int").alias("at"), F.struct("at", "cut").alias("cut"), F.col("words").cast("bigint").alias("words")))
    lost = both.groupBy("key", "print").agg(F.array_sort(F.collect_set("at")).alias("_drop"), F.array_sort(F.collect_list("cut")).alias("_cut"), F.sum("words").alias("_words"))
    lost = lost.withColumnsRenamed({"key": "_key", "print": "_print"})
    same = docs[key].eqNullSafe(F.col("_key")) & (F.xxhash64(docs[text]) == F.col("_print"))
    both = docs.join(lost, same, "left")
    if whole is not None:
        words = _words(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))
        both = both.withColumn("_cut", F.when(F.col("_words") < words * whole, F.col("_cut")).otherwise(F.array().cast("array<struct<at:int,cut:array<int>>>")))
    parts = F.split(F.col(text), "\n")
    dropped = _dense(F.col("_drop"), lambda x: x, lambda _: F.lit(True), F.lit(None).cast("boolean"))
    cut = _dense(F.col("_cut"), lambda x: x["at"], lambda x: x["cut"], F.lit(None).cast("array<int>"))
    left = F.zip_with(parts, dropped, lambda x, d: F.when(d.isNull(), x))
    left = F.zip_with(left, cut, lambda x, c: F.when(c.isNotNull() & x.isNotNull(), _cut_line(x, c)).otherwise(x))
    left = F.when(F.col("_drop").isNotNull(), F.filter(left, lambda x: x.isNotNull()))
    both = both.withColumns({"_left": left, "_parts": F.size(parts)})
    out = [F.when(F.col("_left").isNotNull(), F.array_join("_left", "\n")).otherwise(F.col(text)).alias(c) if c == text else docs[c] for c in docs.columns]
    n = F.coalesce(F.col("_parts"), F.lit(0)).cast("bigint")
    sentences = F.aggregate("_cut", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["cut"]))
    gone = F.coalesce(F.col("_parts") - F.size("_left"), F.lit(0)).cast("bigint")
    return both.select(*out, n.alias(n_lines), gone.alias(n_dropped), F.coalesce(sentences, F.lit(0)).cast("bigint").alias(n_cut))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL_WORDS = "strlen({0}) - strlen(replace({0}, ' ', '')) + 1"
OP6_SQL = rf"""
with rows as (select row_number() over () as row_id, doc_id, text from documents),
lines as (select row_id, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as ln from rows),
cut as (
  select row_id, doc_id, ln, list_transform(list_filter(string_split_regex(line, '[\x09-\x0D\x20]+'), lambda t: t <> ''), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as tokens from lines),
l as (select row_id, doc_id, ln, tokens, len(tokens) as n, list_slice(tokens, 1, {DEPTH}) as leaf, array_to_string(tokens, ' ') as own from cut where len(tokens) > 0),
counted as (select leaf, n, own, any_value(tokens) as tokens, count(distinct doc_id) as docs from l where n >= {GENERAL} group by leaf, n, own),
leaves as (select leaf, n, sum(docs) as weight from counted group by leaf, n having count(*) > 1 and sum(docs) >= {MIN_DOCS}),
kinds as (select counted.leaf, counted.n, own, tokens, docs, weight from counted join leaves on counted.leaf = leaves.leaf and counted.n = leaves.n),
places as (select leaf, n, own, docs, weight, unnest(tokens) as token, unnest(range(n)) as p from kinds),
votes as (select leaf, n, p, token, weight, sum(docs) as votes from places group by leaf, n, p, token, weight),
tops as (select leaf, n, p, token from (select *, row_number() over (partition by leaf, n, p order by votes desc, token) as k from votes) where k = 1 and 2 * votes >= weight),
members as (
  select places.leaf, places.n, own from places join tops on places.leaf = tops.leaf and places.n = tops.n and places.p = tops.p and places.token = tops.token
  group by places.leaf, places.n, own having count(*) >= places.n * {SIMILAR}),
t as (select l.row_id, l.doc_id, l.ln, l.leaf, l.n, case when members.own is null then l.own end as own from l left join members on l.leaf = members.leaf and l.n = members.n and l.own = members.own),
places_of as (select *, min(ln) over (partition by leaf, n, own, doc_id) as first_ln from t),
templates as (
  select leaf, n, own, count(distinct doc_id) as docs, min(doc_id) as first_doc from places_of group by leaf, n, own
  having count(distinct doc_id) >= case when n < {MIN_TOKENS} then greatest({2 * MIN_DOCS}, ceil({SHORT_SHARE} * (select count(*) from rows))) else {MIN_DOCS} end),
dropped as (
  select row_id, ln from places_of p join templates x on p.leaf = x.leaf and p.n = x.n and p.own is not distinct from x.own
  where not (p.doc_id is not distinct from x.first_doc and p.ln = p.first_ln)),
pieces as (
  select row_id, doc_id, ln, string_split(replace(replace(replace(line, '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(1)) as pieces from lines),
sentences as (select row_id, doc_id, ln, len(pieces) as "of", unnest(range(len(pieces))) as s, unnest(pieces) as sentence from pieces),
units as (select *, trim(sentence, ' ') as unit, {_SQL_WORDS.format("trim(sentence, ' ')")} as words from sentences),
repeated as (select unit, min((doc_id, ln, s)) filter (where doc_id is not null) as first from units where words >= {UNIT} group by unit having count(distinct doc_id) > 1),
again as (select row_id, ln, s, "of", words from units join repeated using (unit) where words >= {UNIT} and not ((doc_id, ln, s) is not distinct from first)),
near as (
  select *, case when ln = lag(ln) over w then s - lag(s) over w - 1 when ln - lag(ln) over w <= 2 then lag("of") over w - lag(s) over w - 1 + s end as other
  from again window w as (partition by row_id order by ln, s)),
chains as (select *, sum(case when other <= {GAP} then 0 else 1 end) over (partition by row_id order by ln, s) as chain from near),
passages as (select row_id, ln, s from (select *, sum(words) over (partition by row_id, chain) as whole from chains) where whole >= {PASSAGE}),
gaps as (select row_id, ln, s, lag(s) over (partition by row_id, ln order by s) as before from passages),
taken as (
  select row_id, ln, s from passages
  union select u.row_id, u.ln, u.s from gaps g join units u on u.row_id = g.row_id and u.ln = g.ln and u.s > g.before and u.s < g.s where g.s - g.before - 1 <= {GAP} and u.words < {UNIT}),
after as (
  select u.row_id, u.ln, string_agg(sentence, '' order by u.s) filter (where t.s is null) as line, count(t.s) as n_taken
  from units u left join taken t on u.row_id = t.row_id and u.ln = t.ln and u.s = t.s group by u.row_id, u.ln),
final as (select a.row_id, a.ln, a.line, d.ln is not null or (n_taken > 0 and trim(coalesce(a.line, ''), ' ') = '') as gone from after a left join (select distinct row_id, ln from dropped) d on a.row_id = d.row_id and a.ln = d.ln),
kept as (select row_id, string_agg(line, chr(10) order by ln) filter (where not gone) as text, count(*) as n_lines, count(*) filter (where gone) as n_dropped from final group by row_id),
n_cuts as (select row_id, count(*) as n_cut from passages group by row_id)
select doc_id, case when rows.text is not null then coalesce(kept.text, '') end as text, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dropped, 0) as bigint) as n_dropped, cast(coalesce(n_cut, 0) as bigint) as n_cut
from rows left join kept using (row_id) left join n_cuts using (row_id)
"""
