"""Relabelling bound to the test tables: orders are albums, their lines files and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import dedupe, relabel
from siftline.plans.registry import query, table

# A file's number decides what is heard of it: mostly its own track, else another of the album, a title, two tracks, none of them, or nothing.
_BASE = """l AS (SELECT l_orderkey AS album, l_linenumber AS n, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_quantity) AS q FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
tracks AS (SELECT album, 't' || n AS track, 'song number ' || (n % 4) AS title, CASE WHEN part % 13 > 0 THEN 100 + 4.0 * (n + part % 5) END AS length FROM l WHERE n <= 5),
files AS (SELECT album, 'f' || n AS file, CASE WHEN n <= 5 AND part % 11 > 0 THEN 't' || n END AS track, n > 4 AS extra,
  CASE part % 8 WHEN 0 THEN ['t' || (n % 5 + 1)] WHEN 1 THEN ['t' || n, 't' || (n % 5 + 1)] WHEN 2 THEN [] WHEN 3 THEN ['t' || (n % 5 + 1), 't' || ((n + 1) % 5 + 1)] WHEN 4 THEN ['x'] WHEN 5 THEN ['t' || ((n + supp) % 5 + 1)] WHEN 6 THEN [] ELSE ['t' || n] END AS heard,
  CASE part % 8 WHEN 2 THEN ['song number ' || (supp % 4)] WHEN 4 THEN ['other tune'] ELSE CAST([] AS VARCHAR[]) END AS titles, 'song number ' || (n % 4) AS title, supp % 3 = 0 AS confirmed, 100 + 4.0 * (n + part % 5) + q % 9 - CASE WHEN supp % 4 = 0 THEN 20 ELSE 0 END AS seconds, part % 17 = 0 AS forced, n = 6 AND part % 3 = 0 AS displaced FROM l)"""

_AGREE = "(({0} = {1}) OR (least(length({0}), length({1})) >= 8 AND (starts_with({0}, {1}) OR starts_with({1}, {0}))))"


def _fits(name: str, titles: str) -> str:
    return f"""{name}1 AS (SELECT DISTINCT f.album, f.file, t.track, t.length FROM (SELECT album, file, unnest(heard) AS id FROM files) f JOIN tracks t ON t.album = f.album AND t.track = f.id),
{name}2 AS (SELECT DISTINCT f.album, f.file, t.track, t.length FROM (SELECT album, file, unnest({titles}) AS answer FROM files WHERE (album, file) NOT IN (SELECT (album, file) FROM {name}1)) f JOIN tracks t ON t.album = f.album WHERE {_AGREE.format('t.title', 'f.answer')}),
{name} AS (SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2)"""


_EVIDENCE = "CASE WHEN len(titles) > 0 THEN titles WHEN confirmed THEN [title] ELSE CAST([] AS VARCHAR[]) END"
_ASSIGNED = f"""{_BASE}, {_fits('a', 'titles')},
own AS (SELECT f.*, t.track AS holds, t.length AS held_length FROM files f LEFT JOIN tracks t ON t.album = f.album AND t.track = f.track WHERE NOT extra),
facts AS (SELECT o.album, o.file, count(a.track) AS n, coalesce(bool_or(a.track = holds), false) AS fit, min(a.track) AS sole, count(*) FILTER (abs(seconds - a.length) <= 3) AS near, count(*) FILTER (abs(seconds - a.length) > 6) AS far, count(a.length) AS known, min(a.track) FILTER (abs(seconds - a.length) <= 3) AS nearest FROM own o LEFT JOIN a ON a.album = o.album AND a.file = o.file GROUP BY 1, 2),
s1 AS (SELECT o.*, x.n, sole, nearest, CASE WHEN fit THEN 'stays' WHEN x.n = 1 OR (x.n > 0 AND known = x.n AND near = 1 AND far = x.n - 1 AND seconds > 0) THEN 'moves' WHEN len(heard) = 0 AND len(titles) = 0 THEN 'stays' WHEN x.n = 0 AND holds IS NOT NULL THEN 'foreign' ELSE 'unclear' END AS st FROM own o JOIN facts x USING (album, file)),
s2 AS (SELECT *, CASE st WHEN 'moves' THEN CASE WHEN n = 1 THEN sole ELSE nearest END WHEN 'stays' THEN holds END AS goal FROM s1),
s AS (SELECT s2.* EXCLUDE (st, goal), CASE WHEN st = 'moves' AND holds IS NOT NULL AND (album, goal) IN (SELECT (album, goal) FROM s2 WHERE st = 'stays' AND goal IS NOT NULL) THEN 'foreign' ELSE st END AS state, CASE WHEN st = 'moves' AND holds IS NOT NULL AND (album, goal) IN (SELECT (album, goal) FROM s2 WHERE st = 'stays' AND goal IS NOT NULL) THEN NULL ELSE goal END AS "to" FROM s2)"""
_PLAN = f"""{_ASSIGNED}, {_fits('e', _EVIDENCE)},
claimed AS (SELECT DISTINCT album, "to" AS track FROM s WHERE state = 'moves'),
holders AS (SELECT album, holds AS track, arg_max(file, file) AS holder, arg_max(seconds, file) AS hs, arg_max(state, file) AS hstate FROM s WHERE holds IS NOT NULL GROUP BY 1, 2),
x1 AS (SELECT f.album, f.file, f.forced, f.seconds, min(e.track) AS track, min(e.length) AS length FROM files f JOIN e ON e.album = f.album AND e.file = f.file WHERE extra AND (forced OR NOT displaced) GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
p0 AS (SELECT x1.album, x1.file, x1.track, forced, holder, length, e.track IS NOT NULL AS hf, abs(x1.seconds - length) AS mine, abs(hs - x1.length) AS theirs FROM x1 JOIN holders h ON h.album = x1.album AND h.track = x1.track LEFT JOIN (SELECT album, file, track FROM e) e ON e.album = x1.album AND e.file = holder AND e.track = x1.track WHERE hstate NOT IN ('moves', 'foreign')),
promoted AS (SELECT album, file, track, holder AS replaces FROM p0 WHERE CASE WHEN forced THEN true WHEN length IS NULL THEN NOT hf WHEN hf THEN mine + 3 < theirs ELSE mine <= theirs + 3 END),
f0 AS (SELECT album, file, holds AS track, CASE WHEN (album, holds) IN (SELECT (album, track) FROM claimed) THEN 'demoted' WHEN abs(seconds - held_length) > 10 THEN 'vacates' WHEN (album, holds) IN (SELECT (album, track) FROM x1) THEN 'asked' ELSE 'stuck' END AS st FROM s WHERE state = 'foreign'),
vacant AS (SELECT album, track FROM holders WHERE hstate = 'moves' AND (album, track) NOT IN (SELECT (album, track) FROM claimed) UNION SELECT album, track FROM f0 WHERE st IN ('vacates', 'asked')),
takers AS (SELECT v.album, v.track, count(x1.file) AS n, min(x1.file) AS file FROM vacant v LEFT JOIN x1 ON x1.album = v.album AND x1.track = v.track AND (x1.forced OR abs(x1.seconds - x1.length) <= 10) GROUP BY 1, 2),
filled AS (SELECT t.album, t.file, t.track, CASE WHEN hstate = 'foreign' THEN holder END AS replaces FROM takers t LEFT JOIN holders h ON h.album = t.album AND h.track = t.track WHERE n = 1),
short AS (SELECT t.album, h.holder AS file FROM takers t JOIN holders h ON h.album = t.album AND h.track = t.track WHERE n = 0 AND (t.album, h.holder) IN (SELECT (album, file) FROM f0 WHERE st = 'asked')),
demoted AS (SELECT album, file, track FROM f0 WHERE st <> 'stuck' AND (album, file) NOT IN (SELECT (album, file) FROM short) AND (album, file) NOT IN (SELECT (album, replaces) FROM filled WHERE replaces IS NOT NULL)),
changes AS (SELECT album, file, "to" AS track, 'moves' AS change, CAST(NULL AS VARCHAR) AS replaces FROM s WHERE state = 'moves' UNION ALL SELECT album, file, track, 'promoted', replaces FROM promoted UNION ALL SELECT album, file, track, 'fills', replaces FROM filled UNION ALL SELECT album, file, track, 'demoted', NULL FROM demoted),
problems AS (SELECT album, file, 'unclear' AS problem, false AS stays FROM s WHERE state = 'unclear'
  UNION ALL SELECT s.album, file, 'length', false FROM s JOIN tracks t ON t.album = s.album AND t.track = s."to" WHERE state = 'moves' AND holds IS NOT NULL AND abs(t.length - held_length) > 3 AND abs(seconds - t.length) >= abs(seconds - held_length)
  UNION ALL SELECT DISTINCT album, CAST(NULL AS VARCHAR), 'two_files', false FROM s WHERE state IN ('stays', 'moves') AND "to" IS NOT NULL GROUP BY album, "to" HAVING count(*) > 1
  UNION ALL SELECT DISTINCT album, NULL, 'two_extras', false FROM promoted GROUP BY album, track HAVING count(*) > 1
  UNION ALL SELECT album, file, 'not_an_extra', false FROM files WHERE forced AND NOT extra
  UNION ALL SELECT album, file, 'forced_unclear', false FROM files WHERE forced AND extra AND (album, file) NOT IN (SELECT (album, file) FROM x1)
  UNION ALL SELECT album, file, 'foreign_fits', true FROM f0 WHERE st = 'stuck' UNION ALL SELECT DISTINCT album, NULL, 'several_extras', false FROM takers WHERE n > 1 UNION ALL SELECT album, file, 'extra_length', false FROM short)"""


def _files(spark, sf):
    l = table(spark, sf, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("album"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_quantity").alias("q"))
    l = dedupe.written(l, "lines")  # a plan reads its files and tracks a dozen times: lines are read and grouped once
    n, part, supp, t = F.col("n"), F.col("part"), F.col("supp"), lambda x: F.concat(F.lit("t"), x.cast("int").cast("string"))
    length, song = 100 + 4.0 * (n + part % 5), lambda x: F.concat(F.lit("song number "), (x % 4).cast("string"))
    tracks = l.where("n <= 5").select("album", t(n).alias("track"), song(n).alias("title"), F.when(part % 13 > 0, length).alias("length"))
    none = F.array().cast("array<string>")
    heard = F.when(part % 8 == 0, F.array(t(n % 5 + 1))).when(part % 8 == 1, F.array(t(n), t(n % 5 + 1))).when((part % 8).isin(2, 6), none).when(part % 8 == 3, F.array(t(n % 5 + 1), t((n + 1) % 5 + 1))).when(part % 8 == 4, F.array(F.lit("x"))).when(part % 8 == 5, F.array(t((n + supp) % 5 + 1))).otherwise(F.array(t(n)))
    titles = F.when(part % 8 == 2, F.array(song(supp))).when(part % 8 == 4, F.array(F.lit("other tune"))).otherwise(none)
    seconds = length + F.col("q") % 9 - F.when(supp % 4 == 0, 20).otherwise(0)
    files = l.select("album", F.concat(F.lit("f"), n.cast("string")).alias("file"), F.when((n <= 5) & (part % 11 > 0), t(n)).alias("track"), (n > 4).alias("extra"), heard.alias("heard"), titles.alias("titles"), song(n).alias("title"), (supp % 3 == 0).alias("confirmed"), seconds.alias("seconds"), (part % 17 == 0).alias("forced"), ((n == 6) & (part % 3 == 0)).alias("displaced"))
    return files, tracks


@query(f'WITH {_ASSIGNED} SELECT album, file, holds, state, "to" FROM s')
def track_assignment(spark, sf):
    """DOM-43, DOM-44, JOIN-18: which track each file belongs to."""
    files, tracks = _files(spark, sf)
    return relabel.assigned(files.where("not extra"), tracks).select("album", "file", "holds", "state", "to")


@query(f"WITH {_PLAN} SELECT * FROM changes")
def relabel_changes(spark, sf):
    """DOM-43, DOM-45, DOM-77: files that move, extras that are promoted or fill tracks, files that come off theirs."""
    return relabel.Plan(*_files(spark, sf)).changes()


@query(f"WITH {_PLAN} SELECT album, file, problem, stays FROM problems")
def relabel_problems(spark, sf):
    """DOM-46: what speaks against a plan."""
    return relabel.Plan(*_files(spark, sf)).problems


@query(f"""WITH {_PLAN}, k AS (SELECT album, count(*) AS changes, count(*) FILTER (change = 'moves') AS m, count(*) FILTER (change = 'promoted') AS p, count(*) FILTER (change IN ('fills', 'demoted')) AS o FROM changes GROUP BY 1), b AS (SELECT album, count(*) AS problems, count(*) FILTER (NOT stays) AS blocking FROM problems GROUP BY 1)
SELECT album, changes, coalesce(problems, 0) AS problems, coalesce(blocking, 0) AS blocking, CASE WHEN album % 3 > 0 AND p = 0 THEN 'nothing' WHEN coalesce(problems, 0) > 0 OR o > 0 THEN 'noted' WHEN m > 0 THEN 'relabelled' ELSE 'noted' END AS after_import FROM k LEFT JOIN b USING (album)""")
def relabel_gates(spark, sf):
    """DOM-46: what is applied after an import, and what only noted."""
    files, tracks = _files(spark, sf)
    return relabel.Plan(files, tracks).gates(files.where("album % 3 = 0").select("album"))


@query(f"""WITH {_BASE}, h AS (SELECT album, file, unnest({_EVIDENCE}) AS answer FROM files WHERE extra) SELECT h.album, count(DISTINCT h.file) AS promotable FROM h JOIN files o ON o.album = h.album AND NOT o.extra WHERE {_AGREE.format('h.answer', 'o.title')} GROUP BY 1""")
def promotions(spark, sf):
    """DOM-42: extras that may be the real track."""
    return relabel.promotable(_files(spark, sf)[0])


@query(f"""WITH {_BASE} SELECT a.album, count(DISTINCT a.file) AS swaps FROM (SELECT album, file, unnest(titles) AS heard FROM files WHERE NOT confirmed) a JOIN files b ON a.album = b.album AND a.file <> b.file WHERE {_AGREE.format('a.heard', 'b.title')} GROUP BY 1""")
def swapped_titles(spark, sf):
    """DOM-41: files whose audio is another track of their album."""
    from siftline.plans import collection

    files = _files(spark, sf)[0].withColumn("verdict", F.when(F.col("confirmed"), "confirmed").otherwise("mismatch"))
    return collection.swaps(files.select("album", "file", "title", "titles", "verdict"), lambda a, b: expr.titles_agree(a, b))
