"""Line deduplication by overlapping three-line windows (native: DataFrame functions only).

Every run of three consecutive lines of a text is one window; a text of one or two lines is one window of that size,
which equals only windows of its own size.  A window's first occurrence, by doc_id and then position, stays; every
later one covers its lines.  Covered positions of a document are merged into ranges and their lines removed.

Line hashes are 96 bits, windows are hashes of line hashes: lines are never shuffled.  First occurrences come from a
partially aggregated minimum, so a window that a third of all documents share costs one row per task.

Edge cases: a null text has no line and stays null; windows of nothing but white space aren't compared; a text whose
lines all go becomes empty; rows of one doc_id and equal text are one document and fare alike; a null doc_id comes
first; an empty table gives no rows; other columns are ignored or carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, read_table

LINES = 3
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(d: DataFrame, k: int = LINES) -> DataFrame:
    """doc_id, th (hash of the text), n lines, pos and the two parts of the window's hash."""
    h = d.filter("text is not null").select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        F.transform(_lines(F.col("text")), lambda x: F.struct(F.when(x.rlike(_WORD), F.xxhash64(x)).otherwise(F.lit(0)).alias("a"), F.hash(x).alias("b"))).alias("h"),
    )
    h = h.withColumn("n", F.size("h")).withColumn("m", F.least("n", F.lit(k)))
    # get() is null past the end, which only windows of short texts reach; m tells them apart
    part = lambda i, f: [F.get("h", i + j)[f] for j in range(k)]
    w = h.select("doc_id", "th", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("m")), lambda i: F.struct(F.xxhash64("m", *part(i, "a")).alias("w1"), F.hash("m", *part(i, "b")).alias("w2"), F.exists(F.array(*part(i, "a")), lambda x: x != 0).alias("word")))).alias("pos", "w"))
    return w.filter(F.coalesce(F.col("w.word"), F.lit(False))).select("doc_id", "th", "pos", F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))


def repeats(docs: DataFrame, k: int = LINES) -> DataFrame:
    """doc_id, th and the sorted starts of windows that occurred before."""
    w = materialize(windows(only(docs, doc_id="long", text="string"), k), "windows")
    first = w.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    later = w.join(first, ["w1", "w2"]).filter(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _covered(starts: Column, m: Column) -> Column:
    """Merged ranges [a, z] of the lines that windows of m lines from these sorted starts cover."""
    begin = F.filter(starts, lambda p, i: (i == 0) | (p - F.get(starts, i - 1) > m))
    end = F.transform(F.filter(starts, lambda p, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - p > m)), lambda p: p + m - 1)
    return F.arrays_zip(begin.alias("a"), end.alias("z"))


def dedup_lines(docs: DataFrame, k: int = LINES) -> DataFrame:
    """Rows of docs as c0, c1, ... with `clean` (the text without later occurrences), `n_lines` and `ranges`."""
    cols = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, cols, strict=True))
    found = repeats(docs, k).toDF("_d", "_th", "starts")
    d = docs.toDF(*cols).withColumn("_text", F.col(at["text"]).cast("string")).withColumn("_id", F.col(at["doc_id"]).cast("long"))
    j = d.join(found, F.col("_id").eqNullSafe(F.col("_d")) & (F.xxhash64("_text") == F.col("_th")), "left").drop("_d", "_th")
    lines = _lines(F.col("_text"))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines))
    j = j.withColumn("n_lines", n.cast("long")).withColumn("ranges", F.coalesce(_covered(F.col("starts"), F.least(n, F.lit(k))), F.expr("cast(array() as array<struct<a:int,z:int>>)")))
    r = F.col("ranges")
    keep = F.transform(F.sequence(F.lit(0), F.size(r)), lambda i: F.struct(F.coalesce(F.get(r, i - 1)["z"] + 1, F.lit(0)).alias("a"), F.coalesce(F.get(r, i)["a"], F.col("n_lines").cast("int")).alias("z")))
    left = F.flatten(F.transform(keep, lambda x: F.slice(lines, x["a"] + 1, x["z"] - x["a"])))
    clean = F.when(F.size(r) == 0, F.col("_text")).otherwise(F.array_join(left, "\n"))
    return j.withColumn("clean", clean).drop("_text", "_id", "starts")


def without_repeats(docs: DataFrame, k: int = LINES) -> DataFrame:
    """docs with cleaned texts in their own columns; a text that lost all its lines goes, and n_chars follows the text."""
    cols = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, cols, strict=True))
    d = dedup_lines(docs, k).filter((F.size("ranges") == 0) | F.col("clean").rlike(_WORD))
    d = d.withColumn(at["text"], F.col("clean"))
    if "n_chars" in at:
        d = d.withColumn(at["n_chars"], F.when(F.size("ranges") == 0, F.col(at["n_chars"])).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType)))
    return d.select(*cols).toDF(*docs.columns)


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("ranges", lambda x: F.concat(x["a"].cast("string"), F.lit("-"), x["z"].cast("string"))), ",")
    gone = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, x: s + x["z"] - x["a"] + 1)
    return d.select(F.col("c0").alias("doc_id"), "n_lines", gone.alias("n_removed"), spans.alias("removed_lines"), F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"))


OP5_SQL = r"""
with parts as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
lines as (select doc_id, len(ls) as n, unnest(ls) as line, unnest(range(len(ls))) as pos from parts where text is not null),
win as (
  select doc_id, n, pos, least(n, 3) as m, line as l1,
         lead(line, 1) over w as l2, lead(line, 2) over w as l3
  from lines window w as (partition by doc_id order by pos)),
ranked as (
  select doc_id, pos, m, row_number() over (partition by m, l1, case when m > 1 then l2 end, case when m > 2 then l3 end order by doc_id, pos) as k
  from win
  where pos + m <= n and regexp_matches(concat(l1, case when m > 1 then l2 end, case when m > 2 then l3 end), '[^\x20\x09-\x0D]')),
gone as (select distinct doc_id, unnest(range(pos, pos + m)) as pos from ranked where k > 1),
runs as (
  select doc_id, min(pos) as a, max(pos) as z
  from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as g from gone) group by doc_id, g),
spans as (select doc_id, sum(z - a + 1)::bigint as n_removed, string_agg(a || '-' || z, ',' order by a) as removed_lines from runs group by doc_id),
kept as (
  select l.doc_id, string_agg(line, chr(10) order by l.pos) as clean
  from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos where g.pos is null group by l.doc_id)
select p.doc_id, coalesce(len(p.ls), 0)::bigint as n_lines, coalesce(s.n_removed, 0)::bigint as n_removed,
       coalesce(s.removed_lines, '') as removed_lines, sha256(coalesce(k.clean, '')) as clean_sha256
from parts p left join spans s using (doc_id) left join kept k using (doc_id)
"""
