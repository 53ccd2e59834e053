"""Secret scans (native: DataFrame functions only).

Three patterns give the base spans.  The method adds spans by entropy.  Base spans and what the allow-list names (paths
of words, identifiers, placeholders) are blanked in turn, so that every place stays where it is; candidate strings are
runs of token characters with a digit and a letter in what is left.  A window slides over each, its Shannon entropy kept
by incremental counts (one character leaves, one enters, and the sum of c * log2(c) changes by two table look-ups).
Windows over the threshold of the candidate's character class are hot; a span is a maximal stretch that hot windows cover.

Everything is linear in the text: places of matches are prefix sums over the pieces between them, taken in blocks, and
the window runs in blocks too, so neither a long candidate nor many matches copy a growing array at each step.

Edge cases: a null text is empty; an empty text has no span; equal starts are ordered by kind; a very long text or
candidate is scanned whole; repeated rows are scanned separately; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read_table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# 16 and 32 characters at least; a shorter run holds no longer match, so the bounds may stand in the patterns
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of an assigned value, at least.
LEAST = 8
WINDOW = 20
#: class -> (what all its characters are, bits per character from which a window counts); the first that fits holds
CLASSES = (
    ("digits", r"\A[0-9/_=+-]+\z", math.inf),
    ("lower hex", r"\A[0-9a-f]+\z", 3.0),
    ("upper hex", r"\A[0-9A-F]+\z", 3.0),
    ("one case", r"\A(?:[0-9a-z/_=+-]+|[0-9A-Z/_=+-]+)\z", 3.6),
    ("mixed", r"\A.+\z", 3.7),
)
#: Words joined into a path or a name; blanked first.  A match may begin only where a run of letters does, which keeps it linear.
PATH = r"(?<![A-Za-z])(?:[A-Za-z]{2,}+[/_-]){3}"
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0{8}|0123456789|1234567890|abcdefgh|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"
_SPAN = "struct<start:int,rank:int,kind:string,end:int>"
#: Matches or windows that one inner loop handles.
BLOCK = 512
#: Counts of the window's characters: twelve of five bits in a long, from the first token character on.
_FIRST, _LAST, _BITS, _PER_LONG = ord("+"), ord("z"), 5, 12


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _upto(n: Column) -> Column:
    """0 .. n - 1; sequence(0, -1) would run backwards."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(_empty("int"))


def _before(n: Column) -> Column:
    """Sum of the array's elements before each: within blocks, from the sums of the blocks before."""
    push = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    running = lambda xs, base: F.aggregate(xs, F.struct(base.alias("at"), _empty("int").alias("out")), push, lambda s: s["out"])
    blocks = F.transform(_upto(F.ceil(F.size(n) / BLOCK).cast("int")), lambda b: F.slice(n, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, k: s + k)
    return _let(blocks, lambda bs: _let(running(F.transform(bs, total), F.lit(0)), lambda base: F.flatten(F.transform(bs, lambda x, b: running(x, F.get(base, b))))))


def _placed(text: Column, pattern: str) -> Column:
    """Array of (start, match) for the leftmost non-overlapping matches; null where there is none."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = lambda ms, ps: _let(_before(F.zip_with(ps, ms, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))), lambda at: F.transform(ms, lambda m, i: F.struct((F.get(at, i) + F.length(F.get(ps, i))).alias("start"), m.alias("m"))))
    return F.when(text.rlike(pattern), _let(found, lambda ms: _let(pieces, lambda ps: each(ms, ps))))


def _blanked(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """text with spaces for the matches whose group has `least` characters at least."""
    gone = lambda m, g: F.when(F.length(g) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m) if least else F.repeat(F.lit(" "), F.length(m))
    found, groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    marks = F.zip_with(found, groups, gone) if group else F.transform(found, lambda m: gone(m, m))
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def _spans(placed: Column, rank: int, kind: str) -> Column:
    made = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end")))
    return F.coalesce(made, _empty(_SPAN))


def _touching(runs: Column) -> Column:
    """Sorted runs (a, z) of which those that overlap or touch are one."""
    begin = F.transform(F.filter(runs, lambda x, i: (i == 0) | (x["a"] > F.get(runs, i - 1)["z"])), lambda x: x["a"])
    end = F.transform(F.filter(runs, lambda x, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["a"] > x["z"])), lambda x: x["z"])
    return F.zip_with(begin, end, lambda a, z: F.struct(a.alias("a"), z.alias("z")))


def _hot_runs(word: Column, least: Column) -> Column:
    """Runs (a, z) of characters that windows whose entropy reaches `least` cover."""
    level = lambda c: c * math.log2(c) if c > 0 else 0.0
    leaves, enters = (F.array(*(F.lit(f(c)) for c in range(WINDOW + 1))) for f in (lambda c: level(c - 1) - level(c), lambda c: level(c + 1) - level(c)))
    codes = F.transform(F.split(word, ""), lambda c: (F.ascii(c) - _FIRST).cast("int"))
    longs = (_LAST - _FIRST) // _PER_LONG + 1
    at = lambda code: (F.floor(code / _PER_LONG).cast("int"), (code % _PER_LONG) * _BITS)
    run = lambda a, z: F.struct(a.alias("a"), z.alias("z"))

    def block(cs: Column, n: Column, bits: Column, lo: Column) -> Column:
        zero = F.struct(F.array(*(F.lit(0).cast("long") for _ in range(longs))).alias("c"), F.lit(0.0).alias("s"), F.lit(-1).alias("a"), F.lit(-1).alias("z"), _empty("struct<a:int,z:int>").alias("runs"))
        count = lambda c, code: F.call_function("shiftright", F.get(c, at(code)[0]), at(code)[1]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
        unit = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), at(code)[1])
        changed = lambda c, code, by: F.transform(c, lambda x, j: F.when(j == at(code)[0], x + unit(code) * by).otherwise(x))

        def step(st: Column, i: Column) -> Column:
            old, new = F.get(cs, F.when(i - WINDOW >= lo, i - WINDOW).otherwise(-1)), F.get(cs, i)
            less = F.when(old.isNull(), F.struct(st["c"].alias("c"), st["s"].alias("s"))).otherwise(F.struct(changed(st["c"], old, -1).alias("c"), (st["s"] + F.get(leaves, count(st["c"], old))).alias("s")))
            more = lambda x: F.struct(changed(x["c"], new, 1).alias("c"), (x["s"] + F.get(enters, count(x["c"], new))).alias("s"))

            def closed(x: Column) -> Column:
                hit = (i - lo >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - x["s"] / WINDOW >= bits)
                start, end = i - WINDOW + 1, i + 1
                apart = hit & (st["a"] >= 0) & (start > st["z"])
                return F.struct(
                    x["c"].alias("c"), x["s"].alias("s"),
                    F.when(hit & ((st["a"] < 0) | (start > st["z"])), start).otherwise(st["a"]).alias("a"), F.when(hit, end).otherwise(st["z"]).alias("z"),
                    F.when(apart, F.concat(st["runs"], F.array(run(st["a"], st["z"])))).otherwise(st["runs"]).alias("runs"),
                )

            return _let(_let(less, more), closed)

        done = lambda st: F.when(st["a"] < 0, st["runs"]).otherwise(F.concat(st["runs"], F.array(run(st["a"], st["z"]))))
        return F.aggregate(F.sequence(lo, F.least(n, lo + BLOCK + WINDOW - 1) - 1), zero, step, done)

    # what every step reads is bound once
    starts = lambda n: F.transform(_upto(F.floor((n - WINDOW) / BLOCK).cast("int") + 1), lambda b: b * BLOCK)
    runs = lambda cs, n, bits: F.flatten(F.transform(starts(n), lambda lo: block(cs, n, bits, lo)))
    return _let(codes, lambda cs: _let(F.size(cs), lambda n: _let(least, lambda bits: _let(runs(cs, n, bits), _touching))))


def _threshold(word: Column) -> Column:
    out = F.when(word.rlike(CLASSES[0][1]), F.lit(float("inf")))
    for _, pattern, least in CLASSES[1:]:
        out = out.when(word.rlike(pattern), F.lit(least))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, `base` and `added`: arrays of (start, rank, kind, end), ordered by start and kind."""
    d = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    group2 = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assign = F.when(t.rlike(ASSIGN), _let(group2, lambda g: F.filter(_placed(t, ASSIGN), lambda x, i: F.length(F.get(g, i)) >= LEAST)))
    base = F.array_sort(F.concat(_spans(assign, 0, "assign"), _spans(_placed(t, ACCESS), 1, "access"), _spans(_placed(t, HEX), 2, "hex")))
    d = d.select("doc_id", base.alias("base"), F.when(t.rlike(CANDIDATE), t).otherwise("").alias("rest"))
    for pattern, least, group in ((PATH, 0, 0), (ASSIGN, LEAST, 2), (ACCESS, 0, 0), (HEX, 0, 0), (ALLOWED, 0, 0)):
        d = d.select("doc_id", "base", _blanked(F.col("rest"), pattern, least, group).alias("rest"))
    words = F.filter(_placed(F.col("rest"), CANDIDATE), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    d = d.select("doc_id", "base", words.alias("words"))
    runs = F.transform("words", lambda x: F.transform(_hot_runs(x["m"], _threshold(x["m"])), lambda r: F.struct((x["start"] + r["a"]).alias("start"), F.lit(3).alias("rank"), F.lit("entropy").alias("kind"), (x["start"] + r["z"]).alias("end"))))
    return d.select("doc_id", "base", F.coalesce(F.flatten(runs), _empty(_SPAN)).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(read_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return s.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_entropy"))
