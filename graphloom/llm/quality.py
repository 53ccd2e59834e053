"""Quality rules as a bitmask ledger.

measure() reads each text once and returns measurements; ledger() evaluates every rule once and stores a failure bit
per rule beside the measurements.  A policy is a versioned mask: a document is kept if it fails none of the mask's
rules, so policies change without reading a text again.  ablations() aggregates the ledger to one row per distinct bit
pattern (at most 2 ** number of rules rows) and answers every "what if" by bitwise arithmetic on these.

Edge cases: a null or empty text has 0 words and fails `few_words`; ratios with an empty denominator are null and fail
no rule; repeated rows are judged separately; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import map_arrow, materialize, only, read_table, restore, with_kernel

REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True  # lead bytes of two bytes and more, as letters of most scripts have them

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_text_lines", "n_upper", "n_letters", "n_bang", "n_pipe_words", "n_run_words")


def _measure(s: tk.Slice) -> dict[str, np.ndarray]:
    out = {}
    starts, ends, first = s.spans(tk.NOT_SPACE)
    lead = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    out["n_words"] = np.diff(first)
    out["word_chars"] = tk.per_doc_sum(lead[ends] - lead[starts], first)
    for name, member in (("n_symbols", _SYMBOL), ("n_letters", _LETTER)):
        out[name] = tk.per_doc_sum(member[s.data], s.off)
    latin = np.zeros(len(s.data), bool)  # capitals of Latin-1: 0xC3 0x80-0x9E
    latin[1:] = (s.data[:-1] == 0xC3) & (s.data[1:] <= 0x9E)
    out["n_upper"] = tk.per_doc_sum(_UPPER[s.data] | latin, s.off)
    out["n_bang"] = tk.per_doc_sum(s.data == 0x21, s.off)
    alone = (ends - starts == 1) & (s.data[starts] == 0x7C)
    out["n_pipe_words"] = tk.per_doc_sum(alone, first)

    ls, le, lfirst = tk.lines(s)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    out["n_lines"] = np.diff(lfirst)
    out["n_text_lines"] = tk.per_doc_sum(has_word, lfirst)
    doc = np.repeat(np.arange(s.n), np.diff(lfirst))[has_word]
    h = s.hashes(ls[has_word], le[has_word])
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][again], minlength=s.n) if len(doc) else np.zeros(s.n, np.int64)

    word = s.hashes(starts, ends)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < len(word)]] = False
    out["n_run_words"] = tk.per_doc_sum(same, first)
    at, wh = tk.windows(word, first, REPEAT_WINDOW)
    repeat = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        wdoc = np.repeat(np.arange(s.n), np.diff(first))[at]
        key = tk.mix(wh + wdoc.astype(tk.U) * tk.U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeat, at[twice], 1)
        np.add.at(repeat, at[twice] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = tk.per_doc_sum(np.cumsum(repeat[:-1]) > 0, first)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of each whole text."""

    def fn(b: pa.RecordBatch):
        for s in tk.text_slices(b.column(1)):
            m = _measure(s)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], ["doc_id", *MEASURES])

    return map_arrow(only(docs, doc_id="long", text="string"), "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES), fn)


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str


#: A rule keeps its bit for ever; a changed rule gets a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "n_symbols > 0.10 * n_words"),
    Rule("capitals", 3, "n_upper > 0.30 * n_letters"),
    Rule("exclamation", 4, "n_bang > 0.10 * n_words"),
    Rule("table_cells", 5, "n_pipe_words > 0.10 * n_words"),
    Rule("repeated_lines", 6, "n_dup_lines > 0.30 * n_text_lines"),
    Rule("short_words", 7, "word_chars < 2 * n_words"),
    Rule("long_words", 8, "word_chars > 20 * n_words"),
    Rule("no_letters", 9, "n_letters < 0.50 * word_chars"),
    Rule("stuttered_words", 10, "n_run_words > 0.30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


POLICIES = (
    Policy(1, ("few_words", "repeated_windows")),
    Policy(2, ("few_words", "repeated_windows", "symbols", "capitals", "exclamation", "table_cells", "short_words", "long_words", "no_letters", "stuttered_words")),
)
CURRENT = POLICIES[-1]


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """Bit b is set where the rule with that bit fails; a rule that can't be evaluated fails none."""
    return reduce(lambda a, b: a + b, (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and `fail_bits`: bit b is set where the rule with that bit fails."""
    return measure(docs).withColumn("fail_bits", fail_bits(rules))


def store_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder, which policies and ablations read instead of texts."""
    return materialize(ledger(docs), "ledger")


def apply_policy(led: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0).withColumn("policy_version", F.lit(policy.version))


def ablations(led: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule of it: documents rejected by the policy, by the rule, by it alone, and without it."""
    spark = led.sparkSession
    patterns = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    spec = spark.createDataFrame([(p.version, p.mask(rules), r.name, 1 << r.bit) for p in policies for r in rules if r.name in p.rules], "policy_version int, mask long, rule string, bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return (
        patterns.join(F.broadcast(spec))  # a row per policy and rule against at most 2 ** rules patterns
        .groupBy("policy_version", "rule")
        .agg(
            count(hit != 0).alias("rejected"),
            count(hit.bitwiseAND(F.col("bit")) != 0).alias("by_rule"),
            count(hit == F.col("bit")).alias("by_rule_alone"),
            count(hit.bitwiseAND(F.bitwise_not("bit")) != 0).alias("without_rule"),
            F.bit_or(F.when(hit != 0, F.col("fail_bits"))).alias("bits_seen"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of docs whose fail bits meet none of the policy's mask, in their own columns; no shuffle."""
    measured = with_kernel(docs, {k: "long" for k in MEASURES}, _measure)
    return restore(apply_policy(measured.withColumn("fail_bits", fail_bits()), policy).filter("kept"), docs)


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(store_ledger(read_table(spark, sf_dir, "documents")))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "fail_bits", "policy_version")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to `documents`, from the ledger's bit patterns."""
    return ablations(store_ledger(read_table(spark, sf_dir, "documents")))
