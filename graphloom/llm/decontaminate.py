"""Benchmark decontamination with suffix arrays over the training texts.

Each slice of documents is a shard with its own suffix array over word ids.  Ids number the benchmark's vocabulary, so
a suffix of a shard can match only up to its first foreign word; suffixes that meet a foreign word before the shortest
window ends can't match and are left out of the array.  Every benchmark suffix is binary-searched in each shard's
array, to the depth of a window, which loses no match: a longer one is a run of windows on one diagonal, and such runs
merge into the longest verbatim matches with their places.

The benchmark is the stated query set.  Up to BLOCK_BYTES of its text it is one broadcast; beyond that it goes in passes
over the documents, one block of at most BLOCK_BYTES broadcast at a time, whose matches are stored and then merged.

Edge cases: a null or empty text has no words and no hits; a null or empty benchmark item has no window; an item of
fewer than ten words is one window; repeated items count once by item_id; words of an item without an id are hit, but it
is no item of n_items; ties between matches are ordered by place, then length; a very long text is searched whole;
repeated rows are judged alike; an empty table on either side gives
uncontaminated documents or no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, only, read_table, restore, with_kernel

WINDOW = 10
BLOCK_BYTES = 32 << 20


class TestSuffixes:
    """A block of benchmark items: its vocabulary and, for each window, the key range to search for."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int = WINDOW):
        self.window, self.ids = window, ids
        column = pa.array(texts, pa.large_string())
        hashes, per = [], []
        for s in tk.text_slices(column):
            starts, ends, first = s.spans(tk.ALNUM)
            hashes.append(s.hashes(starts, ends, lower=True))
            per.append(np.diff(first))
        words = np.concatenate(hashes) if hashes else np.zeros(0, tk.U)
        per = np.concatenate(per) if per else np.zeros(0, np.int64)
        self.vocab = np.unique(words)
        wid = np.searchsorted(self.vocab, words).astype(np.uint32) + 1
        first = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        size = np.minimum(per, window)
        n_windows = np.where(per > 0, per - size + 1, 0)
        self.item = np.repeat(np.arange(len(per)), n_windows)
        self.at = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        self.size = size[self.item]
        self.shortest = int(self.size.min()) if len(self.size) else window
        cols = np.arange(window)
        inside = cols < self.size[:, None]
        where = (first[self.item] + self.at)[:, None] + cols
        key = np.where(inside, wid[np.minimum(where, max(0, len(wid) - 1))] if len(wid) else 0, 0)
        self.low = _pack(key)
        self.high = _pack(np.where(inside, key, 0xFFFFFFFF))

    def matches(self, s: tk.Slice) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """First word of each document (n + 1); the longest verbatim matches as doc, item, item_start, doc_start, length."""
        starts, ends, first = s.spans(tk.ALNUM)
        none = {k: np.zeros(0, np.int64) for k in ("doc", "item", "item_start", "doc_start", "length")}
        if not len(starts) or not len(self.item):
            return first, none
        h = s.hashes(starts, ends, lower=True)
        slot = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        wid = np.where(self.vocab[slot] == h, slot + 1, 0).astype(np.uint32)
        doc_end = np.repeat(first[1:], np.diff(first))
        stop = np.flatnonzero(wid == 0)
        foreign = np.append(stop, len(wid))[np.searchsorted(stop, np.arange(len(wid)))]
        reach = np.minimum(foreign, doc_end) - np.arange(len(wid))
        suffix = np.flatnonzero(reach >= self.shortest)
        if not len(suffix):
            return first, none
        cols = np.arange(self.window)
        key = np.where(cols < reach[suffix][:, None], wid[np.minimum(suffix[:, None] + cols, len(wid) - 1)], 0)
        key = _pack(key)
        order = np.argsort(key, kind="stable")  # the suffix array of the shard, to the depth of a window
        array, key = suffix[order], key[order]
        lo, hi = np.searchsorted(key, self.low, "left"), np.searchsorted(key, self.high, "right")
        n = hi - lo
        if not n.any():
            return first, none
        w = np.repeat(np.arange(len(n)), n)
        p = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        doc = np.searchsorted(first, p, "right") - 1
        item, q, size = self.item[w], self.at[w], self.size[w]
        order = np.lexsort((p, p - q, item))
        doc, item, q, size, p = doc[order], item[order], q[order], size[order], p[order]
        new = np.ones(len(p), bool)
        new[1:] = (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(p)) - 1
        return first, {"doc": doc[begin], "item": item[begin], "item_start": q[begin], "doc_start": p[begin], "length": p[last] + size[last] - p[begin]}


def _pack(key: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort as the rows do."""
    key = np.ascontiguousarray(key, dtype=">u4")
    return key.view(f"S{4 * key.shape[1]}").ravel() if len(key) else np.zeros(0, f"S{4 * max(1, key.shape[1])}")


def _kernel(blocks: list) -> callable:
    def kernel(s: tk.Slice) -> dict[str, np.ndarray | pa.Array]:
        hit, found = None, []
        for b in blocks:
            t: TestSuffixes = b.value
            first, m = t.matches(s)
            if hit is None:
                hit = np.zeros(first[-1] + 1, np.int64)
            np.add.at(hit, m["doc_start"], 1)
            np.add.at(hit, m["doc_start"] + m["length"], -1)
            found += [(int(d), t.ids[i], int(a), int(p - first[d]), int(k)) for d, i, a, p, k in zip(m["doc"], m["item"], m["item_start"], m["doc_start"], m["length"], strict=True)]
        if hit is None:
            first = s.spans(tk.ALNUM)[2]
            hit = np.zeros(first[-1] + 1, np.int64)
        lists: list[list] = [[] for _ in range(s.n)]
        for d, i, a, p, k in sorted(found, key=lambda x: (x[0], x[3], -x[4], x[1] is None, x[1] or 0, x[2])):
            lists[d].append({"item_id": i, "item_start": a, "doc_start": p, "length": k})
        n_hit = tk.per_doc_sum(np.cumsum(hit[:-1]) > 0, first)
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "item_start", "doc_start", "length")]))
        return {"n_words": np.diff(first), "n_hit": n_hit, "matches": pa.array(lists, kind), "_clean": n_hit == 0}

    return kernel


MATCH = "struct<item_id:long,item_start:long,doc_start:long,length:long>"


def _parts(bench: DataFrame) -> list[DataFrame]:
    """The query set in parts of at most about BLOCK_BYTES of text (or one longer item)."""
    b = only(bench, item_id="long", text="string").filter("text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if size <= BLOCK_BYTES else -(-size // (BLOCK_BYTES // 2))
    return [b if n == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _shared(part: DataFrame):
    rows = part.collect()  # at most about BLOCK_BYTES
    return part.sparkSession.sparkContext.broadcast(TestSuffixes([r[0] for r in rows], [r[1] for r in rows]))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text: rows that agree in all of them have the same matches."""
    return only(docs, doc_id="long", text="string").withColumn("h1", F.xxhash64("text")).withColumn("h2", F.hash("text"))


def _passes(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """doc_id, h1, h2, matches of the documents that any part hits: one pass a part, of which only matches are stored."""
    found = []
    for part in parts:
        b = _shared(part)
        got = with_kernel(_keyed(docs), {"n_hit": "long", "matches": f"array<{MATCH}>"}, _kernel([b])).filter("n_hit > 0").select(F.col("c0").alias("doc_id"), F.col("c2").alias("h1"), F.col("c3").alias("h2"), "matches")
        found.append(materialize(got, "matches"))
        b.destroy()
    each = reduce(DataFrame.unionByName, found).select("doc_id", "h1", "h2", F.explode("matches").alias("m"))
    order = lambda m: F.struct(m["doc_start"], -m["length"], m["item_id"].isNull(), m["item_id"], m["item_start"])
    return each.groupBy("doc_id", "h1", "h2").agg(F.array_sort(F.collect_set(F.struct(order(F.col("m")).alias("k"), "m"))).alias("x")).select("doc_id", "h1", "h2", F.col("x.m").alias("matches"))


def _covered(matches: Column) -> Column:
    """Words within any match; matches are sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, m: F.struct(F.greatest(s["end"], m["doc_start"] + m["length"]).alias("end"), (s["n"] + F.greatest(F.lit(0), m["doc_start"] + m["length"] - F.greatest(s["end"], m["doc_start"]))).alias("n"))
    return F.aggregate(matches, zero, step, lambda s: s["n"])


def longest_matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, and `matches`, the maximal verbatim matches of ten words or a whole short item."""
    parts = _parts(bench)
    if len(parts) == 1:
        d = only(docs, doc_id="long", text="string")
        return with_kernel(d, {"n_words": "long", "n_hit": "long", "matches": f"array<{MATCH}>"}, _kernel([_shared(parts[0])])).withColumnRenamed("c0", "doc_id").drop("c1")
    found = _passes(docs, parts).toDF("_d", "_h1", "_h2", "matches")
    sized = with_kernel(_keyed(docs), {"n_words": "long"}, _kernel([])).select(F.col("c0").alias("doc_id"), F.col("c2").alias("h1"), F.col("c3").alias("h2"), "n_words")
    j = sized.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    m = F.coalesce("matches", F.expr(f"cast(array() as array<{MATCH}>)"))
    return j.select("doc_id", "n_words", _covered(m).alias("n_hit"), m.alias("matches"))


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs without any benchmark window, in their own columns."""
    parts = _parts(bench)
    if len(parts) == 1:
        return restore(with_kernel(docs, {}, _kernel([_shared(parts[0])]), keep="_clean"), docs)
    left = docs
    for part in parts:
        b = _shared(part)
        left = materialize(restore(with_kernel(left, {}, _kernel([b]), keep="_clean"), docs), "clean")
        b.destroy()
    return left


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = longest_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform(F.array_distinct(F.array_compact(F.col("matches.item_id"))), lambda x: x.cast("string")))
    longest = F.coalesce(F.array_max(F.col("matches.length")), F.lit(0)).cast("long")
    return m.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), longest.alias("longest_match"))
