"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles (ASCII letters lowered, weight = occurrences).  Each shingle sends
arrivals to random registers as a Poisson process whose rate is its weight; a register keeps the shingle that arrives
first.  Two texts agree in a register with their probability Jaccard similarity.  Arrivals are drawn in time order up
to a horizon by which nearly all registers are taken and the few texts with an empty register go on, so nothing is
drawn that can't matter (early termination).

Copies of one text form one node.  Registers are banded (32 bands of 6); in each bucket every node is verified against
the bucket's least node by its whole text.  Links give components.  Nodes of one bucket that are still in different
components are then verified against each other, so no link between candidates is lost, while a bucket of a million
near copies costs a million comparisons and not their square.  At similarity 0.8 a pair misses all bands with a chance
of 6e-5, at 0.85 of 2e-7.

Verification goes by groups of at most 2 * BLOCK texts: a leader with BLOCK of its partners, or two blocks of a bucket.
A text is cut into shingles once a group, only links leave it, and a hot leader or bucket spreads over many groups.

Edge cases: texts of fewer than five words are one shingle; equal texts share a class even if they have no word; a null
text is alone in its class, unless the id is null or the same too; repeated rows are one node; where rows of one doc_id
have different texts each is a document of its own, all but one of which get an id over 2**62; a null doc_id gets a
negative id made of its text; ties between copies go to the least id; very long texts are compared whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import map_arrow, materialize, only, read_table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Texts of one side of a verification group, and the bytes of text that are shingled at a time.
BLOCK, SLAB = 64, 4 << 20
_STEP = tk.U(0xA0761D6478BD642F)


def shingles(s: tk.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle occurrence."""
    starts, ends, first = s.spans(tk.NOT_SPACE)
    h = s.hashes(starts, ends, lower=True)
    at, wh = tk.windows(h, first, k)
    doc = np.repeat(np.arange(s.n), np.diff(first))[at]
    n = np.diff(first)
    for m in range(1, k):  # short texts: all their words
        short = np.flatnonzero(n == m)
        if len(short):
            p, ph = tk.windows(h, first, m)
            keep = np.isin(p, first[short])
            doc, wh = np.concatenate([doc, np.searchsorted(first, p[keep], "right") - 1]), np.concatenate([wh, ph[keep]])
    return doc, wh


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) in order, with counts."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def registers(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m: the shingle that came first in each register; documents without shingles keep zeros."""
    total = np.bincount(doc, w, n)
    has = total > 0
    horizon = np.zeros(n)
    horizon[has] = m * (np.log(m) + 2.0) / total[has]
    best, sig = np.full(n * m, np.inf), np.zeros(n * m, tk.U)
    d, e, rate = doc, h, w.astype(float)
    turn = np.zeros(len(d), tk.U)
    t = np.zeros(len(d))
    started = False
    parked: tuple = (np.zeros(0, np.int64), np.zeros(0, tk.U), np.zeros(0), np.zeros(0, tk.U), np.zeros(0), np.zeros(0, tk.U))
    r = np.zeros(len(d), tk.U)
    while True:
        while len(d):
            if started:
                late = t > horizon[d]
                if late.any():
                    parked = tuple(np.concatenate([a, b[late]]) for a, b in zip(parked, (d, e, rate, turn, t, r), strict=True))
                    d, e, rate, turn, t, r = (x[~late] for x in (d, e, rate, turn, t, r))
                    if not len(d):
                        break
                at = d * m + ((r >> tk.U(32)) * tk.U(m) >> tk.U(32)).astype(np.int64)
                np.minimum.at(best, at, t)
                won = t == best[at]
                sig[at[won]] = e[won]
            started = True
            turn = turn + tk.U(1)
            with np.errstate(over="ignore"):
                r = tk.mix(e + turn * _STEP)
            u = ((tk.mix(r ^ _STEP) >> tk.U(11)).astype(float) + 0.5) * 2.0**-53
            t = t - np.log(u) / rate
        empty = np.isinf(best).reshape(n, m).any(axis=1) & has
        if not empty.any():
            return sig.reshape(n, m)
        horizon[empty] *= 1.5
        back = empty[parked[0]]
        d, e, rate, turn, t, r = (x[back] for x in parked)
        parked = tuple(x[~back] for x in parked)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    s = sig.reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(bands, dtype=tk.U) * _STEP, s.shape[:2]).copy()
        for j in range(rows):
            acc = tk.mix(acc * tk.U(3) + s[:, :, j])
    return tk.signed(acc)


def text_key(text: str = "text", doc_id: str = "doc_id"):
    """A hash of the text; a null text is equal to no other, so its key is made of its row's id."""
    return F.coalesce(F.when(F.col(text).isNotNull(), F.xxhash64(text)), F.xxhash64(F.lit("null"), doc_id))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and its band keys (none without words)."""

    def fn(b: pa.RecordBatch):
        for s in tk.text_slices(b.column(2)):
            doc, h, w = weighted(*shingles(s))
            keys = band_keys(registers(doc, h, w, s.n))
            has = np.bincount(doc, minlength=s.n) > 0
            bounds = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[has].ravel()))
            k2 = tk.signed(s.hashes(s.off[:-1], s.off[1:]))
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(s.first, s.n) for i in range(2)), pa.array(k2), bands], ["doc_id", "k1", "k2", "bands"])

    d = only(docs, doc_id="long", text="string")
    return map_arrow(d.select("doc_id", text_key().alias("k1"), "text"), "doc_id long, k1 long, k2 long, bands array<long>", fn)


def repeated_ids(keyed: DataFrame) -> tuple[bool, DataFrame | None]:
    """Whether any id (or null) has more than one row, and doc_id with one text key of it for ids of different texts."""
    g = keyed.groupBy("doc_id").agg(F.min("k1").alias("least"), F.max("k1").alias("most"), F.count(F.lit(1)).alias("n"))
    found = materialize(g.filter("n > 1"), "repeated")
    several = found.filter("doc_id is not null and least != most").select("doc_id", "least")
    return not found.isEmpty(), None if several.isEmpty() else several


def named(keyed: DataFrame, several: DataFrame | None) -> DataFrame:
    """Adds nid, the id of each (doc_id, text): doc_id where that names one text."""
    own = F.coalesce(F.col("doc_id"), -1 - F.shiftrightunsigned("k1", 2))
    if several is None:
        return keyed.withColumn("nid", own)
    j = keyed.join(several, "doc_id", "left")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", "k1"), 2) + F.lit(1 << 62)
    return j.withColumn("nid", F.when(F.col("least").isNull() | (F.col("k1") == F.col("least")), own).otherwise(other)).drop("least")


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over shared elements i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    x, y = x.astype(float), y.astype(float)
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    cx, cy = np.cumsum(x), np.cumsum(y[::-1])[::-1]
    both = (x > 0) & (y > 0)
    i = np.flatnonzero(both)
    return float(np.sum(1.0 / (cx[i] / x[i] + np.append(cy, 0)[i + 1] / y[i])))


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets of sorted distinct hashes."""
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    both = ha[at] == hb
    common = int(both.sum())
    if wa.max() == 1 and wb.max() == 1:
        return common / (len(ha) + len(hb) - common)
    y = np.zeros(len(ha), np.int64)
    y[at[both]] = wb[both]
    rest = wb[~both]
    return probability_jaccard(np.concatenate([wa, np.zeros(len(rest), np.int64)]), np.concatenate([y, rest]))


def _links(t: pa.Table, least: float) -> pa.RecordBatch:
    """Pairs of the groups of t that are similar; t holds whole groups, in order."""
    g, side, nid, comp = (t.column(k).to_numpy() for k in ("g", "side", "nid", "comp"))
    parts = []
    for s in tk.text_slices(t.column("text").combine_chunks()):
        doc, h, w = weighted(*shingles(s))
        parts.append((doc + s.first, h, w))
    doc, h, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
    at = np.searchsorted(doc, np.arange(len(g) + 1))
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    a, b = [], []
    for lo, hi in zip(start.tolist(), np.append(start[1:], len(g)).tolist(), strict=True):
        rows = np.arange(lo, hi)
        left, right = rows[side[lo:hi] != 1], rows[side[lo:hi] != 0]
        for i in left.tolist():
            hi_, wi = h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]
            plain = len(wi) and wi.max() == 1
            for j in right[(comp[right] != comp[i]) & ((side[right] == 1) | (right > i))].tolist():
                wj = w[at[j] : at[j + 1]]
                # sets of such different sizes can't be similar
                if plain and len(wj) and min(len(wi), len(wj)) < least * max(len(wi), len(wj)) and wj.max() == 1:
                    continue
                if similarity(hi_, wi, h[at[j] : at[j + 1]], wj) >= least:
                    a.append(min(nid[i], nid[j]))
                    b.append(max(nid[i], nid[j]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verify(members: DataFrame, docs: DataFrame, repeated: bool, several: DataFrame | None, least: float = SIMILARITY) -> DataFrame:
    """a < b: the pairs of different comp within a group whose texts have at least this similarity.

    members: g (the group), side, nid, comp; side 0 is compared with side 1, and 2 with all of its group.
    """
    # members grow with the documents, so they are never broadcast, on small data neither
    members = members.hint("merge")
    d = only(docs, doc_id="long", text="string").withColumn("k1", text_key())
    texts = named(d, several).select("nid", "text")
    if repeated:
        texts = texts.join(members.select("nid").distinct().hint("merge"), "nid", "left_semi").dropDuplicates(["nid"])
    j = members.join(texts, "nid").select("g", "side", "nid", "comp", "text").repartition("g").sortWithinPartitions("g", "side", "nid")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            g = t.column("g").to_numpy()
            start = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
            size = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in t.column("text").to_pylist()])])[start]
            i = 0
            while i < len(start) - 1:  # a few megabytes at a time
                k = max(i + 1, int(np.searchsorted(size, size[i] + SLAB, "right")) - 1)
                yield _links(t.slice(start[i], start[k] - start[i]), least)
                i = k

        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            cut = int(np.flatnonzero(np.append(True, g[1:] != g[:-1]))[-1])  # the last group may go on
            if cut or (held and held[0].column(0)[0].as_py() != g[0]):
                held.append(b.slice(0, cut))
                yield from whole(pa.Table.from_batches([x for x in held if x.num_rows]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from whole(pa.Table.from_batches(held))

    return j.mapInArrow(fn, "a long, b long")


def leader_groups(pairs: DataFrame) -> DataFrame:
    """Members of groups of one a and at most about BLOCK of its bs."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    p = pairs.join(many, "a", "left").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)))).alias("g"))
    row = lambda side, nid: p.select("g", F.lit(side).alias("side"), F.col(nid).alias("nid"), F.col(nid).alias("comp"))
    return row(0, "a").distinct().unionByName(row(1, "b"))


def block_groups(crowd: DataFrame) -> DataFrame:
    """Members of groups that are pairs of blocks of one bucket.  crowd: key, n (nodes of the bucket), rep, c."""
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    p = crowd.select("key", "rep", "c", n.alias("blocks"), own.alias("own")).select("key", "rep", "c", "own", pair.alias("p"))
    side = F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("own") == F.col("p.i"), 0).otherwise(1)
    return p.select(F.xxhash64("key", "p.i", "p.j").alias("g"), side.alias("side"), F.col("rep").alias("nid"), F.col("c").alias("comp"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each linked node and the least node of its component; by alternating large and small stars.

    Every round is two joins on narrow rows, written to the shared folder; rounds grow with the logarithm of the size.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        e = materialize(small, "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return e


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, k1, nid, class_id: the least id among the documents it is linked to, directly or by way of others."""
    sig = materialize(signatures(docs), "signatures")
    repeated, several = repeated_ids(sig)
    ided = named(sig, several)
    reps = materialize(ided.groupBy("k1", "k2").agg(F.min("nid").alias("rep"), F.any_value("bands").alias("bands")), "nodes")
    rows = ided.select("doc_id", "nid", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "k1", "nid", "rep")
    buckets = reps.filter("bands is not null").select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("other")).filter("leader < other")
    crowded = materialize(buckets.join(shared.select("key", "leader"), "key"), "buckets")
    first = materialize(crowded.filter("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = materialize(verify(leader_groups(first), docs, repeated, several, least), "links")
    comp = components(links)
    # nodes of one bucket that are still apart
    apart = crowded.join(comp.toDF("rep", "c"), "rep", "left").select("key", "leader", "rep", F.coalesce("c", "rep").alias("c"))
    mixed = apart.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("key", "n")
    rest = materialize(apart.join(mixed, "key"), "apart")
    few = rest.filter(F.col("n") <= BLOCK)  # so a bucket gives a bounded number of pairs
    x, y = few.select("key", "leader", F.col("rep").alias("a"), F.col("c").alias("ca")), few.select("key", F.col("rep").alias("b"), F.col("c").alias("cb"))
    more = x.join(y, "key").filter("a < b and ca != cb and a != leader").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    groups = leader_groups(materialize(more, "pairs")).unionByName(block_groups(rest.filter(F.col("n") > BLOCK)))
    late = materialize(verify(groups, docs, repeated, several, least), "links")
    if not late.isEmpty():
        comp = components(links.unionByName(late))
    return rows.join(comp.toDF("rep", "c"), "rep", "left").select("doc_id", "k1", "nid", F.coalesce("c", "rep").alias("class_id"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs with one document of each class, the one of the least id; of repeated rows one stays."""
    found = materialize(classes(docs, least), "classes")
    # a null doc_id doesn't tell its texts apart, the text's key does
    losers = found.filter("nid != class_id").select("doc_id", "k1").distinct()
    again = found.groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("k1"), F.min("doc_id").alias("doc_id")).filter("n > 1 and nid is not null")
    cols = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: c for n, c in zip(docs.columns, cols, strict=True)}
    d = docs.toDF(*cols).withColumn("_id", F.col(at["doc_id"]).cast("long")).withColumn("_text", F.col(at["text"]).cast("string"))
    d = d.withColumn("_k", text_key("_text", "_id"))
    gone = losers.toDF("_i", "_l")
    kept = d.join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_l")), "left_anti")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["_id", "_k"])
    return kept.select(*cols).toDF(*docs.columns)


def op2_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")
