"""Packing by shortest-pack-first over the length histogram.

Documents become pieces of at most CONTEXT ids.  Only the histogram of piece lengths (at most CONTEXT rows) reaches the
driver.  There, lengths are placed longest first, each on the emptiest packs it fits, updating counts of packing
patterns instead of packs.  A pattern hands out ranges of ranks per length; pieces get their rank within their length
by a distributed two-level count and meet their range in a broadcast join, so no task ever holds all pieces of a length.

Edge cases: a null or empty text is the end id alone; a long text is cut into pieces, each id in exactly one; repeated
rows are packed separately; a null doc_id is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import distributed_rank, map_arrow, materialize, only, read_table
from .tokens import default_path, word_ids

CONTEXT = 2048
END_ID = 1
#: Rows that one task ranks at most, on average.
BUCKET_ROWS = 100_000


def pieces(docs: DataFrame, tokenizer: str | None = None, context: int = CONTEXT) -> DataFrame:
    path = tokenizer or default_path()

    def fn(b: pa.RecordBatch):
        enc = word_ids(path)
        for s in tk.text_slices(b.column(1)):
            ids, per, first = enc.slice(s)
            bounds = np.concatenate([[0], np.cumsum(per)])[first]
            size = np.diff(bounds) + 1
            raw = np.full(len(ids) + s.n, END_ID, "<u4")
            raw[np.arange(len(ids)) + np.repeat(np.arange(s.n), size - 1)] = ids
            at = np.cumsum(size) - size
            pieces = -(-size // context)
            doc = np.repeat(np.arange(s.n), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * context
            length = np.minimum(context, size[doc] - start)
            flat = memoryview(raw.tobytes())
            crc = [zlib.crc32(flat[4 * a : 4 * (a + n)]) for a, n in zip((at[doc] + start).tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(only(docs, doc_id="long", text="string"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", fn)


def plan(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[dict[int, int], int]]:
    """Packing patterns: ({length: how many}, how many packs)."""
    done: list[tuple[dict[int, int], int]] = []
    open_: list[tuple[int, int]] = []  # (-room, number); the emptiest first
    packs: dict[int, tuple[dict[int, int], int]] = {}
    serial = 0

    def put(pattern: dict[int, int], n: int, room: int) -> None:
        nonlocal serial
        if room == 0:
            done.append((pattern, n))
            return
        packs[serial] = (pattern, n)
        heapq.heappush(open_, (-room, serial))
        serial += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_ and -open_[0][0] >= length:
            room, k = heapq.heappop(open_)
            pattern, n = packs.pop(k)
            fit = -room // length
            if left >= n * fit:  # fill these packs with it as often as it fits
                m, use = fit, n
            elif left >= n:
                m, use = left // n, n
            else:
                m, use = 1, left
            if use < n:
                put(pattern, n - use, -room)
            grown = dict(pattern)
            grown[length] = m
            left -= m * use
            put(grown, use, -room - m * length)
        m = context // length
        if left >= m:
            put({length: m}, left // m, context - m * length)
            left %= m
        if left:
            put({length: left}, 1, context - left * length)
    return done + list(packs.values())


def ranges(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a pack, first sequence, offset): which ranks of a length go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, m in pattern.items():
            a = used.get(length, 0)
            used[length] = a + n * m
            out.append((length, a, a + n * m, m, sequence, offset))
            offset += length * m
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, context: int = CONTEXT) -> DataFrame:
    spark = docs.sparkSession
    p = materialize(pieces(docs, tokenizer, context).withColumn("row", F.monotonically_increasing_id()), "pieces")  # stored, so fixed
    histogram = {r[0]: r[1] for r in p.groupBy("length").count().collect()}  # at most `context` rows
    table = spark.createDataFrame(ranges(plan(histogram, context)), "length long, a long, z long, m long, s long, o long")
    ranked = distributed_rank(p, ["length"], ["doc_id", "start", "ids_crc32"], F.xxhash64("row"), max(1, -(-sum(histogram.values()) // BUCKET_ROWS)))
    # bounded by the context length, not by the number of documents
    j = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("z"))).drop(table["length"])
    k = F.col("rank") - F.col("a")
    return j.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("s") + F.expr("(rank - a) div m")).cast("long").alias("sequence_id"), (F.col("o") + (k % F.col("m")) * F.col("length")).cast("long").alias("offset"))


def op4_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
