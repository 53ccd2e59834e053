"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.shared import discard, drop_path, materialize, shared_dir  # noqa: F401


def map_arrow(df: DataFrame, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(each, schema)


def only(df: DataFrame, **casts: str) -> DataFrame:
    """The named columns cast to these types; others, whatever they are called, don't enter the operator."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in casts.items()))


def distributed_rank(df: DataFrame, group: list[str], order: list[str], salt: Column, buckets: int, out: str = "rank") -> DataFrame:
    """0-based rank of each row in its group without ever sorting a whole group in one task.

    Rows fall into `buckets` buckets by salt; counts per (group, bucket) give each bucket's first rank; a window ranks
    within a bucket.  df is read twice, so hand in a materialised one.
    """
    d = df.withColumn("_b", F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = d.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(start), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = d.withColumn("_r", F.row_number().over(inner) - 1)
    return ranked.join(base, [*group, "_b"]).withColumn(out, (F.col("_r") + F.col("_base")).cast("long")).drop("_b", "_r", "_base")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_kernel(docs: DataFrame, extra: dict[str, str], kernel: Callable, text: str = "text", keep: str | None = None) -> DataFrame:
    """Rows of docs and what `kernel(slice) -> {name: array}` says of their texts, in one pass without a shuffle.

    Own columns come back as c0, c1, ... beside the extra ones, so no name can clash; `restore` gives them their names.
    keep: a boolean among the kernel's results; rows where it is false are left out and it isn't returned.
    """
    from . import textkit as tk

    at, cols = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(cols, docs.schema, strict=True)] + list(T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in extra.items())) if extra else []))

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in tk.text_slices(b.column(at)):
            got = kernel(s)
            out = pa.RecordBatch.from_arrays([*b.slice(s.first, s.n).columns, *(a if isinstance(a := got[k], pa.Array) else pa.array(a) for k in extra)], [*cols, *extra])
            yield out if keep is None else out.filter(pa.array(got[keep]))

    return map_arrow(docs.toDF(*cols), schema, fn)


def restore(mapped: DataFrame, docs: DataFrame) -> DataFrame:
    return mapped.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
