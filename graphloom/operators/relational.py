"""Relational building blocks that more than one query uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

#: Ids up to this many are a set in the plan; more are joined.
IN_SET = 1000


def by_ids(df: DataFrame, col: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows whose col is among the ids; an empty list selects nothing."""
    if isinstance(ids, DataFrame):
        return df.join(ids.toDF(col).distinct(), col, "left_semi")
    if len(ids) <= IN_SET:
        return df.filter(F.col(col).isin(list(ids)))
    keys = df.sparkSession.createDataFrame([(i,) for i in ids], f"`{col}` {dict(df.dtypes)[col]}")
    return df.join(keys.distinct(), col, "left_semi")


def ends(triples: DataFrame, s: str = "s", o: str = "o", out: str = "entity", *keep: str) -> DataFrame:
    """Subjects and objects in one scan instead of a union of two."""
    return triples.select(F.explode(F.array(s, o)).alias(out), *keep)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: Column | str) -> DataFrame:
    """old with new's rows in place of those of equal keys; within new the last by sequence wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence) if isinstance(sequence, str) else sequence.desc())
    last = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*old.columns)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def best_per_pair(triples: DataFrame, s: str, p: str, o: str, tie: str, mode: str = "row") -> DataFrame:
    """Of each (s, o) pair the predicate that most of its triples have; rows with an empty object all stay.

    mode "row" keeps one row of it, "predicate" all.  Support is a window over (s, o, p) that shares the exchange on
    (s, o); the rank filter stands alone on rows with an object, so Spark limits groups before the shuffle.
    """
    some = triples.filter(F.col(o).isNotNull() & (F.col(o) != ""))
    none = triples.filter(F.col(o).isNull() | (F.col(o) == ""))
    pair = Window.partitionBy(s, o)
    d = some.withColumn("_support", F.count("*").over(Window.partitionBy(s, o, p)))
    order = [F.desc("_support"), F.asc(p)]
    rank = F.row_number().over(pair.orderBy(*order, tie)) if mode == "row" else F.dense_rank().over(pair.orderBy(*order))
    return d.withColumn("_rank", rank).filter("_rank = 1").drop("_support", "_rank").unionByName(none)


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """df with each row's place from 1 in this order.  Rows are split into ranges, ranked within each, and moved up by the
    counts of the ranges before: no task sorts all rows."""
    placed = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    r = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_r", r).join(F.broadcast(base), "_p").withColumn(out, (F.col("_r") + F.col("_base")).cast("long")).drop("_p", "_r", "_base")


def either_end(triples: DataFrame, members: DataFrame, node: str = "node_id") -> DataFrame:
    """triples joined to members ON s = node OR o = node, as two equi-joins: the disjunction alone would be a nested loop."""
    return triples.join(members, F.col("s") == F.col(node)).unionByName(triples.join(members, F.col("o") == F.col(node)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """v at length one; null if it has none, so that what is measured against many vectors is scaled once."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Null if either norm is zero."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot(a, b), norm(a) * norm(b))
