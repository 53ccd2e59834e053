"""Citation numbers across the messages of a conversation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def indexes(messages: DataFrame) -> DataFrame:
    """conv_id, key, idx: each citation's number by first appearance in its conversation.

    messages: conv_id, turn, content, cites (array of keys; [n] in the content means the nth).  Only messages' own marks
    count as appearances; a message without marks shows its citations in order.
    """
    marks = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int")))
    order = F.when(F.size(marks) > 0, marks).otherwise(F.when(F.size("cites") > 0, F.sequence(F.lit(1), F.size("cites"))).otherwise(F.expr("cast(array() as array<int>)")))
    each = messages.select("conv_id", "turn", "cites", F.posexplode(order).alias("pos", "n")).select("conv_id", "turn", "pos", F.get("cites", F.col("n") - 1).alias("key")).filter("key is not null")
    first = each.groupBy("conv_id", "key").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return first.select("conv_id", "key", F.row_number().over(Window.partitionBy("conv_id").orderBy("at")).alias("idx"))


@F.pandas_udf(T.StringType())
def _rewrite(content: pd.Series, cites: pd.Series, numbers: pd.Series) -> pd.Series:
    out = []
    for text, keys, idx in zip(content, cites, numbers, strict=True):
        keys, idx = list(keys if keys is not None else []), dict(idx or {})

        def new(m: re.Match, keys=keys, idx=idx) -> str:
            k = int(m[1]) - 1
            return f"[{idx[keys[k]]}]" if 0 <= k < len(keys) and keys[k] in idx else m[0]

        out.append(None if text is None else re.sub(r"\[(\d{1,6})\]", new, text))
    return pd.Series(out)


def renumber(messages: DataFrame) -> DataFrame:
    """conv_id, turn and content with every mark replaced by its citation's number."""
    table = indexes(messages).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "idx"))).alias("numbers"))
    j = messages.join(table, "conv_id", "left")
    return j.select("conv_id", "turn", _rewrite("content", "cites", "numbers").alias("content"))
