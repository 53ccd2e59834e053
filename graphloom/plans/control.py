"""Phases, gates and sessions around the engine, as data."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Phases of a question and those that may follow.  Scope can't be cleared once set, and synthesis is entered from a walk.
TRANSITIONS = {
    "session": ("guard", "scope", "retrieval"),
    "guard": ("scope", "retrieval"),
    "scope": ("retrieval",),
    "retrieval": ("traversal",),
    "traversal": ("synthesis",),
    "synthesis": ("done",),
    "done": (),
}
#: Tools of each phase, beside noting a thought, which every open phase allows.
TOOLS = {
    "session": "skip_guard skip_scope guard_relevance detect_followup",
    "guard": "skip_scope skip_guard guard_relevance",
    "scope": "skip_scope set_scope list_available_sources",
    "retrieval": "advance_to_traversal get_chunk_content get_entities_from_chunks get_collected_chunks get_seed_entities_for_communities read_community_summary search_community_reports search_vectors",
    "traversal": "advance_to_synthesis get_chunk_content get_traversal_state backtrack expand_node get_collected_chunks get_seed_entities_for_communities",
    "synthesis": "synthesize_answer",
    "done": "",
}


class Session:
    """Where one question is, what it read and the path it walked."""

    def __init__(self):
        self.phase, self.path, self.read, self.thoughts = "session", [], [], []

    def allow(self, tool: str) -> bool:
        return tool in TOOLS[self.phase].split() or (tool == "sequential_thinking" and self.phase != "done")

    def advance(self, phase: str) -> None:
        if phase not in TRANSITIONS[self.phase]:
            raise ValueError(f"{phase} can't follow {self.phase}")
        self.phase = phase

    def visit(self, node: str) -> None:
        self.path.append(node)

    def backtrack(self) -> str | None:
        """One step back; the node that is current then."""
        if self.path:
            self.path.pop()
        return self.path[-1] if self.path else None

    def think(self, text: str) -> int:
        self.thoughts.append(text)
        return len(self.thoughts)

    @staticmethod
    def walk_cap(wanted: int) -> int:
        return max(4, min(24, wanted))


def transitions(spark: SparkSession) -> DataFrame:
    """prev, phase: the allowed steps, to audit a log against."""
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "prev string, phase string")


def valid_like_pattern(pattern: object) -> bool:
    """A pattern that may join the noise rules: plain words between % signs, nothing that could end a statement."""
    return isinstance(pattern, str) and re.fullmatch(r"[%_\w\s.\-]+", pattern.strip()) is not None and "--" not in pattern and pattern.strip("%_ ") != ""


def confirm_patterns(triples: DataFrame, patterns: list[str], judge: Callable[[str, list[str]], bool] | None = None, samples: int = 10) -> list[str]:
    """The well-formed patterns that match something and that the judge, shown a few matches, keeps.

    All patterns are sampled in one pass.  Without a judge the form decides.
    """
    good = [p for p in dict.fromkeys(patterns) if valid_like_pattern(p)]
    if judge is None or not good:
        return good
    hit = lambda p: F.lower("subject_norm").like(p.lower()) | F.lower("object_norm").like(p.lower())
    rows = triples.select(F.explode(F.array(*(F.when(hit(p), F.lit(p)) for p in good))).alias("p"), "subject_norm").filter("p is not null").distinct()
    r = F.row_number().over(Window.partitionBy("p").orderBy("subject_norm"))
    found: dict[str, list[str]] = {}
    for x in rows.withColumn("r", r).filter(F.col("r") <= samples).orderBy("p", "r").collect():  # a few rows a pattern
        found.setdefault(x.p, []).append(x.subject_norm)
    return [p for p in good if p in found and judge(p, found[p])]


def provenance_failures(mentions: DataFrame, chunks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """entity, total, failed: names of two mentions or more, over half of them not to be found in their chunk's text."""
    j = mentions.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("ratio", X.fuzzy_presence(F.col("entity"), F.col("content")))
    g = j.groupBy("entity").agg(F.count("*").alias("total"), F.count_if(F.col("ratio") < threshold).alias("failed"))
    return g.filter("total >= 2 and failed / total > 0.5")


def audit(log: DataFrame, allowed: DataFrame, key: str, at: str, what: str) -> DataFrame:
    """Each step of a log and whether it may follow the one before; allowed: prev, what."""
    prev = F.lag(what).over(Window.partitionBy(key).orderBy(at))
    j = log.select(key, at, what, prev.alias("prev")).join(allowed.withColumn("ok", F.lit(True)), ["prev", what], "left")
    return j.select(key, at, (F.col("prev").isNull() | F.coalesce("ok", F.lit(False))).alias("valid"))


def gate(cited: DataFrame, read: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """query_id and passes: something is cited, all of it was read, and on a follow-up something is new."""
    c = cited.join(read.withColumn("r", F.lit(True)), ["query_id", "chunk_id"], "left")
    new = F.lit(True)
    if before is not None:
        c = c.join(before.withColumn("b", F.lit(True)), ["query_id", "chunk_id"], "left")
        new = F.max(F.col("b").isNull())
    return c.groupBy("query_id").agg((F.min(F.coalesce("r", F.lit(False))) & new).alias("passes"))
