"""Canonical entities and predicates: lemmas, synonyms, similar names, a judge for the doubtful, and the map that results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import extraction
from .canonical import cluster_names, cluster_vectors, merge_candidates, similar_pairs
from .graph import components
from .relational import best_per_pair, ends
from .shared import materialize, spread

#: Says of pairs of names which are one thing.
Judge = Callable[[list[tuple[str, str]]], list[bool]]


def same_letters(pairs: list[tuple[str, str]]) -> list[bool]:
    """An offline judge: equal lemmas but for case, spaces and punctuation."""
    key = lambda x: "".join(c for c in extraction.lemma(x) if c.isalnum())
    return [key(a) == key(b) for a, b in pairs]


def is_name(name: Column) -> Column:
    """Whether all of it reads as a proper name: capitalised words with small joints between; an approximation of a tagger."""
    return F.coalesce(name.rlike(r"^\p{Lu}[\p{L}'’.-]*(?:\s+(?:(?:of|the|de|von|van|al|ibn|da|du)\s+)*\p{Lu}[\p{L}'’.-]*)*\z"), F.lit(False))


def name_flags(entities: DataFrame, entity: str = "entity", named: Column | None = None) -> DataFrame:
    """entity_orig, entity_canon (its lemma) and is_named: a lemma counts as a name if any of its originals is one."""
    e = entities.select(F.col(entity).alias("entity_orig")).filter("entity_orig is not null and entity_orig <> ''").distinct()
    flag = is_name(F.col("entity_orig")) if named is None else named
    m = extraction.lemmatize(e, "entity_orig", "entity_canon").withColumn("own", flag)
    return m.join(m.groupBy("entity_canon").agg(F.bool_or("own").alias("is_named")), "entity_canon").select("entity_orig", "entity_canon", "is_named")


def judged_pairs(pairs: DataFrame, judge: Judge | None, most: int = 500, batch: int = 25) -> DataFrame:
    """a, b: what the judge calls one thing among the `most` most promising pairs (score, then frequency, then names).

    pairs: a, b, score, n.  The limit is what a judge is worth asking; without one nothing is called the same.
    """
    spark = pairs.sparkSession
    asked = [(r.a, r.b) for r in pairs.orderBy(F.desc("score"), F.desc("n"), "a", "b").limit(most).collect()] if judge else []
    same = [p for i in range(0, len(asked), batch) for p, ok in zip(asked[i : i + batch], judge(asked[i : i + batch]), strict=True) if ok]
    return spark.createDataFrame(same, "a string, b string")


def cluster(terms: DataFrame, pairs: DataFrame, least: float, blocked: DataFrame, forced: DataFrame) -> DataFrame:
    """name, canonical.  terms: name, n, embedding; pairs: a, b, score of at least `least`; blocked and forced: a, b.

    Components of links are found distributed; each is refined and named in a task of its own, which gets just its terms.
    """
    links = materialize(pairs.filter(F.col("score") >= least).select("a", "b").join(blocked, ["a", "b"], "left_anti").unionByName(forced).distinct(), "links")
    comp = components(links, "a", "b").toDF("name", "component")
    inside = terms.select("name", "n", "embedding").join(comp, "name")
    rule = blocked.withColumn("kind", F.lit("blocked")).unionByName(forced.withColumn("kind", F.lit("forced"))).join(comp.toDF("a", "part"), "a").select("part", "a", "b", "kind")

    def run(_: tuple, d: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame({"name": [], "canonical": []})
        d = d.sort_values("name")
        sets = {k: set(zip(g["a"], g["b"], strict=True)) for k, g in r.groupby("kind")}
        got = cluster_names(list(d["name"]), np.array(d["embedding"].tolist(), float), dict(zip(d["name"], d["n"], strict=True)), least, sets.get("blocked", set()), sets.get("forced", set()))
        return pd.DataFrame({"name": list(got), "canonical": list(got.values())})

    merged = inside.groupBy("component").cogroup(rule.groupBy("part")).applyInPandas(run, "name string, canonical string")
    return terms.select("name").join(merged, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def merge_entities(terms: DataFrame, least: float = 0.92, judge: Judge | None = same_letters, margin: float = 0.07, boost: float = 0.05, most_judged: int = 500) -> DataFrame:
    """name, canonical.  terms: name, n, embedding, is_named.

    Two names need `boost` more and are kept apart below that; pairs within `margin` under their threshold go to the judge,
    whose yes outweighs all else.  Names of one vector are never apart, so all but the last step see each vector once.
    """
    one = F.sha2(F.col("embedding").cast("string"), 256)
    if least + boost > 1 - 1e-9:  # names of one vector may be blocked
        one = F.sha2(F.concat(F.col("embedding").cast("string"), F.lit(" "), "name"), 256)
    some = F.exists("embedding", lambda x: x != 0)
    t = materialize(terms.select("name", "n", "embedding", F.coalesce("is_named", F.lit(False)).alias("is_named"), F.when(some, F.unhex(one)).alias("vec")), "terms")
    v = t.filter("vec is not null").groupBy("vec").agg(F.any_value("embedding").alias("embedding"), F.count("*").alias("count"), F.bool_or("is_named").alias("has_named"), F.bool_or(~F.col("is_named")).alias("has_other"))
    first = Window.partitionBy("vec").orderBy(F.desc("n"), F.desc(F.length("name")), F.desc(F.lower("name")), "name")
    lead = t.filter("vec is not null").select("vec", "name", "n").withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
    v = materialize(v.join(lead, "vec"), "vectors")
    found = materialize(merge_candidates(v.select(F.col("vec").alias("id"), F.col("embedding").alias("v"), "has_named", "has_other"), least, margin, boost, most_judged if judge else 0), "candidates")
    forced = judged_pairs(_open_names(t, v, found.filter("kind = 'open'"), least, margin, boost, most_judged), judge, most_judged) if judge else None
    yes: dict[bytes, dict[bytes, int]] = {}
    links = found.filter("kind = 'link'").select("a", "b")
    if forced is not None:
        side = lambda c: t.select(F.col("name").alias(c), F.col("vec").alias(f"vec_{c}"))
        for r in forced.join(side("a"), "a").join(side("b"), "b").groupBy("vec_a", "vec_b").agg(F.count_distinct("a", "b").alias("n")).collect():  # a judge's few
            a, b = sorted((bytes(r.vec_a), bytes(r.vec_b)))
            yes.setdefault(a, {})[b] = yes.get(a, {}).get(b, 0) + r.n
        links = links.unionByName(t.sparkSession.createDataFrame([(a, b) for a, to in yes.items() for b in to], "a binary, b binary"))
    comp = components(links, "a", "b").toDF("vec", "component")
    inside = v.join(comp, "vec").select("component", "vec", "name", "n", "count", (~F.col("has_other")).alias("named"), "embedding")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("name")
        at = {bytes(x): i for i, x in enumerate(d["vec"])}
        must = {tuple(sorted((at[a], at[b]))): n for a in at if a in yes for b, n in yes[a].items() if b in at}
        got = cluster_vectors(list(d["name"]), d["n"].to_numpy(), d["count"].to_numpy(), d["named"].to_numpy(bool), np.array(d["embedding"].tolist(), float), least, boost, must)
        return pd.DataFrame({"vec": d["vec"], "canonical": got})

    merged = inside.repartition(spread(v), "component").groupBy("component").applyInPandas(run, "vec binary, canonical string")
    named = v.select("vec", "name").join(merged, "vec", "left").select("vec", F.coalesce("canonical", "name").alias("canonical"))
    return t.select("name", "vec").join(named, "vec", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def _open_names(t: DataFrame, v: DataFrame, found: DataFrame, least: float, margin: float, boost: float, most: int) -> DataFrame:
    """a, b, score, n of pairs of names that may be among the `most` that the judge is asked about: those of the best pairs of
    vectors, and of each vector's names no more than could be asked about."""
    last = found.orderBy(F.desc("score")).limit(most).agg(F.min("score").alias("last"))
    top = materialize(found.join(F.broadcast(last), F.col("score") >= F.col("last")).select("a", "b", "score"), "open")
    own = top.select(F.explode(F.array("a", "b")).alias("vec")).distinct()
    rank = F.row_number().over(Window.partitionBy("vec", "is_named").orderBy(F.desc("n"), "name"))
    names = materialize(t.select("vec", "name", "n", "is_named").join(own, "vec", "left_semi").withColumn("r", rank).filter(F.col("r") <= most).drop("r"), "open-names")
    side = lambda c: names.select(F.col("vec").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("name", "n", "is_named")))
    p = top.join(side("a"), "a").join(side("b"), "b")
    needed = F.lit(least) + F.when(F.col("is_named_a") & F.col("is_named_b"), boost).otherwise(0.0)
    p = p.filter((F.col("score") < needed) & (F.col("score") >= needed - margin))
    return p.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "score", (F.col("n_a") + F.col("n_b")).alias("n"))


def canonical_predicates(predicates: DataFrame, least: float = 0.88, min_count: int = 2, make: Callable = extraction.HashEmbedder) -> DataFrame:
    """predicate, canonical.  predicates: predicate, n.  Synonyms of the text, else of its lemma, else the lemma; forms of
    which one predicate at least is frequent are clustered by their vectors, except active with passive and opposed roles."""
    p = predicates.filter("predicate is not null and predicate <> ''")
    lemmas = extraction.lemmatize(p.select(F.lower(F.trim("predicate")).alias("low")), "low", "lemma")
    j = p.withColumn("low", F.lower(F.trim("predicate"))).join(lemmas, "low")
    form = F.coalesce(X.canonical_predicate(F.col("low")), X.canonical_predicate(F.col("lemma")), F.col("lemma"))
    first = materialize(j.select("predicate", "n", form.alias("form")), "forms")
    forms = first.groupBy("form").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(F.col("most") >= min_count)
    terms = materialize(extraction.embed(forms, "form", "form", make).join(forms.select("form", "n"), "form").withColumnRenamed("form", "name"), "forms")
    pairs = materialize(similar_pairs(terms, "name", least), "pairs")
    apart = X.is_inverse_pair(F.col("a"), F.col("b")) | X.roles_conflict(F.col("a"), F.col("b"))
    none = pairs.select("a", "b").limit(0)
    merged = cluster(terms, pairs, least, pairs.filter(apart).select("a", "b"), none)
    return first.join(merged.withColumnRenamed("name", "form"), "form", "left").select("predicate", F.coalesce("canonical", "form").alias("canonical"))


def remapped(canon_map: DataFrame, merged: DataFrame) -> DataFrame:
    """canon_map (entity_orig, entity_canon) with merged (name, canonical) applied once."""
    m = merged.filter("name <> canonical").toDF("entity_canon", "new")
    return canon_map.join(m, "entity_canon", "left").select("entity_orig", F.coalesce("new", "entity_canon").alias("entity_canon"))


def canonicalize_all(triples: DataFrame, entity_least: float = 0.92, predicate_least: float = 0.88, judge: Judge | None = same_letters, min_count: int = 2, make: Callable = extraction.HashEmbedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lemmas, predicates, similar names and one predicate a pair, in this order.

    triples: triple_id, chunk_id, s, p, o -> (the same with canonical ends and predicate, entity map, predicate map).
    """
    t = materialize(triples.select("triple_id", "chunk_id", "s", "p", "o"), "triples")
    flags = materialize(name_flags(ends(t)), "names")
    preds = materialize(canonical_predicates(t.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n")), predicate_least, min_count, make), "predicates")
    counts = ends(t).groupBy(F.col("entity").alias("entity_orig")).agg(F.count("*").alias("n"))
    often = flags.join(counts, "entity_orig").groupBy(F.col("entity_canon").alias("name")).agg(F.sum("n").alias("n"), F.bool_or("is_named").alias("is_named")).filter(F.col("n") >= min_count)
    vectors = extraction.embed(often.select("name"), "name", "name", make)
    names = materialize(remapped(flags.select("entity_orig", "entity_canon"), merge_entities(often.join(vectors, "name"), entity_least, judge)), "entity-map")
    end = lambda c: names.toDF(c, f"{c}2")
    done = t.join(end("s"), "s", "left").join(end("o"), "o", "left").join(preds.toDF("p", "p2"), "p", "left")
    out = done.select("triple_id", "chunk_id", F.coalesce("s2", "s").alias("s"), F.coalesce("p2", "p").alias("p"), F.coalesce("o2", "o").alias("o"))
    return best_per_pair(out, "s", "p", "o", "triple_id"), names, preds
