"""Small cases of rules, text functions, chunkers, clusters, graphs, sessions, catalog and pipeline."""

import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.config import EngineConfig
from graphloom.functions import citations
from graphloom.functions import text as X
from graphloom.operators import canonical, chunking, extraction, graph, relational, retrieval
from graphloom.operators import rules as R
from graphloom.operators import scope_text as S
from graphloom.pipeline import STAGES, Pipeline
from graphloom.plans import control
from graphloom.sources import files, sinks
from graphloom.sources.catalog import Catalog
from graphloom.streaming import state


def column(spark, values, expr, kind="string"):
    d = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in d.orderBy("i").select(expr(F.col("x"))).collect()]


def test_triple_guard(spark):
    rows = [("They", "do", "good"), ("soul", "is", "it"), ("Chapter", "has", "x1"), ("soul", "is", "table of contents"), ("_n_", "is", "soul"), ("a", "is", "soul"), ("soul", "is", "ab"), ("one two three four five six seven eight nine", "is", "soul"), ("soul", "has copyright", "form"), ("soul", "moves", "body"), ("soul", "lives", None)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, s string, p string, o string")
    got = [r[0] for r in d.orderBy("k").select(R.triple_rejection_reason("s", "p", "o")).collect()]
    assert got[:10] == ["pronoun_subject", "pronoun_object", "structural_subject", "structural_object", "placeholder_subject", "single_letter_subject", "very_short_ascii_object", "entity_too_long_subject", "legal_boilerplate_triple", None]
    assert got[10] is None


def test_chunk_guard(spark):
    toc = "\n".join(f"Chapter {k}" for k in range(1, 12))
    texts = [None, " \n ", "All rights reserved.", "Table of Contents\nx", toc, "\n".join(["prose line about things"] * 8 + [f"the Book {k} says" for k in ("II", "III", "IV", "V", "VI")]), "soul, see also body\nform cf. matter\nx see under y\nz", "Chapter 1", "A plain paragraph about the soul and its powers."]
    assert column(spark, texts, lambda c: R.chunk_skip_reason("x")) == ["empty_chunk", "empty_chunk", "legal_boilerplate_chunk", "table_of_contents_chunk", "structural_heading_chunk", "toc_like_chapter_listing", "index_glossary_chunk", "short_header_only_chunk", None]


def test_labels_and_predicates(spark):
    assert column(spark, ["Thing", "of", "god", "substance"], R.is_stop_label) == [True, True, False, False]
    assert column(spark, ["soul", "the soul", "body without form", "cats and dogs", "x-ray", "", None], R.is_low_quality_label) == [False, True, True, True, True, True, False]
    assert column(spark, ["and", "is", "is cause of", "likes"], R.predicate_weight) == [0.0, 0.2, 1.5, 1.0]


def test_noise_keeps_three_valued_logic(spark):
    d = spark.createDataFrame([("good soul", "is", None, "T", "T"), ("gutenberg soul", "is", "x", "T", "T")], "subject_norm string, predicate_norm string, object_norm string, subject_type string, object_type string")
    assert d.filter(~R.noise(["%gutenberg%"])).count() == 0  # the null object leaves the first open
    assert d.filter(R.legacy_noise()).count() == 1


def test_text_functions(spark):
    assert column(spark, ['  "Republic"  ', "[x\n y]"], X.normalize_entity) == ["Republic", "x y"]
    assert column(spark, ["depends_on", " Is-Part_of "], X.normalize_predicate) == ["depends on", "is part of"]
    assert column(spark, ['```json\n{"a": 1}\n```', 'so: {"a": {"b": 2}} ok', "none"], X.json_block) == ['{"a": 1}', '{"a": {"b": 2}}', "none"]
    assert column(spark, ["Page 1\n\nfirst\tline\r\n\n\n\nsecond"], X.clean_text) == ["first line\n\nsecond"]
    assert column(spark, ["see [2], [1] and [2] and [9]"], lambda c: X.citation_refs(c, 3)) == [[2, 1]]
    assert column(spark, ["<b>a &amp; b</b>"], lambda c: X.collapse_whitespace(X.strip_html(c))) == ["a & b"]
    assert column(spark, ["hi", "hey there you", "I want a car", "what is the soul", "need one vehicle now"], X.is_irrelevant) == [True, True, True, False, True]
    assert column(spark, ["how to make a bomb", "what is justice"], X.is_unsafe) == [True, False]
    assert column(spark, ["x" * 4000], lambda c: F.size(X.overlapping_windows(c, 1800, 300))) == [3]
    with pytest.raises(ValueError):
        X.overlapping_windows(F.lit("x"), 10, 10)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('Body.\n\n[1] "A", [2] "B"', "Body."),
        ('Body.\n\n[1] "A"\n[2] "B"', "Body."),
        ('Body.\n\nSources:\n\n[1] "A", [2] "B"', "Body."),
        ("Body [1], [2].\n\nMore [3].", None),
        ("Body.\n\n[1] One note only.", None),
        ("Body.\n\nIn sum, this [1] and that [2].", None),
        ("Body.\n\n[1] starts prose that goes on [2], [3] for a while.", None),
    ],
)
def test_inventory(raw, want):
    assert X.strip_inventory(raw) == (raw if want is None else want)


def test_predicate_pairs(spark):
    d = spark.createDataFrame([("causes", "is caused by"), ("causes", "causing"), ("written by", "written in"), ("acts on", "acts upon")], "a string, b string")
    assert [tuple(r) for r in d.select(X.is_inverse_pair(F.col("a"), F.col("b")), X.roles_conflict(F.col("a"), F.col("b"))).collect()] == [(True, False), (False, False), (False, True), (False, False)]


def test_scope_of_a_question(spark):
    q = ["What does Aristotle say about ethics?", "the Buddhist view", "according to Kant, is there a self?"]
    assert column(spark, q, S.authors) == [["Aristotle"], [], ["Immanuel Kant"]]
    assert column(spark, q, S.traditions)[1] == ["Indian"] and column(spark, q, S.domains)[0] == ["Ethics"]


def test_chunkers():
    text = "\n\n".join(f"Paragraph {k} " + "word " * 20 for k in range(10))
    out = chunking.by_paragraph(text, 300, 60)
    whole = out[-1]
    assert whole[0] == "document" and all(c == whole[3][a:z] for _, a, z, c in out)
    assert all(z - a <= 300 for level, a, z, _ in out if level == "local")
    assert chunking.by_paragraph("") == [] and chunking.by_meaning(" ") == []
    assert chunking.by_meaning("One sentence only.") == [("local", 0, 18, "One sentence only.")]
    parts = chunking.by_meaning("The soul moves. The soul thinks. Ships sail far. Ships need wind. " * 8, 120, 20)
    assert len(parts) > 3 and parts[-1][0] == "document"
    assert sum(len(p) for p in chunking.split_paragraphs("x" * 5000, 1000, 100)) == 5000 + 5 * 100


def test_clusters_split_chains_and_obey_pairs():
    v = np.array([[1, 0.0], [0.8, 0.6], [0.28, 0.96]])
    assert len(set(canonical.cluster_names(["a", "b", "c"], v, {}, 0.75).values())) >= 2
    same = np.array([[1, 0.0], [1, 0.01], [1, 0.02]])
    assert canonical.cluster_names(["x", "yy", "z"], same, {"x": 5}, 0.9)["z"] in ("x", "yy")
    blocked = canonical.cluster_names(["x", "y"], same[:2], {}, 0.9, blocked={("x", "y")})
    assert blocked == {"x": "x", "y": "y"}
    forced = canonical.cluster_names(["x", "y"], np.eye(2), {}, 0.9, blocked={("x", "y")}, forced={("x", "y")})
    assert len(set(forced.values())) == 1


def test_similar_pairs_against_brute_force(spark):
    x = np.random.default_rng(0).standard_normal((60, 8))
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if n[i] @ n[j] >= 0.5}
    assert {(r.a, r.b) for r in canonical.similar_pairs(d, "id", 0.5, blocks=4).collect()} == want


def test_leiden_invariants():
    r = random.Random(1)
    pairs = {tuple(sorted((a, b))) for g in range(6) for _ in range(80) for a, b in [r.sample(range(20 * g, 20 * g + 20), 2)]} | {tuple(sorted(r.sample(range(120), 2))) for _ in range(40)}
    u, v = (np.array(x) for x in zip(*sorted(pairs)))
    w = np.ones(len(u))
    labels = graph.leiden(u, v, w, 120)
    assert (labels == graph.leiden(u, v, w, 120)).all() and labels.max() < 20
    assert graph.modularity(u, v, w, labels) > 0.6 > graph.modularity(u, v, w, np.arange(120))
    for c in range(labels.max() + 1):  # connected
        inside = set(np.flatnonzero(labels == c))
        reach, todo = set(), [min(inside)]
        while todo:
            i = todo.pop()
            if i not in reach:
                reach.add(i)
                todo += [int(b) for a, b in list(zip(u, v)) + list(zip(v, u)) if a == i and b in inside]
        assert reach == inside


def test_components(spark):
    d = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("f", "f")], "x string, y string")
    assert {r.node: r.component for r in graph.components(d, "x", "y").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_walk_respects_limits():
    c = pd.DataFrame([("a", "b", "p", 0.2, 1.0, ["1"]), ("a", "c", "p", 0.1, 1.0, ["2"]), ("b", "d", "p", 0.2, 1.0, ["3"]), ("a", "x", "and", 0.2, 0.0, ["4"])], columns=["s", "o", "label", "edge_score", "pw", "chunks"])
    info = {n: (0.1, True, None) for n in "abcdx"}
    steps = graph.best_first(c, ["a", "zz"], info, 2, 50, 20, 25, 120)
    assert [s[1] for s in steps] == ["a", "b", "d", "c"] and [s[4] for s in steps] == [0, 1, 2, 1]
    assert [s[1] for s in graph.best_first(c, ["a"], info, 1, 50, 20, 25, 120)] == ["a", "b", "c"]
    assert [s[1] for s in graph.best_first(c, ["a"], info, 2, 1, 20, 25, 120)] == ["a", "b"]
    assert [s[1] for s in graph.best_first(c, ["a"], info, 2, 50, 20, 1, 120)] == ["a", "b", "d"]
    assert [s[1] for s in graph.best_first(c, ["a"], info | {"b": (0.1, False, None)}, 2, 50, 20, 25, 120)] == ["a", "c"]


def test_disjunctive_join_is_no_nested_loop(spark):
    t = spark.createDataFrame([("a", "b", "1"), ("c", "a", "2")], "s string, o string, chunk_id string")
    m = spark.createDataFrame([("a",)], "node_id string")
    plan = relational.either_end(t, m)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and relational.either_end(t, m).count() == 2


def test_scope(spark):
    f = spark.createDataFrame([(1, "T", "A", "x", "en;fr"), (2, "U", "B", "y", "de")], "text_id int, title string, author_source string, tradition string, domains string")
    c = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk_id string, text_id int")
    assert [r[0] for r in retrieval.Scope(authors=("A",), domains=("fr",)).chunks(f, c).collect()] == ["c1"]
    assert retrieval.Scope(authors=("Z",)).chunks(f, c).count() == 0 and retrieval.Scope().chunks(f, c).count() == 2
    with pytest.raises(retrieval.ScopeViolation):
        retrieval.check_scope(c, c.filter("chunk_id = 'c1'").select("chunk_id"), "test")


def test_rate_limit(spark):
    rows = [(k, "u" if k % 2 else "w", (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()) for k, s in enumerate((0, 0, 10, 10, 59, 59, 61, 61, 130, 500))]
    d = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    got = {r.id: r.allowed for r in state.fixed_window_limit(d, "key", "ts", "id", 2, 60).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True, 9: True}


def test_streams_equal_batches(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.repartition(3).write.parquet(src)
    q = state.stream_windows(spark.readStream.schema(e.schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == e.count()
    cat = Catalog(spark, str(tmp_path / "cat"))
    up = state.stream_upsert(spark.readStream.schema(e.schema).parquet(src), lambda b, _: cat.merge("events", b.withColumn("seq", F.lit(1)), ["event_id"], "seq"), str(tmp_path / "ck"))
    up.awaitTermination()
    assert cat.read("events").count() == e.select("event_id").distinct().count()


def test_citations(spark):
    m = spark.createDataFrame([("a", 1, "x [2] y [1]", ["k1", "k2"]), ("a", 2, "z [1] [7]", ["k1"]), ("a", 3, "none", ["k9"])], "conv_id string, turn int, content string, cites array<string>")
    assert {r.key: r.idx for r in citations.indexes(m).collect()} == {"k2": 1, "k1": 2, "k9": 3}
    assert [r.content for r in citations.renumber(m).orderBy("turn").collect()] == ["x [1] y [2]", "z [2] [7]", "none"]


def test_files(spark, tmp_path):
    (tmp_path / "0001_Critique_of_Pure_Reason_Kant.txt").write_bytes("Text é".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("c1.xhtml", "<p>One &amp; two</p>")
    (tmp_path / "skip.md").write_text("x")
    found = files.listing(spark, str(tmp_path))
    meta = {r.ext: r for r in files.metadata(found.withColumnRenamed("path", "file_path").select("file_path")).collect()}
    assert (meta[".txt"].text_id, meta[".txt"].title, meta[".txt"].author) == (2, "Critique of Pure Reason", "Kant") and len(meta) == 2
    assert sorted(r.text for r in files.load_texts(found).collect()) == ["One & two", "Text é"]
    with pytest.raises(ValueError):
        files.decode_pdf(b"")


def test_catalog_and_sinks(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    assert c.tables() == [] and c.read("t", "a int").count() == 0
    c.append("t", spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"))
    c.merge("t", spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "z", 1)], "a int, b string, seq int"), ["a"], "seq")
    c.overwrite("t", c.read("t").filter("a <> 1"))
    assert sorted(map(tuple, c.read("t").collect())) == [(2, "new"), (3, "z")] and c.counts() == {"t": 2}
    with pytest.raises(PermissionError):
        Catalog(spark, c.root, read_only=True).append("t", c.read("t"))
    e = spark.createDataFrame([("a", "b", "p<q", 2, ["1", "2"])], "s string, o string, label string, weight long, chunks array<string>")
    assert sinks.write_graphml(e, str(tmp_path / "g.xml")) == 1 and "p&lt;q" in (tmp_path / "g.xml").read_text()
    sinks.save_graph(e.select("s"), e, str(tmp_path / "g"))
    assert sinks.load_graph(spark, str(tmp_path / "g"))[1].count() == 1


def test_config(tmp_path):
    c = EngineConfig(chunk_max_chars=9, chunk_overlap=500, chunk_method="?").clamped()
    assert (c.chunk_max_chars, c.chunk_overlap, c.chunk_method) == (200, 100, "paragraph")
    c.save(str(tmp_path / "c.json"))
    assert EngineConfig.load(str(tmp_path / "c.json")) == c and c.merged({"nope": 1, "resolution": None}) == c


def test_judge_is_asked_again_and_fails_closed(spark):
    class Judge(extraction.OfflineExtractor):
        def __init__(self):
            self.asked = 0

        def triples(self, text):
            return [("Soul", "moves", "Body"), ("Form", "shapes", "Matter"), ("They", "are", "Many")]

        def keep(self, t):
            self.asked += 1
            return [True if self.asked == 1 and x[0] != "Form" else None for x in t]

    d = spark.createDataFrame([("c1", "Prose about the soul and the body."), ("c2", "All rights reserved")], "chunk_id string, content string")
    got = {(r.kind, r.subject, r.reason) for r in extraction.extract(d, Judge).collect()}
    assert got == {("triple", "Soul", None), ("rejection", "Form", "no_verdict"), ("rejection", "They", "pronoun_subject"), ("skip", None, "legal_boilerplate_chunk")}


def test_control(spark):
    s = control.Session()
    assert s.allow("guard_relevance") and not s.allow("expand_node") and s.think("x") == 1
    for p in ("scope", "retrieval", "traversal"):
        s.advance(p)
    with pytest.raises(ValueError):
        s.advance("scope")
    s.visit("a")
    s.visit("b")
    assert s.backtrack() == "a" and s.backtrack() is None and s.allow("backtrack") and control.Session.walk_cap(99) == 24
    log = spark.createDataFrame([(1, 1, "session"), (1, 2, "scope"), (1, 3, "done")], "q int, t int, phase string")
    assert [r.valid for r in control.audit(log, control.transitions(spark), "q", "t", "phase").orderBy("t").collect()] == [True, True, False]
    t = spark.createDataFrame([("gutenberg ebook", "x"), ("soul", "form")], "subject_norm string, object_norm string")
    assert control.confirm_patterns(t, ["%gutenberg%", "%zzz%", "%soul%", "%'; drop"], lambda p, m: "soul" not in m) == ["%gutenberg%"]
    m = spark.createDataFrame([("soul", "1"), ("soul", "2"), ("quark", "1"), ("quark", "2")], "entity string, chunk_id string")
    c = spark.createDataFrame([("1", "The soul is form."), ("2", "Of the soul we speak.")], "chunk_id string, content string")
    assert [tuple(r) for r in control.provenance_failures(m, c).collect()] == [("quark", 2, 2)]
    cited = spark.createDataFrame([(1, "1"), (2, "9")], "query_id int, chunk_id string")
    read = spark.createDataFrame([(1, "1"), (2, "2")], "query_id int, chunk_id string")
    assert {r.query_id: r.passes for r in control.gate(cited, read).collect()} == {1: True, 2: False}


def test_pipeline_is_idempotent(spark, tmp_path):
    res = tmp_path / "res"
    res.mkdir()
    for k, name in enumerate(("0001_Republic_Plato.txt", "0002_Nicomachean_Ethics_Aristotle.txt")):
        (res / name).write_text("\n\n".join(f"Virtue guides action number{k}. Justice orders cities well. Wisdom needs courage today." for _ in range(4)))
    p = Pipeline(Catalog(spark, str(tmp_path / "db")), EngineConfig(resources_dir=str(res)))
    first = p.run()
    assert set(first) == set(STAGES) and first["load"] == 2 and first["chunk"] >= 2 and first["graph"] > 0
    again = p.run(("load", "chunk", "extract", "embed"))
    assert set(again.values()) == {0}
    assert p.run(("clean",), dry_run=True)["clean"] == first["clean"]


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "res").mkdir()
    p = Pipeline(Catalog(spark, str(tmp_path / "db")), EngineConfig(resources_dir=str(tmp_path / "res")))
    assert p.run(("load",)) == {"load": 0}
