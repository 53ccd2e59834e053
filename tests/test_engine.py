"""Canonical forms, models, the agent, the engine under a scope, files and the command line."""

import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import aliases, canonicalization as C, models as M, retrieval, shared
from graphloom.operators.relational import global_rank
from graphloom.operators.views import Views
from graphloom.plans.agent import Agent
from graphloom.plans.engine import KnowledgeEngine
from graphloom.sources import files


def test_shared_folder_without_a_setting():
    class Sc:
        applicationId, master = "app-1", "local[2]"

        class Conf:
            get = staticmethod(lambda k: None)

        getConf = Conf

    class Session:
        sparkContext = Sc

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: None)

    at = shared.shared_dir(Session)
    assert at.startswith("file://") and shared.shared_dir(Session) == at
    shared._made.pop(at)
    Sc.applicationId, Sc.master = "app-2", "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_global_rank(spark):
    rng = np.random.default_rng(0)
    rows = [(int(x), i) for i, x in enumerate(rng.integers(0, 50, 500))]
    got = sorted((r.place, r.a, r.b) for r in global_rank(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "place").collect())
    assert got == [(k, *r) for k, r in enumerate(sorted(rows), 1)]
    assert global_rank(spark.createDataFrame([], "a long, b long"), ["a", "b"]).count() == 0


def unit(*x):
    return (np.array(x) / np.linalg.norm(x)).tolist()


def test_merge_of_entities(spark):
    near = lambda c: unit(c, np.sqrt(1 - c * c))  # noqa: E731  cosine c with (1, 0)
    t = [
        ("alpha", 5, [1.0, 0.0, 0.0, 0.0], False), ("alphas", 3, [*near(0.95), 0.0, 0.0], False),
        ("Kant", 9, [0.0, 0.0, 1.0, 0.0], True), ("Hume", 8, [0.0, 0.0, *near(0.95)], True),  # two names need 0.97
    ]
    d = spark.createDataFrame(t, "name string, n long, embedding array<double>, is_named boolean")
    got = {r.name: r.canonical for r in C.merge_entities(d, 0.92, judge=None).collect()}
    assert got["alpha"] == got["alphas"] == "alpha" and got["Kant"] == "Kant" and got["Hume"] == "Hume"
    asked = []

    def judge(pairs):
        asked.extend(pairs)
        return [True] * len(pairs)

    got = {r.name: r.canonical for r in C.merge_entities(d, 0.92, judge=judge).collect()}
    assert asked == [("Hume", "Kant")] and got["Kant"] == got["Hume"] == "Kant"
    m = spark.createDataFrame([("Alphas!", "alphas"), ("alpha", "alpha"), ("other", "other")], "entity_orig string, entity_canon string")
    merged = spark.createDataFrame([("alpha", "alpha"), ("alphas", "alpha")], "name string, canonical string")
    assert {tuple(r) for r in C.remapped(m, merged).collect()} == {("Alphas!", "alpha"), ("alpha", "alpha"), ("other", "other")}
    assert C.merge_entities(d.limit(0)).count() == 0


class Fixed:
    """Vectors that make all that is written alike."""

    def embed(self, texts):
        return [[1.0, 0.0] if "written" in t else [0.6, 0.8] if "caus" in t else [0.0, 1.0] for t in texts]


def test_predicates_keep_active_from_passive(spark):
    d = spark.createDataFrame([("qcausing by", 3), ("written in", 5), ("written by", 4), ("zzz", 1), ("", 2), (None, 2)], "predicate string, n long")
    got = {r.predicate: r.canonical for r in C.canonical_predicates(d, 0.9, make=Fixed).collect()}
    assert set(got) == {"qcausing by", "written in", "written by", "zzz"} and got["written in"] != got["written by"] and got["zzz"] == "zzz"


def test_canonicalize_all(spark):
    rows = [("1", "c1", "Cats", "likes", "dogs"), ("2", "c2", "cat", "likes", "dog"), ("3", "c3", "cat", "hates", "dog"), ("4", "c4", "bird", "eats", None)]
    t, names, _ = C.canonicalize_all(spark.createDataFrame(rows, "triple_id string, chunk_id string, s string, p string, o string"))
    assert {tuple(r)[:2] for r in names.collect()} >= {("Cats", "cat"), ("dogs", "dog")}
    got = {(r.s, r.o): r.p for r in t.collect()}
    assert set(got) == {("cat", "dog"), ("bird", None)} and t.count() == 2


class Talk:
    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def complete(self, system, user):
        self.seen.append((system, user))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


def test_models():
    x = M.ModelExtractor(Talk('```json\n{"chunks": [{"chunk_id": "0", "triples": [{"subject": "a", "subject_type": "Ghost", "predicate": "is", "object": "b", "object_type": "Work"}, {"subject": "a"}]}]}\n```'))
    assert x.typed("a is b") == [("a", "is", "b", "Concept", "Work")]
    assert M.ModelExtractor(Talk("no json")).triples("x") == []
    assert M.ModelExtractor(Talk('{"triples": [{"triple_id": 1, "keep": false}, {"triple_id": 0, "keep": "yes"}]}')).keep([("a", "b", "c")] * 2) == [None, False]
    with pytest.raises(M.FatalModelError):
        M.ModelExtractor(Talk(RuntimeError("Invalid API key"))).triples("x")
    assert M.ModelExtractor(Talk(RuntimeError("timeout"))).triples("x") == []
    with pytest.raises(M.FatalModelError):
        M.preflight(Talk(""))
    M.preflight(Talk("{}"))
    assert M.same_entity_judge(Talk('{"pairs": [{"pair": 1, "same": true}]}'))([("a", "b"), ("c", "d")]) == [False, True]
    t = Talk("It is so [1].")
    assert M.answer(t, "why?", ["because"]) == "It is so [1]." and "[1] because" in t.seen[0][1]
    assert "[1]" in M.answer(None, "why?", ["because"]) and M.answer(None, "why?", []) != ""
    assert M.guard(Talk('{"safe": false}'), "q") == M.UNSAFE and M.guard(Talk('{"relevant": false, "safe": true}'), "q") == M.IRRELEVANT and M.guard(Talk("?"), "q") is None
    assert M.is_follow_up(None, "And what of their laws in the later books?", [("a", "b")]) and not M.is_follow_up(None, "why?", [])


def test_agent_runs_a_script_and_moves_on_when_it_stalls(spark, data):
    v = Views(spark, data)
    script = [("expand_node", {"node": "x"}), ("skip_guard", {}), ("skip_scope", {}), ("search_vectors", {"vec_id": 0, "k": 3}), ("get_chunk_content", {"chunk_ids": ["1", "2"]}), ("get_collected_chunks", {}), ("advance_to_traversal", {}), ("expand_node", {"node": "supplier 1", "k": 2}), ("advance_to_synthesis", {}), ("synthesize_answer", {"text": "a", "cites": ["99"]}), ("synthesize_answer", {"text": "a [1]", "cites": ["1"]})]
    seen = []
    out = Agent(v, lambda q, phase, steps: script[len(steps)]).ask("why?", lambda kind, d: seen.append(kind))
    assert out["answer"] == "a [1]" and out["cites"] == ["1"] and out["phase"] == "done" and seen[-1] == "complete"
    assert [s["ok"] for s in out["trace"].steps][0] is False and "error" in out["trace"].steps[9]["seen"]
    assert out["trace"].table(spark).count() == len(script)
    stuck = Agent(v, lambda q, phase, steps: ("get_chunk_content", {"chunk_ids": ["1"]})).ask("why?")
    assert stuck["answer"] is None and any(s["tool"] == "moved_on" for s in stuck["trace"].steps) and stuck["calls"] < 40


def test_engine_stays_in_a_strict_scope(spark, data):
    v = Views(spark, data)
    q = spark.createDataFrame([(1, "Which part is it?", 3), (2, "Who supplies the part?", 5)], "query_id long, question string, vec_id long")
    free = KnowledgeEngine(v).answer(q).collect()
    assert {r.query_id for r in free} == {1, 2} and {r.tier for r in free} >= {1, 3} and max(r.place for r in free) <= 35
    for k in (1, 2):
        own = sorted((r.place, r.tier) for r in free if r.query_id == k)
        assert [t for _, t in own] == sorted(t for _, t in own) and [p for p, _ in own] == list(range(1, len(own) + 1))
    scope = retrieval.Scope(authors=("src0", "src3"))
    inside = {r.chunk_id for r in scope.chunks(v.files, v.chunks).collect()}
    got = KnowledgeEngine(v, scope=scope).answer(q).collect()
    assert got and {r.chunk_id for r in got} <= inside and not any(r.tier == 1 for r in got)


def test_walks_are_the_same_without_the_cut(spark):
    """Only so many of a node's out-edges reach a walk's task as it could take: more of them change nothing."""
    from graphloom.operators import graph as G

    rng = np.random.default_rng(5)
    rows = [(f"n{a}", "likes" if k % 2 else "knows", f"n{b}", "likes" if k % 2 else "knows", int(w), [f"c{k}"]) for k, (a, b, w) in enumerate(zip(rng.integers(0, 25, 900), rng.integers(0, 60, 900), rng.integers(1, 12, 900))) if a != b]
    e = spark.createDataFrame(rows, "s string, p string, o string, label string, weight long, chunks array<string>").dropDuplicates(["s", "p", "o"])
    names = [f"n{k}" for k in range(60)]
    flags = spark.createDataFrame([(n, n, k % 7 > 0) for k, n in enumerate(names)], "node_id string, label string, valid_expansion boolean")
    mem = spark.createDataFrame([(n, k % 4) for k, n in enumerate(names)], "node_id string, comm_id int")
    seeds = spark.createDataFrame([(q, f"n{q * 3 + j}", j) for q in range(4) for j in range(2)], "query_id long, node_id string, rank int")
    targets = spark.createDataFrame([(q, q % 4) for q in range(4)], "query_id long, comm_id int")
    words = spark.createDataFrame([(q, ["n"]) for q in range(4)], "query_id long, words array<string>")
    for small in (dict(max_hops=2, max_nodes=4, seed_cap=2, beam=3, max_chunks=50), dict(max_hops=3, max_nodes=12, seed_cap=1, beam=2, max_chunks=99)):
        walk = lambda **more: sorted(map(tuple, G.traverse(e, flags, seeds, mem, targets, words, **small, **more).drop("chunks").collect()), key=str)  # noqa: E731, B023
        assert walk() == walk(per_node=10**6) and len(walk()) > 8
        assert walk(per_node=1) != walk()


def test_ids_of_files_never_collide(spark, tmp_path):
    from graphloom.config import EngineConfig
    from graphloom.pipeline import Pipeline
    from graphloom.sources.catalog import Catalog

    at = tmp_path / "in"
    at.mkdir()
    (at / "b.txt").write_text("Beta is a word. It is here.")
    (at / "0001_One_Author.txt").write_text("One likes Two.")
    (at / "0001_Other_Author.txt").write_text("Other likes None.")
    c = Catalog(spark, str(tmp_path / "kg"))
    p = Pipeline(c, EngineConfig(resources_dir=str(at)))
    assert p.run(("load", "chunk"))["load"] == 3
    (at / "a.txt").write_text("Alpha comes first. It is new.")
    again = p.run(("load", "chunk"))
    assert again["load"] == 1 and again["chunk"] >= 1
    ids = {r.file_path.rsplit("/", 1)[1]: r.text_id for r in c.read("raw_texts").collect()}
    assert len(set(ids.values())) == 4 and ids["0001_One_Author.txt"] == 2
    assert c.read("files").count() == 4 and {r.text_id for r in c.read("chunks").select("text_id").distinct().collect()} == set(ids.values())
    assert p.run(("load", "chunk")) == {"load": 0, "chunk": 0}


def test_books_in_spine_order_and_plain_pdfs():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("OPS/a.xhtml", "<p>second</p>")
        z.writestr("OPS/b.xhtml", "<p>first</p>")
        z.writestr("OPS/c.xhtml", "<p>loose</p>")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package><manifest><item id="1" href="a.xhtml"/><item id="2" href="b.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="1"/></spine></package>')
    assert files.decode_epub(buf.getvalue()) == "first\n\nsecond\n\nloose"
    stream = zlib.compress(rb"BT /F1 12 Tf (Hello \(there\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 1 /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj\n"
    assert files.decode_pdf(pdf) == "Hello (there)\nWorld"
    scan = b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj 2 0 obj << /Type /Page >> endobj"
    assert files.decode_pdf(scan, lambda raw, k: f"page {k}") == "page 0\n\npage 1" and files.decode_pdf(scan) == ""


def test_names_of_a_users_file(tmp_path, spark):
    from graphloom.operators import scope_text as S

    (tmp_path / "n.json").write_text(json.dumps({"authors": {"Zeno": ["zeno"]}, "known": ["Hypatia"]}))
    own = aliases.load(str(tmp_path / "n.json"))
    d = spark.createDataFrame([("What does Zeno say?",), ("according to Hypatia",)], "q string")
    assert [r[0] for r in d.select(S.authors(F.col("q"), own)).collect()] == [["Zeno"], ["Hypatia"]]


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0001_A_B.txt").write_text("Socrates often teaches Plato. Plato often teaches Aristotle.")
    assert main(["--root", str(tmp_path / "kg"), "--resources", str(tmp_path / "in"), "--stages", "load", "--dry-run"]) == {"load": 1}
    assert main(["--root", str(tmp_path / "kg"), "--resources", str(tmp_path / "in"), "--stages", "load,chunk"])["load"] == 1
    with pytest.raises(SystemExit):
        main(["--root", "x", "--stages", "nothing"])


def test_frames_as_tables(spark, tmp_path):
    import pandas as pd

    from graphloom.sources.catalog import Catalog

    Catalog(spark, str(tmp_path)).register("some_map", pd.DataFrame({"a": [1, 2]}))
    assert spark.sql("select sum(a) from some_map").first()[0] == 3
