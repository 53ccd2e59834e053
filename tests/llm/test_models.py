"""Near duplicates, language identification, language-model scores and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloom.llm import langid, lmscore, neardup
from graphloom.llm import textkit as tk

from .conftest import ROWS

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- near duplicates --------------------------------------------------------------------------------------------------
def shingles(t):
    w = SPACE.findall(low(t))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in set(a) | set(b)) for i in set(a) & set(b))


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(6)) for _ in range(400)]
    rows = []
    for k in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 200))]
        for _ in range(r.randrange(1, 7)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) + 100, " ".join(w)))
    return rows


def brute_classes(rows):
    ids = [i for i, _ in rows]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    s = {i: shingles(t) for i, t in rows}
    text = dict(rows)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if text[a] is not None and (text[a] == text[b] or (s[a] and s[b] and jaccard(s[a], s[b]) >= 0.8)):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [64, 3])
def test_near_duplicate_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # 3: leaders and buckets go in several groups
    monkeypatch.setattr(neardup, "SLAB", 5000 if block == 3 else neardup.SLAB)
    rows = corpus() + [(1, None), (2, None), (3, ""), (4, ""), (5, "a b"), (6, "A b"), (7, "a c"), (8, "one two three four five six seven"), (9, "a a a a a a a a b b b b"), (10, "a a a a a a a a a b b b b")]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes([r for r in rows])
    assert got == want
    assert 5 < len(set(want.values())) < len(rows) - 10


def test_near_duplicate_edges(docs, empty):
    rows = neardup.classes(docs).collect()
    assert len(rows) == len(ROWS)
    of = collections.defaultdict(set)
    for r in rows:
        of[r.doc_id].add(r.class_id)
    assert of[1] == of[7] == {1} and of[2] == {2} and of[None] and min(of[None]) < 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, None, 6, 8, 9]))
    assert neardup.classes(empty).count() == 0


def test_one_id_with_several_texts_loses_none(spark):
    """Rows of one doc_id and different texts are documents of their own, near copies of others or not."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    d = spark.createDataFrame([(5, a), (5, b), (5, b), (6, b + " tail"), (7, c), (None, c), (None, None), (None, None), (8, None), (8, c + " end")], "doc_id long, text string")
    of = collections.defaultdict(set)
    for r in neardup.classes(d).join(d.select("doc_id", neardup.text_key().alias("k1"), "text").distinct(), "k1").collect():
        of[r.text].add(r.class_id)
    assert len(of[a]) == len(of[b]) == len(of[c]) == 1 and len(set.union(of[a], of[b], of[c])) == 3
    assert of[b] == of[b + " tail"] and of[c] == of[c + " end"]
    kept = [r.text for r in neardup.keep_one(d).collect()]
    assert len(kept) == 5 and kept.count(None) == 2 and a in kept and len({x for x in kept if x} & {b, b + " tail"}) == 1


def test_recall_of_near_pairs_on_the_drivers_rows(spark):
    """Every pair of documents of at least 0.8 is in one class."""
    at = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    of = {r.doc_id: r.class_id for r in neardup.op2_probminhash_classes(spark, at).collect()}
    sets = {i: shingles(t) for i, t in texts.items() if t}
    holders = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    found = []
    for i, own in sets.items():
        shared = collections.Counter(j for x in own for j in holders[x] if j > i)
        found += [of[i] == of[j] for j, n in shared.items() if n >= 0.3 * max(len(own), len(sets[j])) and texts[i] != texts[j] and jaccard(own, sets[j]) >= 0.8]
    assert len(found) >= 10 and all(found)


def test_registers_estimate_probability_jaccard():
    a = [("x%d" % i, 1 + i % 4) for i in range(200)]
    b = [("x%d" % i, 1 + (i % 3)) for i in range(60, 260)]
    doc, h, w = zip(*[(k, zlib.crc32(w.encode()), n) for k, x in enumerate((a, b)) for w, n in x])
    sig = neardup.registers(np.array(doc), tk.mix(np.array(h, np.uint64)), np.array(w), 2, 4096)
    x, y = collections.Counter(dict(a)), collections.Counter(dict(b))
    assert abs((sig[0] == sig[1]).mean() - jaccard(x, y)) < 0.03
    keys = sorted(set(x) | set(y))
    assert abs(neardup.probability_jaccard(np.array([x[k] for k in keys]), np.array([y[k] for k in keys])) - jaccard(x, y)) < 1e-9


def test_components_of_a_chain_and_stars(spark):
    r = random.Random(5)
    order = list(range(200))
    r.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(99)] + [(order[150], order[k]) for k in range(151, 200)] + [(3, 3)]
    got = {x.u: x.v for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for group in (order[:100], order[150:]):
        assert {got.get(n, n) for n in group} == {min(group)}


# --- languages --------------------------------------------------------------------------------------------------------
def test_gradients_of_the_recurrent_network():
    m = langid.BiGRU(["a", "b", "c"], 5)
    m.p = {k: x.astype(float) for k, x in m.p.items()}
    rng = np.random.default_rng(0)
    windows, y = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = m.loss(windows, y)
    for k, x in m.p.items():
        i = (1, int(windows[2, 3]), 2) if k[0] == "x" else tuple(rng.integers(0, n) for n in x.shape)
        old = x[i]
        x[i] = old + 1e-4
        a = m.loss(windows, y)[0]
        x[i] = old - 1e-4
        b = m.loss(windows, y)[0]
        x[i] = old
        assert abs((a - b) / 2e-4 - g[k][i]) < 1e-5, k


def test_fast_positions_equal_plain_states():
    m = langid.BiGRU(["a", "b"], 6)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(1, 120, n).astype(np.uint8)).decode("latin-1") for n in (1, 37, 128, 300)]
    s = next(tk.text_slices(pa.array(texts)))
    got = m.pooled(s)
    for k, t in enumerate(texts):
        probs = []
        raw = np.frombuffer(t.encode(), np.uint8)
        for at in range(0, len(raw), langid.SEGMENT):
            w = raw[at : at + langid.SEGMENT][:, None]
            out, _ = m.states(np.stack([w, w[::-1]]))
            z = out[0] @ m.p["o"][0] + (out[1] @ m.p["o"][1])[::-1] + m.p["b"]
            e = np.exp(z - z.max(axis=-1, keepdims=True))
            probs.append((e / e.sum(axis=-1, keepdims=True))[:, 0])
        assert np.allclose(got[k], np.concatenate(probs).mean(axis=0), atol=1e-4)


def test_language_accuracy_on_held_out_rows(spark, data):
    r = langid.op6_byte_bigru(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in r)
    assert np.mean([x.lang == x.lang_pred for x in held]) >= 0.97


def test_language_edges(docs, empty, spark):
    m = langid.BiGRU(["en", "xx"])
    r = {x.doc_id: x for x in langid.predict(docs, m).collect()}
    assert all(r[i].lang_pred == "und" and r[i].score == 0 for i in (2, 3, 4)) and r[5].lang_pred in ("en", "xx")
    assert langid.predict(empty, m).count() == 0 and langid.fit(empty) is None
    assert {x.lang_pred for x in langid.predict(docs, None).collect()} == {"und"}


def plain_prediction(m, text):
    """One document at a time, one step at a time, by the equations of the network."""
    p, total, raw = m.p, np.zeros(len(m.languages)), text.encode()
    sig = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(raw), langid.SEGMENT):
        part = list(raw[at : at + langid.SEGMENT])
        states = []
        for side, order in ((0, part), (1, part[::-1])):
            h, out = np.zeros(m.hidden), []
            for b in order:
                z, r = sig(p["xz"][side, b] + h @ p["uz"][side]), sig(p["xr"][side, b] + h @ p["ur"][side])
                n = np.tanh(p["xn"][side, b] + r * (h @ p["un"][side] + p["c"][side]))
                h = n + z * (h - n)
                out.append(h)
            states.append(out if side == 0 else out[::-1])
        for f, b in zip(*states):
            x = np.exp(f @ p["o"][0] + b @ p["o"][1] + p["b"])
            total += x / x.sum()
    return total / max(1, len(raw))


def test_predictions_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 30)
    rows = [(k, ("the cat and dog " if k % 2 else "der hund und die ") * (1 + k % 9) + str(k), "en" if k % 2 else "de") for k in range(60)] + [(99, "ab", "xx"), (98, "", "xx"), (97, None, "yy"), (96, "text", None)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == ["de", "en", "xx"]  # short texts teach, empty ones and nulls don't
    small = docs.filter("doc_id is null or doc_id <> 9")
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in langid.predict(small, m).collect():
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        want = plain_prediction(m, t)
        assert r.lang_pred == m.languages[int(want.argmax())] and abs(r.score - want.max()) < 1e-3


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 1)
    rows = [(k, f"text {k} of its own", f"l{k:03d}") for k in range(600)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m.languages) == 600
    got = langid.predict(spark.createDataFrame([(1, "some text " * 50)], "doc_id long, text string"), m).first()
    assert got.lang_pred in m.languages


# --- language model ---------------------------------------------------------------------------------------------------
def small_model(seed=0, **kw):
    rng = np.random.default_rng(seed)
    m = lmscore.Attention(rng.integers(0, 50, 60).astype(float), np.zeros(60), None, dim=4, head=12, inputs=30, tails=(7, 11))
    for k in m.p:
        m.p[k] = rng.standard_normal(m.p[k].shape) * 0.3
    return m, rng


def test_gradients_of_attention():
    m, rng = small_model()
    x, first, y = m.blocks([rng.integers(0, 60, 40), rng.integers(0, 60, 17)], [True, True], 96)
    _, g = m.loss(x, first, y)
    for k, p in m.p.items():
        i = (int(x[1, 20]), 1) if k in "eqkv" else tuple(rng.integers(0, n) for n in p.shape)
        old = p[i]
        p[i] = old + 1e-5
        a = m.loss(x, first, y)[0]
        p[i] = old - 1e-5
        b = m.loss(x, first, y)[0]
        p[i] = old
        assert abs((a - b) / 2e-5 - g[k][i]) < 1e-6, k


def plain_scores(m, own, begins):
    """Log probability of each id of one text and of its end, one at a time."""
    x, y, out = np.concatenate([[0], m.of[own]]).astype(int), np.concatenate([m.out[own], [0]]).astype(int), []
    for t in range(len(own) + 1):
        start = max(0, t // lmscore.STRIDE * lmscore.STRIDE - lmscore.STRIDE)
        seen = x[start : t + 1]
        a = (m.p["q"][x[t]] @ m.p["k"][seen].T) / np.sqrt(m.p["q"].shape[1]) + m.p["near"][t - start - np.arange(len(seen))]
        a = np.exp(a) / np.exp(a).sum()
        h = np.tanh(m.p["e"][x[t]] + a @ m.p["v"][seen])
        z = h @ m.p["w"] + m.p["b"]
        kind, place = y[t] & 0xFFFF, y[t] >> 16
        value = z[kind] - np.log(np.exp(z).sum())
        if kind in m.groups:
            z = h @ m.p[f"w{kind}"] + m.p[f"b{kind}"]
            value += z[place] - np.log(np.exp(z).sum())
        out.append(value + (m.within[int(begins[t]), own[t]] if t < len(own) else 0))
    return out


def test_batched_scores_equal_one_by_one():
    m, rng = small_model()
    m.ready()
    per = np.array([0, 5, 16, 47, 1])
    ids = rng.integers(0, 60, per.sum())
    begins = rng.integers(0, 2, len(ids)).astype(bool)
    got, at, k = m.ids(ids, per, begins), 0, 0
    for n in per:
        assert np.allclose(got[k : k + n + 1], plain_scores(m, ids[at : at + n], begins[at : at + n]), atol=1e-4)
        at, k = at + n, k + n + 1


def test_scores_of_texts_against_brute_force(spark, docs, monkeypatch):
    from graphloom.llm import tokens

    rng, weight = np.random.default_rng(4), 0.4
    enc = tokens.word_ids(tokens.default_path())
    size = enc.slow.tok.get_vocab_size()
    m = lmscore.Attention(rng.integers(0, 9, size).astype(float), rng.integers(0, 5, size).astype(float), None, dim=4, head=40, inputs=90, tails=(50, 61))
    for k in m.p:
        m.p[k] = (rng.standard_normal(m.p[k].shape) * 0.4).astype(np.float32)
    m.ready()
    monkeypatch.setattr(lmscore, "HEAD_WORDS", 8)
    monkeypatch.setattr(lmscore, "fit", lambda *a: m)
    monkeypatch.setattr(lmscore, "fit_weight", lambda *a: weight)
    small = docs.filter("doc_id is null or doc_id not in (6, 9)")
    rows = [(r.doc_id, r.text) for r in small.collect()]
    train = small.filter(langid.remainder(5) != 1)
    c = collections.Counter(w for r in train.collect() for w in [*SPACE.findall(low(r.text)), "<end>"])
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    want = []
    for i, t in rows:
        s = next(tk.text_slices(pa.array([t or ""])))
        ids, per, _ = enc.slice(s)
        begins = np.zeros(len(ids), bool)
        begins[(np.cumsum(per) - per)[per > 0]] = True
        lp, at, total = plain_scores(m, ids, begins), 0, 0.0
        subs = []
        for k in per:
            subs.append(sum(lp[at : at + k]) + sum(m.go[ids[at : at + k - 1]]) + (m.stop[ids[at + k - 1]] if k else 0.0))
            at += k
        for w, sub in zip([*SPACE.findall(low(t)), "<end>"], [*subs, lp[-1]], strict=True):
            p = math.exp(sub)
            total += math.log10((1 - weight) * (max(c[w] - discount, 0) / n + discount * v / n * p) + weight * p)
        want.append((str(i), total))
    got = sorted((str(r.doc_id), r.score) for r in lmscore.score(small, train).collect())
    for (i, x), (j, y) in zip(got, sorted(want), strict=True):
        assert i == j and abs(x - y) < 1e-3 * max(1.0, abs(y))


def test_held_out_rows_are_likelier_than_under_the_base(spark):
    """On the 10,000 documents of sf0.1; 1,000 are too few to learn spelling from."""
    r = lmscore.op9_attention_scores(spark, "/root/testdata/sf0.1").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_word_probabilities_are_proper():
    """After any text the end and all ids have probabilities that sum to one, and so do go and stop."""
    m, rng = small_model()
    assert m.rare.sum() > 10 and len(set(m.out.tolist())) == 9 + 7 + 11 and np.allclose(np.exp(m.within[:, m.rare]).sum(axis=1), 1, atol=1e-5)
    before = rng.integers(0, 60, 20)
    for begins in (0, 1):
        total = sum(np.exp(plain_scores(m, np.append(before, i), np.append(np.zeros(20, int), begins))[20]) for i in range(60))
        assert abs(total + np.exp(plain_scores(m, before, np.zeros(20, int))[20]) - 1) < 1e-5
    assert np.allclose(np.exp(m.stop) + np.exp(m.go), 1)


def test_language_model_against_counts(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD_WORDS", 8)  # most words go by the join
    train = docs.filter(langid.remainder(5) != 1)
    got = lmscore.score(docs, train).collect()
    toks = [(i, [*SPACE.findall(low(t)), "<end>"]) for i, t in ROWS]
    c = collections.Counter(w for i, ws in toks if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in toks)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lmscore.score(empty, empty).count() == 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    runs = np.array([np.tile(rng.permutation(20), 5)[:96] for _ in range(200)])
    m = lmscore.Attention(np.bincount(runs.ravel(), minlength=40).astype(float), np.zeros(40))
    v = m.train(runs, steps=120)
    assert np.mean(v[-10:]) < 0.8 * np.mean(v[:5])


# --- pipeline ---------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, data):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    d = spark.read.parquet(f"{data}/documents.parquet")
    cols, last = d.columns, d.count()
    for n, f in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.materialize(f(spark, d, data), n)
        assert d.columns == cols and 0 < d.count() <= last
        last = d.count()
    kept = {r.doc_id: r.text for r in d.collect()}
    assert brute_classes(sorted(kept.items())[:120]) == {i: i for i in sorted(kept)[:120]}
    packed = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stage_on_odd_rows(spark, data, docs, empty, stage):
    name, f = corpus_pipeline.STAGES[stage]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = f(spark, plain, data)
    assert got.count() > 0 and f(spark, plain.limit(0), data).count() == 0
    if name != "packing":
        assert got.columns == plain.columns
