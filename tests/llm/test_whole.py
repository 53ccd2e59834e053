"""Operators over whole inputs: cases that lie past a former bound or cut, against brute force."""

import re

import numpy as np
import pyarrow as pa

from graphloom.llm import licences, lmscore, tokens
from graphloom.llm import textkit as tk


def base_licences(text, templates, least=licences.DICE):
    """All runs of units against all templates, nearest first."""
    lines = re.sub(r"([.!?])[\x20\x09-\x0D]+", "\\1\n", (text or "").lower()).split("\n")
    units = [(k, w) for k, x in enumerate(lines) if (w := re.findall(r"[^\W_]+", x))]
    near = set()
    for name, t in templates:
        w = licences.normalise(t)
        t = set(zip(w, w[1:]))
        for i in range(len(units)):
            for j in range(i, len(units)):
                run = [x for _, u in units[i : j + 1] for x in u]
                if i != j and len(run) - 1 > (len(w) - 1) * (2 - least) / least + 1e-9:
                    break
                g = set(zip(run, run[1:]))
                if g and 2 * len(g & t) / (len(g) + len(t)) >= least:
                    near.add((-2 * len(g & t) / (len(g) + len(t)), j - i, i, name))
    kept = []
    for far, more, i, name in sorted(near):
        if all(i + more < b or b + m < i or (far, more, i) == (f, m, b) for f, m, b, _ in kept):
            kept.append((far, more, i, name))
    return sorted((round(-far, 9), name, units[i][0]) for far, _, i, name in kept)


def wrap(text, n=9):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_licence_lines_bodies_and_wrapped_notices(spark):
    every = licences.TEMPLATES + licences.TEXTS
    both = ["Copyright (c) 2020 A Person. All rights reserved.", "All rights reserved.", "Prose.\nLicensed under the\nMIT License.\n\nMore prose.", "Licensed under the MIT License. Yes. Licensed under\nthe MIT License.", "all rights reserved elsewhere", "all\n\nrights\nreserved", "The rights of all. Reserved seats.", None, "", "one"]
    texts = both + [f"Some prose goes first.\n\n{wrap(t)}\n\nSome prose goes last. Yes, it does." for _, t in every] + ["\n".join(f"# {x}" for x in wrap(t, 7).split("\n")) for _, t in licences.TEXTS]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((round(x.dice, 9), x.licence, x.unit) for x in r.found) for r in licences.scan(d).collect()}
    assert got == {i: base_licences(t, every) for i, t in enumerate(texts)}
    names = lambda i: {x[1] for x in got[i]}
    assert names(1) == {"proprietary"} and names(2) == {"mit"} and len(got[3]) == 2
    for k, (name, _) in enumerate(every):
        assert name in names(len(both) + k)


def test_id_counts_are_of_all_training_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(lmscore, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(lmscore.Attention, "train", lambda *a, **k: [])
    seen = []
    init = lmscore.Attention.__init__
    monkeypatch.setattr(lmscore.Attention, "__init__", lambda self, *tables, **k: (seen.extend(tables), init(self, *tables, **k))[1])
    path = tokens.default_path()
    enc = tokens.word_ids(path)
    lmscore.score(docs, docs).count()
    want = np.zeros((3, len(seen[0])))
    for r in docs.collect():
        ids, per, _ = enc.slice(next(tk.text_slices(pa.array([r.text or ""]))))
        words = [w for w in np.split(ids, np.cumsum(per)[:-1]) if len(w)]
        for w in words:
            np.add.at(want[0], w, 1)
            want[1, w[-1]] += 1
            want[2, w[0]] += 1
    assert np.array_equal(np.stack(seen), want)
    assert lmscore.sampled(10**7) * 10**7 > 10 * lmscore.sampled(10**5) * 10**5


def test_ends_are_trained():
    rng = np.random.default_rng(4)
    runs = np.full((200, 96), -1)
    for r, k in zip(runs, rng.integers(3, 20, 200), strict=True):
        r[: k + 1] = [*rng.integers(0, 20, k), lmscore.END_RUN]
    counts = np.bincount(runs[runs >= 0], minlength=300).astype(float)
    m = lmscore.Attention(counts, np.zeros(300))
    m.train(runs, steps=150)
    per = np.array([(r >= 0).sum() for r in runs])
    ids = np.concatenate([r[r >= 0] for r in runs])
    ends = np.exp(m.ready().ids(ids, per, np.ones(len(ids), bool))[np.cumsum(per + 1) - 1])
    assert 0.3 / per.mean() < ends.mean() < 3 / per.mean()


def test_weight_of_attention_is_the_likeliest():
    rng = np.random.default_rng(5)
    c, sub = rng.integers(0, 40, 4000).astype(float), -rng.random(4000) * 9
    n, discount, spare = 1000, 0.6, 0.07
    like = lambda w: np.log((1 - w) * (np.maximum(c - discount, 0) / n + spare * np.exp(sub)) + w * np.exp(sub)).sum()
    got = lmscore.mix(c, sub, n, discount, spare)
    assert 0 < got < 1 and like(got) >= max(like(w) for w in np.linspace(0.001, 0.999, 999)) - 1e-2


def plain_ids(enc, texts):
    return [enc.slice(next(tk.text_slices(pa.array([t or ""]))))[:2] for t in texts]


def test_attention_is_trained_on_every_window(spark, docs, monkeypatch):
    monkeypatch.setattr(lmscore, "SAMPLE_DOCS", 4)
    monkeypatch.setattr(lmscore, "STEPS", 1)
    monkeypatch.setattr(lmscore, "TASK_DOCS", 0.5)
    seen, whole = [], lmscore.trained
    monkeypatch.setattr(lmscore, "trained", lambda part, *a: (seen.append((part.collect(), whole(part, *a))), seen[-1][1])[1])
    path = tokens.default_path()
    model = lmscore.fit(docs.repartition(3), path, docs.count())
    assert len(seen) == lmscore.ROUNDS + 1 and max(r.task for rows, _ in seen for r in rows) > 0
    texts = [r.text for r in docs.collect()]
    assert sorted(str(r.text) for rows, _ in seen for r in rows) == sorted(map(str, texts))
    # every id of these texts and every end is a target, those of the text of 30,000 words too
    assert sum(got[3] for _, got in seen) == sum(len(ids) + 1 for ids, _ in plain_ids(tokens.word_ids(path), texts))
    again = lmscore.fit(docs.repartition(1), path, docs.count())
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-5) for k in model.p)


def test_training_rows_without_ids_are_spread(spark):
    d = spark.range(4000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text")
    places = [r.p for r in d.select(lmscore.share().alias("p")).collect()]
    assert np.histogram(places, 8, (0, 1))[0].min() > 400


def test_laid_windows_are_the_blocks():
    m, rng = lmscore.Attention(np.arange(60, 0, -1).astype(float), np.zeros(60), None, dim=4, head=12, inputs=30, tails=(7, 11)), np.random.default_rng(1)
    per = np.array([0, 5, 16, 47, 1])
    ids = rng.integers(0, 60, per.sum())
    x, first, y, _, _ = m.laid(ids, per, -1)
    want = m.blocks(np.split(ids, np.cumsum(per)[:-1]), [True] * 5, 96)
    got = np.concatenate([x[:-1], x[1:]], axis=1)
    assert np.array_equal(got[:, lmscore.STRIDE :][y >= 0], want[0][:, lmscore.STRIDE :][want[2] >= 0])
    assert np.array_equal(first, want[1]) and np.array_equal(y, want[2])
    assert np.array_equal(got[~first, : lmscore.STRIDE], want[0][~first, : lmscore.STRIDE])


def test_runs_of_windows_give_the_gradients_of_single_ones(monkeypatch):
    """And strides that windows share are summed once."""
    rng, n, seen = np.random.default_rng(2), 60, []
    m = lmscore.Attention(np.arange(n, 0, -1).astype(float), np.zeros(n), None, dim=4, head=12, inputs=30, tails=(7, 11))
    for k in m.p:
        m.p[k] = rng.standard_normal(m.p[k].shape) * 0.3
    row_sums = lmscore.row_sums
    monkeypatch.setattr(lmscore, "row_sums", lambda at, rows, size: (seen.append(at.size), row_sums(at, rows, size))[1])
    per = np.array([0, 5, 16, 47, 1, 900])
    x, first, y, _, _ = m.laid(rng.integers(0, n, per.sum()), per, -1)
    value, want = m.loss(np.concatenate([x[:-1], x[1:]], axis=1), first, y)
    xs, firsts, ys = m.runs(x, first, y)
    assert (ys >= 0).sum() == (y >= 0).sum() == per.sum() + len(per) and len(xs) > 1
    more, got = m.loss(xs, firsts.ravel(), ys.reshape(-1, lmscore.STRIDE))
    assert abs(value - more) < 1e-9 and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    assert seen[-1] == len(xs) * (lmscore.RUN + 1) * lmscore.STRIDE and seen[-1] < 0.7 * seen[0]


def test_sums_of_rows_by_place():
    rng = np.random.default_rng(3)
    for at in (rng.zipf(1.5, 3000) % 200, np.zeros(50, int), np.arange(9), np.zeros(0, int)):
        rows, want = rng.standard_normal((len(at), 5)), np.zeros((200, 5))
        np.add.at(want, at, rows)
        assert np.allclose(lmscore.row_sums(at, rows, 200), want)


def test_products_in_blocks(monkeypatch):
    monkeypatch.setattr(lmscore, "SMALL", 90)
    rng = np.random.default_rng(4)
    for n, size in ((0, 6), (5, 6), (6, 6), (20, 6), (7, 40)):
        h, w = rng.standard_normal((n, 5)), rng.standard_normal((5, size))
        z = lmscore.product(h, w, np.empty((n, size)))
        assert np.allclose(z, h @ w) and np.allclose(lmscore.inner_product(h, z), h.T @ z)


def test_weight_is_of_all_training_rows(spark, docs, monkeypatch):
    rng = np.random.default_rng(7)
    enc = tokens.word_ids(tokens.default_path())
    size = enc.slow.tok.get_vocab_size()
    m = lmscore.Attention(rng.integers(0, 9, size).astype(float), rng.integers(0, 5, size).astype(float), None, dim=4, head=40, inputs=90, tails=(50, 61)).ready()
    monkeypatch.setattr(lmscore, "HEAD_WORDS", 8)
    monkeypatch.setattr(lmscore, "fit", lambda *a: m)
    seen, fit_weight = [], lmscore.fit_weight
    monkeypatch.setattr(lmscore, "fit_weight", lambda *a: (seen.append(fit_weight(*a)), seen[-1])[1])
    learns = lmscore.remainder(5) != 1
    got = lmscore.score(docs, learns).collect()
    other = lmscore.score(docs, docs.filter(learns)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in rows)
    assert key(got) == key(other) and abs(seen[0] - seen[1]) < 1e-9
    words, subs = [], []
    for r in docs.filter(learns).collect():
        h, sub, _, _ = lmscore.tokens_of(next(tk.text_slices(pa.array([r.text or ""]))), enc, m)
        words.append(h)
        subs.append(sub)
    _, at, c = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    n, v, n1, n2 = len(at), len(c), (c == 1).sum(), (c == 2).sum()
    discount = n1 / (n1 + 2 * n2)
    want = lmscore.mix(c[at] - 1.0, np.concatenate(subs), n - 1, discount, discount * v / n)
    assert 0 < want < 1 and abs(seen[0] - want) < 0.01
