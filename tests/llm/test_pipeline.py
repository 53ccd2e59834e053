"""The pipeline's rows against a plain version of all five stages, on planted and clean documents."""

import collections
import random
import re
import struct
import zlib

from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import tokens

from .test_models import brute_classes
from .test_small import SPACE, base_measures, brute_hits, brute_lines


def good(t):
    """Policy 2, from its rules as they are written down."""
    words, chars, symbols, _, repeats = base_measures(t)
    w = SPACE.findall(t or "")
    letters = len(re.findall("[A-Za-zÀ-\U0010ffff]", t or ""))
    return not (
        words < 20 or 100 * repeats > 30 * words or symbols > 0.1 * words or len(re.findall("[A-ZÀ-Þ]", t or "")) > 0.3 * letters or (t or "").count("!") > 0.1 * words
        or w.count("|") > 0.1 * words or chars < 2 * words or chars > 20 * words or letters < 0.5 * chars or sum(a == b for a, b in zip(w, w[1:])) > 0.3 * words
    )


def documents():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 14))) + "." for _ in range(n))
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(16))) for k in range(4)] + [(9, "a short item"), (10, None)]
    clean = [prose(r.randrange(4, 14)) for _ in range(40)]
    block = prose(4)
    texts = list(clean)
    texts += [clean[3], clean[3], clean[5].replace(clean[5].split()[4], "changed", 1), clean[7] + " tail"]  # exact and near copies, of which lines go first
    one = [" ".join(r.choice(vocabulary) for _ in range(140)) for _ in range(2)]
    texts += [x for o in one for x in (o, o + " end", "start " + o, o.upper().lower().replace(o.split()[60], "other", 1))]  # single lines, near copies alone
    texts += [prose(3) + "\n" + block + "\n" + prose(4), block + "\n" + prose(5), block]  # a shared passage
    texts += [prose(3) + "\n" + items[0][1].upper() + "\n" + prose(3), prose(5) + " " + " ".join(items[1][1].split()[2:13])]  # benchmark windows
    texts += [None, "", "few words", "spam ham " * 60, "! ! ! " * 30, " ".join(f"w{i}" for i in range(4000)) + "\n" + prose(300)]  # junk, and a long one
    rows = [(k * 3 + 1, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    r.shuffle(rows)
    return rows, items


def test_run_against_a_plain_version(spark, tmp_path):
    rows, items = documents()
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    left = {i: t for i, t, *_ in rows if good(t)}
    assert len(left) >= 45 and len(rows) - len(left) >= 5
    before = dict(left)
    lines = {i: clean for i, _, clean in brute_lines(sorted(left.items()))}
    left = {i: c for i, c in lines.items() if c == before[i] or (c and SPACE.search(c))}
    assert len(left) < len(before) and any(c != before[i] for i, c in left.items())
    classes = brute_classes(sorted(left.items()))
    copies = len(left)
    left = {i: t for i, t in left.items() if classes[i] == i}
    assert len(left) < copies
    planted = [i for i, t in left.items() if brute_hits(items, t)[1]]
    assert len(planted) >= 2
    left = {i: t for i, t in left.items() if i not in planted}
    tok, want = Tokenizer.from_file(tokens.default_path()), collections.Counter()
    for i, t in left.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[i, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
    got = corpus_pipeline.run(spark, at).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048


def test_stages_carry_clashing_columns(spark, docs, empty, data):
    """Extra columns named like the operators' own come through, and tables without rows give none."""
    for name, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, docs, data)
        assert got.columns == docs.columns and got.filter("n_words = 'clash' and slot = 5").count() == got.count() > 0, name
        assert f(spark, empty, data).count() == 0, name
    assert corpus_pipeline.pack(spark, docs, data).count() >= docs.count() and corpus_pipeline.pack(spark, empty, data).count() == 0
