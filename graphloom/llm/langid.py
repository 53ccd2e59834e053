"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on byte windows taken from a bounded sample of
labelled documents (SAMPLE_DOCS of each language, WINDOWS_PER_DOC windows spread over each whole text).  It labels every byte
position of a text; a document's probabilities are the means over its positions.  Texts are read whole, in segments
that start from a zero state, many segments side by side.

A language is what the training rows name, however many there are; how many rows each has is counted over all of them,
and its sampling rate follows, so a rare language is sampled as well as a common one.  Steps grow with the number of
languages, and fewer segments go side by side, so that memory doesn't.

Edge cases: a null text or one without a letter is `und` with score 0; a null lang or a text without a byte
isn't learned from, a short one repeats within its window; with no training row all are `und`; ties of probability go to
the first language by name; a very long text is read whole; a repeated row is predicted again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import map_arrow, only, read_table

HIDDEN, WINDOW, SEGMENT = 16, 64, 128
#: Bounds of the training sample: documents of each language (about), windows of a document.
SAMPLE_DOCS, WINDOWS_PER_DOC = 600, 12
STEPS, BATCH, RATE, SEED = 420, 160, 0.02, 11
#: Segments that go through the network side by side, for up to CLASSES languages; of more, fewer.
WIDTH, CLASSES = 2048, 16
#: Languages whose rates are sure to be a small table.
FEW = 10_000


def remainder(parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


class BiGRU:
    """Parameters by name; direction 0 reads forward, 1 backward."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {f"x{g}": draw(2, 256, hidden) for g in "zrn"} | {f"u{g}": draw(2, hidden, hidden) for g in "zrn"} | {"c": np.zeros((2, hidden), np.float32), "o": draw(2, hidden, len(languages)), "b": np.zeros(len(languages), np.float32)}

    def states(self, seq: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """seq: 2 x T x B bytes (the second reversed) -> 2 x T x B x H states."""
        p, (_, steps, width) = self.p, seq.shape
        h = np.zeros((2, width, self.hidden), np.float32)
        out, tape = np.empty((2, steps, width, self.hidden), np.float32), []
        c = p["c"][:, None, :]
        side = np.arange(2)[:, None]
        for t in range(steps):
            at = seq[:, t]
            # sigmoid(a) is (1 + tanh(a / 2)) / 2
            z = np.tanh((p["xz"][side, at] + h @ p["uz"]) * 0.5) * 0.5 + 0.5
            r = np.tanh((p["xr"][side, at] + h @ p["ur"]) * 0.5) * 0.5 + 0.5
            q = h @ p["un"] + c
            n = np.tanh(p["xn"][side, at] + r * q)
            if keep:
                tape.append((h, z, r, q, n))
            h = n + z * (h - n)
            out[:, t] = h
        return out, tape

    def loss(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of B x T windows, and its gradients by backpropagation through time."""
        p = self.p
        seq = np.stack([windows.T, windows.T[::-1]])
        out, tape = self.states(seq, keep=True)
        steps, width = seq.shape[1:]
        logits = out[0] @ p["o"][0] + (out[1] @ p["o"][1])[::-1] + p["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=-1, keepdims=True)
        value = -np.log(np.maximum(prob[:, np.arange(width), target], 1e-9)).mean()
        prob[:, np.arange(width), target] -= 1.0
        d = prob / (steps * width)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["b"] = d.sum(axis=(0, 1))
        back = d[::-1]
        g["o"][0] = np.einsum("tbh,tbl->hl", out[0], d)
        g["o"][1] = np.einsum("tbh,tbl->hl", out[1], back)
        dout = np.stack([d @ p["o"][0].T, back @ p["o"][1].T])
        dh = np.zeros((2, width, self.hidden), np.float32)
        flip = lambda m: m.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, z, r, q, n = tape[t]
            dh = dh + dout[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dq = dn * r
            dr = dn * q * r * (1 - r)
            dh = dh * z
            for gate, da in (("z", dz), ("r", dr), ("n", dn)):
                for side in range(2):
                    np.add.at(g[f"x{gate}"][side], seq[side, t], da[side])
                inner = dq if gate == "n" else da
                g[f"u{gate}"] += flip(h) @ inner
                dh = dh + inner @ flip(p[f"u{gate}"])
            g["c"] += dq.sum(axis=1)
        return float(value), g

    def train(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam on batches that draw every language equally often."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        first, second, values = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, []
        for i in range(1, steps + 1):
            pick = np.array([rng.choice(of[k]) for k in rng.integers(0, len(of), batch)])
            value, g = self.loss(windows[pick], target[pick])
            values.append(value)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            lr = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                self.p[k] -= (lr * first[k] / (1 - 0.9**i) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return values

    def positions(self, seq: np.ndarray, size: np.ndarray) -> np.ndarray:
        """T x B bytes and B lengths -> T x B x L probabilities; those past a length mean nothing."""
        p, (steps, width) = self.p, seq.shape
        turn = np.where(np.arange(steps)[:, None] < size, size - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        both = np.stack([seq, np.take_along_axis(seq, turn, axis=0)])
        logits = np.empty((2, steps, width, len(self.languages)), np.float32)
        h = np.zeros((2, width, self.hidden), np.float32)
        a, b, q, z, r, n = (np.empty_like(h) for _ in range(6))
        for t in range(steps):
            for out, gate in ((z, "z"), (r, "r")):
                for side in range(2):
                    np.take(p["x" + gate][side], both[side, t], axis=0, out=a[side], mode="clip")
                np.matmul(h, p["u" + gate], out=b)
                a += b
                a *= 0.5
                np.tanh(a, out=out)
                out *= 0.5
                out += 0.5
            np.matmul(h, p["un"], out=q)
            q += p["c"][:, None, :]
            q *= r
            for side in range(2):
                np.take(p["xn"][side], both[side, t], axis=0, out=a[side], mode="clip")
            q += a
            np.tanh(q, out=n)
            h -= n
            h *= z
            h += n
            np.matmul(h, p["o"], out=logits[:, t])
        total = logits[0] + np.take_along_axis(logits[1], turn[:, :, None], axis=0)
        total += p["b"]
        total -= total.max(axis=-1, keepdims=True)
        np.exp(total, out=total)
        total /= total.sum(axis=-1, keepdims=True)
        return total

    def pooled(self, s: tk.Slice, segment: int = SEGMENT, width: int = WIDTH) -> np.ndarray:
        """n x L: mean probabilities over the positions of each document (zeros for an empty one)."""
        length = np.diff(s.off)
        per = -(-length // segment)
        doc = np.repeat(np.arange(s.n), per)
        start = s.off[doc] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * segment
        size = np.minimum(segment, s.off[doc + 1] - start)
        sums = np.zeros((s.n, len(self.languages)))
        order = np.argsort(-size, kind="stable")
        width = max(1, width * CLASSES // max(CLASSES, len(self.languages)))
        for i in range(0, len(order), width):
            k = order[i : i + width]
            steps = int(size[k].max())
            at = start[k] + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < size[k]
            seq = np.where(inside, s.data[np.minimum(at, len(s.data) - 1)], 0)
            prob = self.positions(seq, size[k])
            prob *= inside[:, :, None]
            np.add.at(sums, doc[k], prob.sum(axis=0, dtype=np.float64))
        return sums / np.maximum(length, 1)[:, None]


def sample_windows(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, byte windows and their languages, from about SAMPLE_DOCS documents of each language."""
    spark = labelled.sparkSession
    counts = labelled.groupBy("lang").count().collect()  # a model has a column a language, so they fit the driver
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    languages = sorted(r[0] for r in counts)
    rates = spark.createDataFrame([(r[0], min(1.0, SAMPLE_DOCS / r[1])) for r in counts], "lang string, rate double")
    share = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.join(F.broadcast(rates) if len(counts) <= FEW else rates, "lang").filter(share < F.col("rate"))

    def fn(b: pa.RecordBatch):
        for s in tk.text_slices(b.column(1)):
            lang = b.column(0).slice(s.first, s.n).to_pylist()
            rows: list[tuple[str, bytes]] = []
            for k in range(s.n):
                raw = s.data[s.off[k] : s.off[k + 1]].tobytes()
                spots = np.unique(np.linspace(0, max(0, len(raw) - WINDOW), min(WINDOWS_PER_DOC, max(1, len(raw) // WINDOW))).astype(int))
                rows += [(lang[k], raw[p : p + WINDOW]) for p in spots]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "window"])

    got = map_arrow(chosen.select("lang", "text"), "lang string, window binary", fn).toArrow()
    order = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    # a shorter text repeats within its window
    windows = np.array([np.resize(np.frombuffer(w, np.uint8), WINDOW) for _, w in order], np.uint8).reshape(-1, WINDOW)
    languages = [x for x in languages if x in {k for k, _ in order}]
    number = {x: i for i, x in enumerate(languages)}
    return languages, windows, np.array([number[k] for k, _ in order], np.int64)


def fit(labelled: DataFrame) -> BiGRU | None:
    """labelled: doc_id, text, lang; rows with a null in text or lang teach nothing."""
    languages, windows, target = sample_windows(only(labelled, doc_id="long", text="string", lang="string").filter("text <> '' and lang is not null"))
    if not languages:
        return None
    model = BiGRU(languages)
    model.train(windows, target, steps=STEPS * max(1, len(languages) // CLASSES))
    return model


def predict(docs: DataFrame, model: BiGRU | None) -> DataFrame:
    """doc_id, lang_pred, score for every whole text."""
    d = only(docs, doc_id="long", text="string").withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights, some tens of kilobytes

    def fn(b: pa.RecordBatch):
        m: BiGRU | None = shared.value
        for s in tk.text_slices(b.column(1)):
            letter = np.asarray(b.column(2).slice(s.first, s.n).to_numpy(zero_copy_only=False), bool)
            if m is None:
                best, score, known = np.zeros(s.n, int), np.zeros(s.n), np.zeros(s.n, bool)
                names = ["und"]
            else:
                prob, names, known = m.pooled(s), m.languages, letter
                best = prob.argmax(axis=1)
                score = np.where(known, prob[np.arange(s.n), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), pa.array([names[i] if k else "und" for i, k in zip(best, known, strict=True)]), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "lang_pred", "score"])

    return map_arrow(d, "doc_id long, lang_pred string, score double", fn)


def op6_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(remainder(4) != 2))
    return predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
