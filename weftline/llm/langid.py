"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte position of the text; a document's probabilities are the mean over all its
letters' positions. It reads whole texts, in segments of SEGMENT bytes so that thousands advance together; either
direction's state has read CONTEXT bytes of the text in front of a segment's first position, so none is labelled from a blank state but at the
text's ends. It is trained here, by backpropagation through time, on a bounded sample of labelled rows
(`sample`, 1500 by default, shared alike by the languages).

Texts that are null or hold no letter get `und` with score 0. If no row can teach, every text does. Rows are
scored one by one, so repeats and ties need no care; other columns are never looked at, and one named like an output
is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import beside, by_bytes, crc_bucket, give_back, hashed_sample, mapped, named, small_batches, spread

SEGMENT, CONTEXT, HIDDEN = 96, 16, 8
BATCH_BYTES, LANES = 1 << 20, 2048
#: The places of a segment's own bytes among those that are read for it.
CORE = slice(CONTEXT, CONTEXT + SEGMENT)


def segments(text: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """(segments, CONTEXT + SEGMENT + CONTEXT): the bytes start..end of text in segments, zeros beyond the text's ends."""
    end = len(text) if end is None else end
    n = max(1, -(-(end - start) // SEGMENT))
    low, high = start - CONTEXT, start + n * SEGMENT + CONTEXT
    part = bytes(max(0, -low)) + text[max(0, low) : high] + bytes(max(0, high - len(text)))
    return sliding_window_view(np.frombuffer(part, np.uint8), SEGMENT + 2 * CONTEXT)[::SEGMENT]


class Net:
    """Weights: for each direction tables of input gates by byte and recurrent matrices; a softmax on both states.

    Gates are kept apart (r, z, n) so that every array of a step lies in one piece.
    """

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.labels = labels
        self.w = {g: (rng.standard_normal((2, 256, h)) * 0.5).astype(np.float32) for g in "rzn"}
        self.u = {g: (rng.standard_normal((2, h, h)) / np.sqrt(h)).astype(np.float32) for g in "rzn"}
        self.o = (rng.standard_normal((2 * h, len(labels))) / np.sqrt(2 * h)).astype(np.float32)
        self.c = np.zeros(len(labels), np.float32)

    def params(self) -> dict:
        return {**{("w", g): x for g, x in self.w.items()}, **{("u", g): x for g, x in self.u.items()}, "o": self.o, "c": self.c}

    def states(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """(2, bytes, lanes, HIDDEN) states of both directions; x: (lanes, bytes).

        Index t of the second direction is the t-th byte from the end.
        """
        steps, lanes = x.shape[1], len(x)
        out = np.empty((2, steps, lanes, HIDDEN), np.float32)
        r, z, n, m = (np.empty((lanes, HIDDEN), np.float32) for _ in range(4))
        for d in range(2):
            h = np.zeros((lanes, HIDDEN), np.float32)
            order = np.ascontiguousarray(x.T if d == 0 else x.T[::-1]).astype(np.intp)
            for t in range(steps):
                if tape is not None:
                    r, z, n, m = (np.empty((lanes, HIDDEN), np.float32) for _ in range(4))
                at = order[t]
                for g, into in (("r", r), ("z", z)):  # sigmoid(x) as a tanh, which is vectorised
                    np.matmul(h, self.u[g][d], out=into)
                    into += self.w[g][d].take(at, 0)
                    into *= 0.5
                    np.tanh(into, out=into)
                    into *= 0.5
                    into += 0.5
                np.matmul(h, self.u["n"][d], out=m)
                np.multiply(m, r, out=n)
                n += self.w["n"][d].take(at, 0)
                np.tanh(n, out=n)
                new = out[d, t]
                np.subtract(h, n, out=new)
                new *= z
                new += n
                if tape is not None:
                    tape.append((d, at, h, r, z, n, m))
                h = new
        return out

    def position_probs(self, states: np.ndarray) -> np.ndarray:
        """(SEGMENT, lanes, labels) probabilities of every position of the segments themselves."""
        logits = states[0, CORE] @ self.o[:HIDDEN]
        logits += states[1, ::-1][CORE] @ self.o[HIDDEN:]
        logits += self.c
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels): mean probabilities over the positions of letters (bytes of letters in ASCII and all bytes above it)."""
        sums = np.zeros((len(texts), len(self.labels)))
        held, owner, size = [], [], 0

        def add() -> None:
            x, of = np.concatenate(held), np.concatenate(owner)
            for i in range(0, len(x), LANES):
                part = x[i : i + LANES]
                p = self.position_probs(self.states(part))
                p *= LETTER[part.T[CORE]][:, :, None]
                total = p.sum(0)
                for k in range(len(self.labels)):
                    sums[:, k] += np.bincount(of[i : i + LANES], total[:, k], len(texts))

        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t)), LANES * SEGMENT):
                held.append(segments(t, a, min(len(t), a + LANES * SEGMENT)))
                owner.append(np.full(len(held[-1]), i))
                size += len(held[-1])
                if size >= 8 * LANES:
                    add()
                    held, owner, size = [], [], 0
        if held:
            add()
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-30)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, lanes: int = 384, rate: float = 0.015, seed: int = 7) -> None:
        """Adam on the cross entropy of every letter's position; x: (rows, bytes of a segment and its context), y: the rows' labels."""
        rng, params = np.random.default_rng(seed), self.params()
        first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), lanes)
            grads = self.gradients(x[at], y[at])
            lr = rate * min(1, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= (lr * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Backpropagation through time over both directions."""
        tape: list = []
        states = self.states(x, tape)
        d_core = self.position_probs(states)
        d_core[:, np.arange(len(y)), y] -= 1
        mask = LETTER[x.T[CORE]]
        d_core *= (mask / max(mask.sum(), 1))[:, :, None]
        steps = x.shape[1]
        d_logits = np.zeros((steps, len(x), len(self.labels)), np.float32)
        d_logits[CORE] = d_core
        flat = d_logits.reshape(-1, len(self.labels))
        g_o = np.concatenate([states[0].reshape(-1, HIDDEN).T @ flat, np.ascontiguousarray(states[1, ::-1]).reshape(-1, HIDDEN).T @ flat])
        g_w = {g: np.zeros_like(v) for g, v in self.w.items()}
        g_u = {g: np.zeros_like(v) for g, v in self.u.items()}
        for d in range(2):
            into = (d_logits if d == 0 else d_logits[::-1]) @ self.o[d * HIDDEN : (d + 1) * HIDDEN].T
            d_h = np.zeros((len(x), HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                _, at, h, r, z, n, m = tape[d * steps + t]
                d_h = d_h + into[t]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_r = d_n * m * r * (1 - r)
                d_z = d_h * (h - n) * z * (1 - z)
                back = d_h * z
                for g, dg, du in (("r", d_r, d_r), ("z", d_z, d_z), ("n", d_n, d_n * r)):
                    for k in range(HIDDEN):
                        g_w[g][d, :, k] += np.bincount(at, dg[:, k], 256)
                    g_u[g][d] += h.T @ du
                    back += du @ self.u[g][d].T
                d_h = back
        return {**{("w", g): v for g, v in g_w.items()}, **{("u", g): v for g, v in g_u.items()}, "o": g_o, "c": flat.sum(0)}


#: Whether a byte belongs to a letter: ASCII letters, and all bytes of longer characters.
LETTER = np.array([float(chr(b).isalpha() if b < 128 else True) for b in range(256)], np.float32)


def learn(docs: DataFrame, held: int | None = 1, folds: int = 3, sample: int = 1500, steps: int = 200) -> Net | None:
    """A network from at most `sample` documents with lang and text: of each language those of least hash of doc_id.

    Rows whose crc32(doc_id as text) modulo folds is held are never learned from, nor are rows without an id. An id that
    occurs more than once teaches by one of its rows. Every language has its share of `sample`, and one document at least, however
    rare it is. Of texts over 16384 characters pieces that are spread over all of it teach (common.spread), which bounds
    the bytes that the driver gets. None: nothing to learn.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    if held is not None:
        rows = rows.where(crc_bucket("doc_id", folds) != held)
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    labels = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    if not labels:
        return None
    sampled = hashed_sample(ids, "doc_id", max(1, sample // len(labels)), "lang")
    # At most `sample` ids, so this side is sent to every task whatever the size of the input.
    picked = F.broadcast(docs.sparkSession.createDataFrame([(k,) for _, k in sampled], T.StructType([docs.schema["doc_id"]])))
    texts = rows.join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", spread(F.col("text").cast("string")).alias("text"))).alias("r"))
    got = sorted((r["doc_id"], r["r"]["lang"], r["r"]["text"]) for r in texts.collect())
    net = Net(labels)
    # Each label teaches alike often, however short its texts are: its segments are repeated to the number of the largest.
    x = [np.concatenate([segments(t.encode()) for _, lang, t in got if lang == label]) for label in labels]
    most = max(map(len, x))
    x, y = np.concatenate([np.resize(p, (most, p.shape[1])) for p in x]), np.repeat(np.arange(len(labels)), most)
    net.train(x, y, steps)
    return net


def predict(docs: DataFrame, net: Net | None, text: str = "text", lang: str = "lang_pred", score: str = "score", whole: bool = False) -> DataFrame:
    """docs with lang and score in place of text, or beside it if whole: the likeliest label and its probability."""
    rows, keep, at = beside(docs, text, (lang, score), whole)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, at, BATCH_BYTES):
                texts = part.column(at)
                has = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if net is None:
                    has = np.zeros_like(has)
                names, scores = np.full(len(has), "und", object), np.zeros(len(has))
                if has.any():
                    p = net.documents(texts.filter(pa.array(has)).cast(pa.binary()).to_pylist())
                    names[has] = np.array(net.labels, object)[p.argmax(1)]
                    scores[has] = p.max(1)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.minimum(scores, 1.0))], names=[*keep, lang, score])
        give_back()

    return mapped(small_batches(rows), run, schema)


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rest of a fold in three."""
    rows = docs.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "text")
    return predict(rows, learn(docs))


def kept(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs in which a language is found: not `und`, and with a probability of at least `least`. Columns stay.

    The bound is below a half as texts that change from one language to another are clean.
    """
    net = learn(docs, held=None)
    return predict(docs, net, "text", "\x00lang", "\x00score", whole=True).where(f"`\x00lang` <> 'und' and `\x00score` >= {least}").select(*named(docs))
