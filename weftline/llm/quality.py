"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over windows of WIDTH bytes, every STRIDE bytes; a chunk is CHUNK windows, chunks overlap
by half and together cover the whole document. In a chunk each filter keeps its largest value; the largest
and the mean over the chunks go into one logistic unit. Trained here by gradient descent on a bounded sample of
labelled rows (`sample`, 2400 by default, half of either label).

Null and empty texts are one chunk of zero bytes and get its score, like any other text. Texts are scored one by
one and whole, very long ones in runs of chunks whose maxima and sums are carried on, so repeats, ties and extra columns need no
care; a column named like an output is replaced by it. With no label to learn from, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from weftline.llm.common import beside, by_bytes, crc_bucket, give_back, hashed_sample, mapped, named, small_batches, spread

DIM, WIDTH, STRIDE, CHUNK, FILTERS = 6, 16, 8, 32, 24
HALF = CHUNK // 2
BATCH_BYTES = 256 << 10
#: Half chunks of a longer text that are in memory at a time.
RUN = BATCH_BYTES // (HALF * STRIDE)


class Net:
    """Byte embeddings, one layer of filters, one logistic unit over the pooled values."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": (rng.standard_normal((256, DIM)) * 0.3).astype(np.float32),
            "f": (rng.standard_normal((WIDTH * DIM, FILTERS)) / np.sqrt(WIDTH * DIM)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "o": (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All windows' bytes (windows, WIDTH), and each text's count of half chunks.

        A text is filled with zero bytes to whole half chunks, at least one, and followed by zeros for its last window
        to reach into. The window that begins in those is of no text and left out.
        """
        span = HALF * STRIDE
        halves = np.array([max(1, -(-len(t) // span)) for t in texts])
        joined = b"".join(t + bytes(h * span - len(t) + STRIDE) for t, h in zip(texts, halves.tolist(), strict=True)) + bytes(WIDTH - STRIDE)
        at = sliding_window_view(np.frombuffer(joined, np.uint8), WIDTH)[::STRIDE]
        mine = np.ones(len(at), bool)
        mine[np.cumsum(halves * HALF + 1) - 1] = False
        return at[mine], halves

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, tuple]:
        """(texts, 2 * FILTERS) largest and mean over the chunks; and what training needs."""
        at, halves = self.windows(texts)
        x = self.p["e"].take(at, 0).reshape(len(at), -1)
        v = (x @ self.p["f"]).reshape(-1, HALF, FILTERS)
        half = v.max(1)
        starts = np.r_[0, np.cumsum(halves)[:-1]]
        # A chunk is a half and the one after it; a text's last half stands alone as well.
        nxt = np.r_[half[1:], half[-1:]]
        last = np.r_[starts[1:], len(half)] - 1
        nxt[last] = half[last]
        chunk = np.maximum(half, nxt)
        chunk += self.p["b"]
        np.maximum(chunk, 0, out=chunk)
        top, mean = np.maximum.reduceat(chunk, starts), np.add.reduceat(chunk, starts) / halves[:, None]
        return np.concatenate([top, mean], 1), (at, halves, starts, v, half, nxt, chunk)

    def pooled_in_runs(self, text: bytes) -> np.ndarray:
        """(1, 2 * FILTERS) of one text, RUN half chunks at a time: the largest values and the sum are carried on."""
        span = HALF * STRIDE
        n = max(1, -(-len(text) // span))
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for s in range(0, n, RUN):
            e = min(n, s + RUN)
            # One half more, as it is in the last chunk too, and what that half's last window reaches into.
            chunk = self.pooled([text[s * span : (e + 1) * span + WIDTH - STRIDE]])[1][-1][: e - s]
            np.maximum(top, chunk.max(0), out=top)
            total += chunk.sum(0, dtype=np.float64)
        return np.concatenate([top, total / n])[None].astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        long = [i for i, t in enumerate(texts) if len(t) > RUN * HALF * STRIDE]
        pooled = self.pooled([b"" if len(t) > RUN * HALF * STRIDE else t for t in texts])[0]
        for i in long:
            pooled[i] = self.pooled_in_runs(texts[i])
        return 1 / (1 + np.exp(-(pooled @ self.p["o"] + self.p["c"]).astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict:
        """Of the mean cross entropy. Only the windows that won a chunk's maximum carry any."""
        pooled, (at, halves, starts, v, half, nxt, chunk) = self.pooled(texts)
        d = (1 / (1 + np.exp(-(pooled @ self.p["o"] + self.p["c"]))) - y) / len(y)
        d_pool = d[:, None] * self.p["o"]
        owner = np.repeat(np.arange(len(texts)), halves)
        d_chunk = (d_pool[:, FILTERS:] / halves[:, None])[owner]
        won = chunk == pooled[owner, :FILTERS]
        ties = np.add.reduceat(won.astype(np.float32), starts)
        d_chunk += won * (d_pool[:, :FILTERS] / ties)[owner]
        d_chunk *= chunk > 0
        h, f = np.nonzero(d_chunk)
        g = d_chunk[h, f].astype(np.float32)
        from_half = h + ((nxt[h, f] > half[h, f]) & (h + 1 < len(half)))
        win = from_half * HALF + v[from_half, :, f].argmax(1)
        rows = at[win]
        x = self.p["e"].take(rows, 0).reshape(len(win), -1)
        g_f, g_e = np.zeros_like(self.p["f"]), np.zeros_like(self.p["e"])
        for k in range(FILTERS):
            mine = f == k
            g_f[:, k] = g[mine] @ x[mine]
        back = (self.p["f"].T[f] * g[:, None]).reshape(-1, DIM)
        flat = rows.reshape(-1)
        for k in range(DIM):
            g_e[:, k] = np.bincount(flat, back[:, k], 256)
        return {"e": g_e, "f": g_f, "b": np.bincount(f, g, FILTERS).astype(np.float32), "o": pooled.T @ d, "c": d.sum(keepdims=True)}

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int, rows: int = 48, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(texts) // rows)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), rows):
                at, step = order[i : i + rows], step + 1
                lr = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in self.gradients([texts[j] for j in at], y[at]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (lr * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, held: int | None = 1, folds: int = 3, sample: int = 2400, epochs: int = 10) -> Net | None:
    """A network from at most `sample` documents with a quality label, those of least hash of doc_id.

    Half of either label, so that 0.5 is the line between them. Documents with labels of both kinds, and those
    whose crc32(doc_id as text) modulo folds is held, are never learned from. An id that occurs more than once
    teaches by one of its texts. Of texts over 16384 characters pieces that are spread over all of it teach (common.spread),
    which bounds the bytes that the driver gets. None: a label has no document.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = r")
    if held is not None:
        known = known.where(crc_bucket("doc_id", folds) != held)
    known = known.select("doc_id", "q").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sampled = hashed_sample(known, "doc_id", sample // 2, "q")
    if len({q for q, _ in sampled}) < 2:
        return None
    # At most `sample` ids, so this side is sent to every task whatever the size of the input.
    picked = F.broadcast(docs.sparkSession.createDataFrame([(k,) for _, k in sampled], T.StructType([known.schema["doc_id"]])))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(picked, "doc_id").groupBy("doc_id").agg(F.min(spread(F.col("text"))).alias("text"))
    text_of = dict(map(tuple, texts.collect()))
    rows = sorted((k, text_of[k].encode(), q) for q, k in sampled)
    net = Net()
    net.train([t for _, t, _ in rows], np.array([q for _, _, q in rows], np.float32), epochs)
    return net


def predict(docs: DataFrame, net: Net | None, text: str = "text", score: str = "score", whole: bool = False) -> DataFrame:
    """docs with score in place of text, or beside it if whole: the probability of label 1."""
    rows, keep, at = beside(docs, text, (score,), whole)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, at, BATCH_BYTES):
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                scores = np.full(len(texts), 0.5) if net is None else net.scores(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores)], names=[*keep, score])
        give_back()

    return mapped(small_batches(rows), run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the rest of a fold in three."""
    rows = docs.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "text")
    return predict(rows, learn(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose score is at least `least`. Columns stay."""
    net = learn(docs, labels, held=None)
    return predict(docs, net, "text", "\x00score", whole=True).where(f"`\x00score` >= {least}").select(*named(docs))
