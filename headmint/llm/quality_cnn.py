"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. FILTERS learned filters of TAPS bytes run over every position;
their answers are max-pooled within chunks of CHUNK bytes that overlap by a BLOCK, and each
chunk keeps its rectified maxima. The mean and the maximum over all chunks of the whole
text feed one logistic unit. A filter over bytes is a sum of TAPS table rows, so inference
is table look-ups, in pieces that stay in the CPU's cache.

The network is trained on the driver from a bounded sample of labelled rows (at most
`sample_rows`, texts of at most `sample_bytes` bytes): the only bounded part. Scoring reads
every byte of every text on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import text_slices

TAPS, FILTERS = 4, 16
BLOCK = 64
CHUNK_BLOCKS, STEP_BLOCKS = 4, 3  # chunks of 256 bytes, one begins every 192
PIECE = 512  # blocks convolved at once


@dataclass
class Network:
    table: np.ndarray  # (TAPS, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weight: np.ndarray  # (2 * FILTERS,): on the mean and on the maximum over chunks
    offset: float
    constant: float | None = None  # the score where labels of one kind, or none, were at hand

    def probabilities(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each text of a slice."""
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        x, blocks = padded(buf, off)
        pooled, _ = convolve(x, self.table, argmax=False)
        mean, top, _, _ = over_chunks(pooled, blocks, self.bias)
        z = np.concatenate([mean, top], axis=1).astype(np.float64) @ self.weight.astype(np.float64) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def padded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out from block to block; blocks of each text (one at least).

    TAPS - 1 zeros before and after each text keep a filter at one's end from reading the next.
    """
    size = np.diff(off)
    blocks = -(-(size + 2 * (TAPS - 1)) // BLOCK)
    x = np.zeros(int(blocks.sum()) * BLOCK + TAPS, np.uint8)
    begin = (np.cumsum(blocks) - blocks) * BLOCK + TAPS - 1
    if len(size) < len(buf) // 256:  # long texts: copy one by one
        for a, b, n in zip(begin.tolist(), off[:-1].tolist(), size.tolist(), strict=True):
            x[a : a + n] = buf[b : b + n]
    else:
        x[np.arange(len(buf)) + np.repeat(begin - off[:-1], size)] = buf
    return x, blocks


def convolve(x: np.ndarray, table: np.ndarray, argmax: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest answer of each filter in each block, and where."""
    n = (len(x) - TAPS) // BLOCK
    best = np.empty((n, FILTERS), np.float32)
    where = np.empty((n, FILTERS), np.int64) if argmax else None
    z, t = np.empty((PIECE * BLOCK, FILTERS), np.float32), np.empty((PIECE * BLOCK, FILTERS), np.float32)
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        m = (b - a) * BLOCK
        np.take(table[0], x[a * BLOCK : a * BLOCK + m], axis=0, out=z[:m], mode="clip")
        for j in range(1, TAPS):
            np.take(table[j], x[a * BLOCK + j : a * BLOCK + j + m], axis=0, out=t[:m], mode="clip")
            z[:m] += t[:m]
        answers = z[:m].reshape(b - a, BLOCK, FILTERS)
        if where is None:
            half = BLOCK
            while half > 1:  # halving keeps the inner loops long
                half //= 2
                answers = np.maximum(answers[:, :half], answers[:, half:])
            best[a:b] = answers[:, 0]
        else:
            k = answers.argmax(axis=1)
            best[a:b] = np.take_along_axis(answers, k[:, None], axis=1)[:, 0]
            where[a:b] = k + np.arange(a, b)[:, None] * BLOCK
    return best, where


def over_chunks(pooled: np.ndarray, blocks: np.ndarray, bias: np.ndarray):
    """Mean and maximum over each text's chunks; the text of each chunk and its blocks."""
    first = np.cumsum(blocks) - blocks
    chunks = 1 + -(-np.maximum(blocks - CHUNK_BLOCKS, 0) // STEP_BLOCKS)
    text = np.repeat(np.arange(len(blocks)), chunks)
    start = np.cumsum(chunks) - chunks
    at = (np.arange(len(text)) - start[text]) * STEP_BLOCKS
    member = first[text][:, None] + np.minimum(at[:, None] + np.arange(CHUNK_BLOCKS), blocks[text][:, None] - 1)
    vec = np.maximum(pooled[member].max(axis=1) + bias, 0)
    mean = np.add.reduceat(vec, start, axis=0) / chunks[:, None]
    top = np.maximum.reduceat(vec, start, axis=0)
    return mean, top, (text, start, chunks, member), vec


def train(texts: list[bytes], labels: np.ndarray, prior: float, steps: int = 600, batch: int = 32, seed: int = 7) -> Network:
    """Adam on weighted log loss. prior: the share of label 1, to which classes are weighted."""
    rng = np.random.default_rng(seed)
    share = float(np.mean(labels)) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Network(np.zeros((TAPS, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0, prior if len(labels) else 0.5)
    cost = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    p = [rng.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.array([np.log(prior / (1 - prior))], np.float32)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < batch:
            order += rng.permutation(len(texts)).tolist()
        pick, order = order[:batch], order[batch:]
        off = np.cumsum([0] + [len(texts[i]) for i in pick])
        x, blocks = padded(np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), off)
        pooled, where = convolve(x, p[0], argmax=True)
        mean, top, (text, start, chunks, member), vec = over_chunks(pooled, blocks, p[1])
        feats = np.concatenate([mean, top], axis=1)
        prob = 1 / (1 + np.exp(-np.clip(feats @ p[2] + p[3][0], -30, 30)))
        d = ((prob - labels[pick]) * cost[pick] / len(pick)).astype(np.float32)
        g = [None, None, feats.T @ d + 1e-4 * p[2], np.array([d.sum()], np.float32)]
        d_mean, d_top = d[:, None] * p[2][:FILTERS], d[:, None] * p[2][FILTERS:]
        d_vec = (d_mean / chunks[:, None])[text] + d_top[text] * (vec == top[text])
        d_vec *= vec > 0
        g[1] = d_vec.sum(axis=0)
        block = np.take_along_axis(member, pooled[member].argmax(axis=1), axis=1)
        at = where[block, np.arange(FILTERS)]
        g[0] = np.stack([np.bincount((x[at + j].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), d_vec.ravel(), 256 * FILTERS).reshape(256, FILTERS) for j in range(TAPS)]).astype(np.float32)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in range(4):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(p[0], p[1], p[2], float(p[3][0]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 3000, sample_bytes: int = 1 << 16) -> Network:
    """Train on labelled rows that aren't held out: half of sample_rows for each label, the
    rows with the smallest hash of their id, with texts of at most sample_bytes bytes.
    Rows with a null label, id or text aren't learned from, nor are ids whose labels contradict
    each other. The share of label 1 among all labelled ids sets the class weights."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= sample_bytes)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # twice the rows needed: some of their texts are missing or too long
    drawn = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for y in (0, 1)]
    found = text.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").withColumn("h", F.xxhash64("id"))
    kept = [found.filter(F.col("y") == y).orderBy("h", "id", "text").limit(sample_rows // 2) for y in (0, 1)]
    got = kept[0].unionByName(kept[1]).select("h", "id", "y", "text").collect()
    got.sort(key=lambda r: (r["h"], r["id"], r["text"]))
    return train([r["text"].encode() for r in got], np.array([r["y"] for r in got]), n.get(1, 0) / max(1, sum(n.values())))


def score(network: Network, text: Column) -> Column:
    """Probability of label 1 of each whole text; null counts as empty."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            got = [network.probabilities(buf, off) for _, _, buf, off in text_slices(c, 4 << 20)]
            yield pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")(text)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **sample) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Scores come from the text alone. Null and empty texts are scored as empty. A row with a
    null id isn't held out. Repeated rows get equal scores. With labels of one kind, or
    none, every score is their share (0.5). Other columns of docs are ignored.
    """
    network = train_from(docs, labels, id_col, text_col, **sample)
    out = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score(network, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
