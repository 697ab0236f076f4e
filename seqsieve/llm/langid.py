"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, fold, pieces

UNKNOWN = "und"
#: Bytes that the network reads in one go; its state starts anew after them.
SPAN = 128


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign in place, x / (1 + |x|): from -1 to 1 as tanh, at a quarter of its cost; its slope is (1 - |y|) ** 2."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


@dataclass
class Direction:
    """Weights of one direction. Rows of table and back: update gate, reset gate (0.5 + 0.5 softsign), candidate (softsign);
    table has a column for each byte."""

    table: np.ndarray  # 3H x 256
    back: np.ndarray  # 3H x H

    def run(self, bytes_: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Hidden states H x B at each of the L rows of bytes_ (L x B); mask (L x B) is 0 where a state is to be 0."""
        h_size = self.back.shape[1]
        h = np.zeros((h_size, bytes_.shape[1]), np.float32)
        for t in range(len(bytes_)):
            x = self.table.take(bytes_[t], axis=1, mode="clip")
            g = self.back @ h
            x[: 2 * h_size] += g[: 2 * h_size]
            zr = _squash(x[: 2 * h_size])
            zr *= 0.5
            zr += 0.5
            n = x[2 * h_size :]
            n += zr[h_size:] * g[2 * h_size :]
            _squash(n)
            before = h
            h = h - n
            h *= zr[:h_size]
            h += n
            h *= mask[t]
            yield (h, before, zr, n, g[2 * h_size :]) if keep else h

    def train(self, bytes_: np.ndarray, mask: np.ndarray, saved: list, grads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and back, given those of the states (grads, by row)."""
        h_size = self.back.shape[1]
        d_table, d_back = np.zeros_like(self.table), np.zeros_like(self.back)
        carry = np.zeros_like(saved[0][0])
        for t in range(len(bytes_) - 1, -1, -1):
            _, before, zr, n, gn = saved[t]
            z, r = zr[:h_size], zr[h_size:]
            d = (grads[t] + carry) * mask[t]
            dn = d * (1 - z) * np.square(1 - np.abs(n))
            dz = d * (before - n) * 0.5 * np.square(1 - np.abs(2 * z - 1))
            dr = dn * gn * 0.5 * np.square(1 - np.abs(2 * r - 1))
            dx = np.concatenate((dz, dr, dn))
            dg = np.concatenate((dz, dr, dn * r))
            for row, out in zip(dx, d_table, strict=True):
                out += np.bincount(bytes_[t], row, 256)
            d_back += dg @ before.T
            carry = d * z + self.back.T @ dg
        return d_table, d_back


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # K x 2H
    bias: np.ndarray  # K x 1

    def probabilities(self, bytes_: np.ndarray, mask: np.ndarray):
        """K x B label probabilities at each row, last row first."""
        half = self.out.shape[1] // 2
        ahead = [self.out[:, :half] @ h for h in self.forward.run(bytes_, mask)]
        for t, h in enumerate(self.backward.run(bytes_[::-1], mask[::-1])):
            logits = ahead.pop()
            logits += self.out[:, half:] @ h
            logits += self.bias
            logits -= logits.max(axis=0)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=0)
            yield len(bytes_) - 1 - t, logits


def train(texts: list[bytes], labels: list[str], hidden: int = 6, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 0) -> Network:
    """Fits the network to spans of bytes, each with the label of its document, by Adam on the mean cross-entropy of all
    positions. Languages are weighed alike. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)
    y = np.array([languages.index(x) for x in labels])
    span = max(map(len, texts), default=1)
    data, mask = np.zeros((span, len(texts)), np.uint8), np.zeros((span, len(texts)), np.float32)
    for i, x in enumerate(texts):
        data[: len(x), i] = np.frombuffer(x, np.uint8)
        mask[: len(x), i] = 1
    made = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    weights = [made(3 * hidden, 256), made(3 * hidden, hidden), made(3 * hidden, 256), made(3 * hidden, hidden), made(k, 2 * hidden), np.zeros((k, 1), np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    of = [np.flatnonzero(y == c) for c in range(k)]
    for step in range(1, steps + 1 if k > 1 else 0):
        pick = np.concatenate([rng.choice(o, max(1, batch // k)) for o in of])
        b, m, label = data[:, pick], mask[:, pick], y[pick]
        fw, bw, out, bias = Direction(*weights[:2]), Direction(*weights[2:4]), weights[4], weights[5]
        sf, sb = list(fw.run(b, m, True)), list(bw.run(b[::-1], m[::-1], True))
        gf, gb, d_out, d_bias = [], [], np.zeros_like(out), np.zeros_like(bias)
        total = m.sum()
        for t in range(span):
            both = np.concatenate((sf[t][0], sb[span - 1 - t][0]))
            logits = out @ both + bias
            p = np.exp(logits - logits.max(axis=0))
            p /= p.sum(axis=0)
            p[label, np.arange(len(label))] -= 1
            p *= m[t] / total
            d_out += p @ both.T
            d_bias += p.sum(axis=1, keepdims=True)
            d = out.T @ p
            gf.append(d[:hidden])
            gb.append(d[hidden:])
        grads = [*fw.train(b, m, sf, gf), *bw.train(b[::-1], m[::-1], sb, gb[::-1]), d_out, d_bias]
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads)) + 1e-9))
        lr = rate * (1 - 0.9 * step / steps)
        for w, g, v, s in zip(weights, grads, first, second, strict=True):
            g = g * scale
            v += 0.1 * (g - v)
            s += 0.01 * (g * g - s)
            w -= lr * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Network(languages, Direction(*weights[:2]), Direction(*weights[2:4]), weights[4], weights[5])


def spans(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's bytes in spans: matrix span x B (0 after a document's end), mask, and each column's document."""
    sizes = np.diff(offsets)
    counts = -(-sizes // span)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[doc] + nth * span
    have = np.minimum(offsets[doc + 1] - start, span)
    at = start + np.arange(span)[:, None]
    mask = np.arange(span)[:, None] < have
    padded = np.append(data, np.zeros(span, np.uint8))
    return np.where(mask, padded[np.minimum(at, len(padded) - 1)], 0), mask.astype(np.float32), doc


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x languages: the mean of the label probabilities over all bytes of each document (uniform if it has none)."""
    n = len(offsets) - 1
    total = np.zeros((n, len(net.languages)))
    bytes_, mask, doc = spans(data, offsets)
    for at in range(0, len(doc), 8192):
        b, m = np.ascontiguousarray(bytes_[:, at : at + 8192]), np.ascontiguousarray(mask[:, at : at + 8192])
        sums = np.zeros((len(net.languages), b.shape[1]), np.float32)
        for t, p in net.probabilities(b, m):
            sums += p * m[t]
        for c in range(len(net.languages)):
            total[:, c] += np.bincount(doc[at : at + 8192], sums[c], n)
    sizes = np.diff(offsets)[:, None]
    return np.where(sizes > 0, total / np.maximum(sizes, 1), 1 / len(net.languages))


def label_positions(net: Network, text: str) -> list[str]:
    """The most probable language at each byte of the text."""
    data = np.frombuffer(text.encode(), np.uint8)
    bytes_, mask, _ = spans(data, np.array([0, len(data)]))
    best = np.zeros(bytes_.shape, np.int64)
    for t, p in net.probabilities(bytes_, mask):
        best[t] = p.argmax(axis=0)
    return [net.languages[i] for i in best.T[mask.T > 0]]


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", slices: int = 192, spans_a_text: int = 8, width: int = 64, most_languages: int = 256) -> Network | None:
    """Trains on a bounded sample of labelled rows: of each language at most `slices` texts (the least hash in each slice of
    hashes, so any table size gives as many), of each at most `spans_a_text` evenly laid spans of `width` bytes. Languages
    beyond the `most_languages` first in code point order raise an error. None where nothing is labelled."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    least = rows.groupBy("label", F.pmod("hash", F.lit(slices)).alias("slice")).agg(F.min("hash").alias("hash"))
    if least.select("label").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    picked = rows.join(F.broadcast(least.select("label", "hash")), ["label", "hash"], "left_semi")  # at most slices * most_languages rows

    def cut(batches):
        for batch in pieces(batches, "text"):
            for x, y, h in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "hash")), strict=True):
                raw = x.encode()
                n = min(spans_a_text, -(-len(raw) // width))
                starts = sorted({(len(raw) - width) * i // max(1, n - 1) if len(raw) > width else 0 for i in range(n)})
                yield pa.RecordBatch.from_pydict({"hash": [h] * len(starts), "at": starts, "span": [raw[s : s + width] for s in starts], "label": [y] * len(starts)}, schema=schema)

    schema = pa.schema([("hash", pa.int64()), ("at", pa.int64()), ("span", pa.binary()), ("label", pa.string())])
    sample = picked.select("text", "label", "hash").mapInArrow(cut, "hash long, at long, span binary, label string").distinct().collect()
    sample = sorted((r.label, r.hash, r["at"], bytes(r.span)) for r in sample)
    return train([x[3] for x in sample], [x[0] for x in sample]) if sample else None


def predict(docs: DataFrame, net: Network | None, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs but those of the names label and score, then these: the language whose probability, pooled over
    the whole text, is highest, and that probability. Null texts, those without a letter and, without a network, all give
    `und` and score 0. Memory: a few MB of texts at a time."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in (label, score)]
    schema = T.StructType([*docs.select(*keep).schema, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few 10 KB, whatever the tables hold

    def run(batches):
        net = shared.value
        for batch in pieces(batches, text, 1 << 20):
            letters = batch.column("_letters").to_pylist()
            own = [batch.column(c) for c in keep]
            if net is None:
                best, most = [UNKNOWN] * len(letters), [0.0] * len(letters)
            else:
                p = pooled(net, *flat(batch.column(text)))
                best = [net.languages[i] if ok else UNKNOWN for i, ok in zip(p.argmax(axis=1), letters, strict=True)]
                most = np.where(letters, np.minimum(p.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*own, pa.array(best, pa.string()), pa.array(most, pa.float64())], names=[*keep, label, score])

    picked = docs.select(*keep, *([] if text in keep else [text]), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return picked.mapInArrow(run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return predict(rows, net).drop("text")
