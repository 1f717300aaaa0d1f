"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the number of
features.  It is trained here, on the driver, on a bounded sample of labelled rows (`max_train`, the rows with the
smallest hashes of their ids), and scores whole texts on the executors in Arrow batches.  Labels, language, source
and identifiers are never features; the metadata features are the text's own sizes.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import stage
from deltaloom.llm.textvec import Words, chunks

WORD_BUCKETS = 4096
STATS = 24
FEATURES = WORD_BUCKETS + STATS
MAX_TRAIN = 8_000
#: Characters of a text that can be a training row.
MAX_TEXT = 1 << 20


def _share(mask: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return (total[begin[1:]] - total[begin[:-1]]).astype(np.float64)


def statistics(w: Words) -> np.ndarray:
    """STATS numbers between 0 and about 1 for each text of a run."""
    raw, begin = w.raw, w.begin
    size = np.maximum(np.diff(begin) - 1, 0).astype(np.float64)  # without the parting newline
    n = w.n.astype(np.float64)
    b1, n1 = np.maximum(size, 1), np.maximum(n, 1)
    upper = _share((raw >= 65) & (raw <= 90), begin)
    lower = _share((raw >= 97) & (raw <= 122), begin)
    high = _share(raw >= 128, begin)
    digit = _share((raw >= 48) & (raw <= 57), begin)
    other = _share(((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126)), begin)
    lines = _share(raw == 10, begin)
    h = w.hashes()
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))) if len(h) else np.zeros(0, bool)
    pair = np.stack([w.doc.astype(np.uint64), h]) if len(h) else np.zeros((2, 0), np.uint64)
    order = np.lexsort((pair[1], pair[0]))
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (np.diff(pair[0][order]) != 0) | (np.diff(pair[1][order]) != 0)
    distinct = np.bincount(w.doc[order][new], minlength=w.count) if len(h) else np.zeros(w.count)
    length = (w.end - w.start).astype(np.float64)
    sums = lambda x: np.bincount(w.doc, weights=x, minlength=w.count) if len(h) else np.zeros(w.count)
    last = raw[np.maximum(w.end - 1, 0)] if len(h) else np.zeros(0, np.uint8)
    first = raw[w.start] if len(h) else np.zeros(0, np.uint8)
    alone = sums((length == 1) & ~(((first | 32) >= 97) & ((first | 32) <= 122)) & (first < 128))
    stop = sums((last == 46) | (last == 63))
    symbol = sums(((last < 48) & (last != 46) & (last != 44)) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 127)))
    caps = sums((first >= 65) & (first <= 90))
    mean = sums(length) / n1
    spread = np.sqrt(np.maximum(sums(length * length) / n1 - mean * mean, 0))
    letters = np.maximum(upper + lower, 1)
    variety = np.log1p(distinct) / np.maximum(np.log1p(n), 1)  # of a long clean text about as of a short one
    out = np.stack([
        upper / letters, (upper / letters) > 0.5, digit / b1, other / b1, high / b1, alone / n1, stop / n1, symbol / n1,
        symbol / n1 > 0.2, caps / n1, sums(same) / n1, variety, np.minimum(mean / 16, 2), np.minimum(spread / 8, 2),
        np.minimum(lines / n1, 1), np.minimum(np.log1p(n), 6) / 6, np.minimum(np.log1p(size), 8) / 8, n < 5, n < 20, alone / n1 > 0.2,
        variety < 0.7, stop == 0, sums(same) / n1 > 0.1, size == 0,
    ], axis=1).astype(np.float32)
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the word features and the dense statistics.

    A word's value is (1 + ln count) over the text's norm: long and short texts weigh alike.
    """
    w = Words(texts)
    column = (w.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int64)
    cell, count = np.unique(w.doc * WORD_BUCKETS + column, return_counts=True)
    row, column = cell // WORD_BUCKETS, cell % WORD_BUCKETS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=w.count))
    return row, column, (value / np.maximum(norm[row], 1e-9)).astype(np.float32), statistics(w)


def gathered(texts: Iterable[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`features` of all texts, made from about `limit` bytes at a time."""
    parts, run, size, count = [], [], 0, 0

    def close() -> None:
        nonlocal run, size, count
        row, column, value, stats = features(run)
        parts.append(((row + count).astype(np.int32), column.astype(np.int16), value, stats))
        run, size, count = [], 0, count + len(run)

    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            close()
    if run:
        close()
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # FEATURES
    v: np.ndarray  # FEATURES x rank

    def _parts(self, row, column, value, stats):
        n = len(stats)
        linear = self.w0 + np.bincount(row, weights=self.w[column] * value, minlength=n) + stats @ self.w[WORD_BUCKETS:]
        rank = self.v.shape[1]
        s = np.empty((n, rank))
        q = np.empty((n, rank))
        for f in range(rank):
            vx = self.v[column, f] * value
            s[:, f] = np.bincount(row, weights=vx, minlength=n)
            q[:, f] = np.bincount(row, weights=vx * vx, minlength=n)
        dense = self.v[WORD_BUCKETS:]
        return linear, s + stats @ dense, q + (stats * stats) @ (dense * dense)

    def score(self, texts: list[bytes]) -> np.ndarray:
        linear, s, q = self._parts(*features(texts))
        z = linear + 0.5 * (s * s - q).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: Iterable[bytes], labels: np.ndarray, rank: int = 4, steps: int = 600, seed: int = 7) -> Machine:
    """Logistic loss, Adam over about `steps` mini-batches in a fixed order: the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, rank)))
    if n == 0:
        m.v[:] = 0
        return m
    y = labels.astype(np.float64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m.w0 = float(np.log(share / (1 - share)))
    row, column, value, stats = gathered(texts)
    first = np.searchsorted(row, np.arange(n + 1))
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("w0", np.zeros(1)), ("w", m.w), ("v", m.v))}
    step, rate, decay = 0, 0.02, 1e-4
    batches = max(1, min(n // 16, max(n // 256, 16)))
    epochs = max(3, -(-steps // batches))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), batches):
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            r = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
            c, x, d = column[take], value[take], stats[part]
            linear, s, q = m._parts(r, c, x, d)
            p = 1 / (1 + np.exp(-np.clip(linear + 0.5 * (s * s - q).sum(axis=1), -30, 30)))
            g = (p - y[part]) / len(part)
            gx = g[r] * x
            gw = np.concatenate([np.bincount(c, weights=gx, minlength=WORD_BUCKETS), d.T @ g])
            gv = np.empty_like(m.v)
            for f in range(rank):
                gv[:WORD_BUCKETS, f] = np.bincount(c, weights=gx * (s[r, f] - m.v[c, f] * x), minlength=WORD_BUCKETS)
                gv[WORD_BUCKETS:, f] = d.T @ (g * s[:, f]) - (d * d).T @ g * m.v[WORD_BUCKETS:, f]
            step += 1
            for key, grad in (("w0", np.array([g.sum()])), ("w", gw + decay * m.w), ("v", gv + decay * m.v)):
                a, b = moments[key]
                a *= 0.9
                a += 0.1 * grad
                b *= 0.999
                b += 0.001 * grad * grad
                move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                if key == "w0":
                    m.w0 -= float(move[0])
                elif key == "w":
                    m.w -= move
                else:
                    m.v -= move
        rate *= 0.05 ** (1 / epochs)
    return m


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_text: int = MAX_TEXT, max_chars: int = 1 << 26) -> Machine:
    """Fits on at most max_train labelled rows that aren't held out, the ones with the smallest hash of their id.

    The sample's whole texts come to the driver in id order until max_chars characters; texts of more than max_text are
    no training rows (they are scored like all others), so one long text can't use that room up.  The three bounds are
    fixed whatever the corpus's size.  Labels other than 0 and 1 and null ids count for nothing; of several labels of an
    id the larger holds.  No labels: the machine answers 0.5 for every text.
    """
    picked = (
        labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("_y"))
        .select("doc_id", "_y", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(max_train)
    )
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_text)
    rows = stage(short.join(F.broadcast(stage(picked, "op7-labels")), "doc_id"), "op7-sample")
    order = ["_h", "doc_id", "_t"]
    rows = rows.withColumn("_t", F.xxhash64("text"))
    room, ys, last = max_chars, [], None
    for r in rows.select(*order, "_y", F.length("text").alias("n")).orderBy(*order).limit(max_train).collect():
        room -= r["n"]
        if room < 0:
            break
        last = r
        ys.append(r["_y"])
    if last is None:
        return fit([], np.zeros(0))
    # the same first rows again, now with their texts, of which the driver holds a few at a time
    kept = rows.where(F.struct("_h", "doc_id", "_t") <= F.struct(*(F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in order)))
    texts = kept.select(*order, "text").orderBy(*order).toLocalIterator()
    return fit((r["text"].encode() for _, r in zip(ys, texts)), np.array(ys))


def score(self, texts: list[bytes]) -> np.ndarray:
        linear, s, q = self._parts(*features(texts))
        z = linear + 0.5 * (s * s - q).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: Iterable[bytes], labels: np.ndarray, rank: int = 4, steps: int = 600, seed: int = 7) -> Machine:
    """Logistic loss, Adam over about `steps` mini-batches in a fixed order: the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, rank)))
    if n == 0:
        m.v[:] = 0
        return m
    y = labels.astype(np.float64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m.w0 = float(np.log(share / (1 - share)))
    row, column, value, stats = gathered(texts)
    first = np.searchsorted(row, np.arange(n + 1))
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("w0", np.zeros(1)), ("w", m.w), ("v", m.v))}
    step, rate, decay = 0, 0.02, 1e-4
    batches = max(1, min(n // 16, max(n // 256, 16)))
    epochs = max(3, -(-steps // batches))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), batches):
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            r = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
            c, x, d = column[take], value[take], stats[part]
            linear, s, q = m._parts(r, c, x, d)
            p = 1 / (1 + np.exp(-np.clip(linear + 0.5 * (s * s - q).sum(axis=1), -30, 30)))
            g = (p - y[part]) / len(part)
            gx = g[r] * x
            gw = np.concatenate([np.bincount(c, weights=gx, minlength=WORD_BUCKETS), d.T @ g])
            gv = np.empty_like(m.v)
            for f in range(rank):
                gv[:WORD_BUCKETS, f] = np.bincount(c, weights=gx * (s[r, f] - m.v[c, f] * x), minlength=WORD_BUCKETS)
                gv[WORD_BUCKETS:, f] = d.T @ (g * s[:, f]) - (d * d).T @ g * m.v[WORD_BUCKETS:, f]
            step += 1
            for key, grad in (("w0", np.array([g.sum()])), ("w", gw + decay * m.w), ("v", gv + decay * m.v)):
                a, b = moments[key]
                a *= 0.9
                a += 0.1 * grad
                b *= 0.999
                b += 0.001 * grad * grad
                move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                if key == "w0":
                    m.w0 -= float(move[0])
                elif key == "w":
                    m.w -= move
                else:
                    m.v -= move
        rate *= 0.05 ** (1 / epochs)
    return m


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_text: int = MAX_TEXT) -> Machine:
    """Fits on at most max_train labelled rows that aren't held out, the ones with the smallest hash of their id.

    Texts of more than max_text characters are no training rows (they are scored like all others), so the sample's whole
    texts, which the driver reads one by one in id order and keeps as features, are bounded whatever the corpus's size.
    Labels other than 0 and 1 and null ids count for nothing; of several labels of an id the larger holds.  No labels:
    the machine answers 0.5 for every text.
    """
    picked = (
        labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("_y"))
        .select("doc_id", "_y", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(max_train)
    )
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_text)
    rows = stage(short.join(F.broadcast(stage(picked, "op7-labels")), "doc_id"), "op7-sample")
    # repeated ids may be more rows than labels; the first max_train in a total order are the sample
    texts = rows.orderBy("_h", "doc_id", F.xxhash64("text"), "text").limit(max_train)
    ys: list[int] = []

    def read() -> Iterator[bytes]:
        for r in texts.select("_y", "text").toLocalIterator():
            ys.append(r["_y"])
            yield r["text"].encode()

    return fit(read(), ys)


def score(self, texts: list[bytes]) -> np.ndarray:
        linear, s, q = self._parts(*features(texts))
        z = linear + 0.5 * (s * s - q).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: Iterable[bytes], labels: np.ndarray, rank: int = 4, steps: int = 600, seed: int = 7) -> Machine:
    """Logistic loss, Adam over about `steps` mini-batches in a fixed order: the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, rank)))
    if n == 0:
        m.v[:] = 0
        return m
    y = labels.astype(np.float64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m.w0 = float(np.log(share / (1 - share)))
    row, column, value, stats = gathered(texts)
    first = np.searchsorted(row, np.arange(n + 1))
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("w0", np.zeros(1)), ("w", m.w), ("v", m.v))}
    step, rate, decay = 0, 0.02, 1e-4
    batches = max(1, min(n // 16, max(n // 256, 16)))
    epochs = max(3, -(-steps // batches))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), batches):
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            r = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
            c, x, d = column[take], value[take], stats[part]
            linear, s, q = m._parts(r, c, x, d)
            p = 1 / (1 + np.exp(-np.clip(linear + 0.5 * (s * s - q).sum(axis=1), -30, 30)))
            g = (p - y[part]) / len(part)
            gx = g[r] * x
            gw = np.concatenate([np.bincount(c, weights=gx, minlength=WORD_BUCKETS), d.T @ g])
            gv = np.empty_like(m.v)
            for f in range(rank):
                gv[:WORD_BUCKETS, f] = np.bincount(c, weights=gx * (s[r, f] - m.v[c, f] * x), minlength=WORD_BUCKETS)
                gv[WORD_BUCKETS:, f] = d.T @ (g * s[:, f]) - (d * d).T @ g * m.v[WORD_BUCKETS:, f]
            step += 1
            for key, grad in (("w0", np.array([g.sum()])), ("w", gw + decay * m.w), ("v", gv + decay * m.v)):
                a, b = moments[key]
                a *= 0.9
                a += 0.1 * grad
                b *= 0.999
                b += 0.001 * grad * grad
                move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                if key == "w0":
                    m.w0 -= float(move[0])
                elif key == "w":
                    m.w -= move
                else:
                    m.v -= move
        rate *= 0.05 ** (1 / epochs)
    return m


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = 1 << 26) -> Machine:
    """Fits on at most max_train labelled rows that aren't held out, the ones with the smallest hash of their id.

    The sample's whole texts come to the driver in id order until max_chars characters; both bounds are fixed
    whatever the corpus's size.  No labels: the machine answers 0.5 for every text.
    """
    picked = (
        labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("_y"))
        .select("doc_id", "_y", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(max_train)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(stage(picked, "op7-labels")), "doc_id")
        .withColumn("text", F.coalesce("text", F.lit("")))
    )
    rows = stage(rows, "op7-sample")
    order = ["_h", "doc_id", "_t"]
    rows = rows.withColumn("_t", F.xxhash64("text"))
    room, ys, last = max_chars, [], None
    for r in rows.select(*order, "_y", F.length("text").alias("n")).orderBy(*order).limit(max_train).collect():
        room -= r["n"]
        if room < 0:
            break
        last = r
        ys.append(r["_y"])
    if last is None:
        return fit([], np.zeros(0))
    # the same first rows again, now with their texts, of which the driver holds a few at a time
    kept = rows.where(F.struct("_h", "doc_id", "_t") <= F.struct(*(F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in order)))
    texts = kept.select(*order, "text").orderBy(*order).toLocalIterator()
    return fit((r["text"].encode() for _, r in zip(ys, texts)), np.array(ys))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null and empty texts are scored as empty texts."""
    w0, w, v = machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)

    def run(batches):
        m = Machine(w0, w.astype(np.float64), v.astype(np.float64))
        for part, texts in chunks(batches, 1):
            s = m.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least threshold, all columns as they are.

    The score is computed beside the row, in one pass without a join, so repeated and null ids are no matter.
    """
    w0, w, v = machine.w0, machine.w, machine.v
    at = docs.columns.index("text")

    def run(batches):
        m = Machine(w0, w, v)
        for part, texts in chunks(batches, at):
            yield part.filter(pa.array(m.score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
