"""Packing along a space-filling curve.

A document's vector is the hashed counts of its token ids, projected to DIMS numbers by fixed random signs; the
Hilbert index of these numbers is its place on the curve.  Documents are laid end to end in that order and the
stream is cut every `width` tokens, so sequences hold neighbours of the curve and only the last one has padding.

Token ids travel as compressed bytes.  The order is found on narrow rows (key, length); ids are shuffled once, to
meet their position.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import parallelism, stage, with_position
from deltaloom.llm.textvec import chunks

WIDTH = 2048
END = 1
DIMS, BITS, BUCKETS = 4, 8, 256


class Encoder:
    """Ids of whole texts with the byte-level vocabulary of a tokenizers file.

    Texts are cut before single spaces, where that vocabulary's pre-tokens always part; the ids of a cut are
    remembered, so a word is encoded once for each worker and not once for each time that it occurs.  A text
    with a run of white space at a cut or with a special token goes to the tokenizer as a whole.
    """

    MEMORY = 500_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        held = json.load(open(path, encoding="utf-8"))
        special = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        self.special = list(special)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for piece, i in ranks.items():
            self.starts[i] = piece[:1] == b" "
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Each of `new` has no space and isn't empty: in ' a b c' a token that begins with a space begins one."""
        if not new:
            return
        if len(self.known) + len(new) > self.MEMORY:
            self.known.clear()
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(new)), np.uint32)
        at = np.flatnonzero(self.starts[ids])
        flat, ends = ids.astype("<u2").tobytes(), [*at[1:].tolist(), len(ids)]
        if len(at) != len(new):  # a word that begins with white space of its own: one at a time
            for w in new:
                self.known[w] = np.array(self.fast.encode_ordinary(" " + w), "<u2").tobytes()
            return
        self.known.update(zip(new, (flat[2 * a:2 * b] for a, b in zip(at.tolist(), ends))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        cut = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, "<u2")
            elif any(s in text for s in self.special):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2")
            elif "  " in text or text[0] == " " or text[-1] == " " or "\xa0" in text:
                out[i] = np.array(self.fast.encode_ordinary(text), "<u2")
            else:
                cut.append((i, text.split(" ")))
        seen = set().union(*(words[1:] for _, words in cut)) if cut else set()
        if len(self.known) + len(seen) > self.MEMORY:
            self.known.clear()
        self._learn([w for w in seen if w not in self.known])
        get = self.known.__getitem__
        for i, words in cut:
            head = np.array(self.fast.encode_ordinary(words[0]), "<u2").tobytes()
            out[i] = np.frombuffer(head + b"".join(map(get, words[1:])), "<u2")
        return out  # type: ignore[return-value]


#: Fixed value: the vocabulary's pre-token pattern, as its library states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of rows of unsigned coordinates below 2**bits.

    Coordinates become the transposed index by undoing, from the highest bit down, the inversions and exchanges
    of the curve's cells, then Gray decoding; the bits are interleaved at the end.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(dims):
            up = (x[i] & np.uint64(q)) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


_SIGNS = np.random.default_rng(11).choice([-1.0, 1.0], (BUCKETS, DIMS))


def curve_key(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents: counts of ids modulo BUCKETS, damped, centred, scaled to length 1, projected."""
    counts = np.stack([np.bincount(i % BUCKETS, minlength=BUCKETS) for i in ids]).astype(np.float64)
    v = np.log1p(counts)
    v -= v.mean(axis=1, keepdims=True)
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    flat = (np.tanh(v @ _SIGNS) + 1) / 2
    return hilbert(np.minimum((flat * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs' doc_id with _uid, _key (Hilbert), _n (tokens with the end mark) and _ids (compressed), staged."""

    def run(batches):
        encoder, pack = Encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for part, texts in chunks(batches, 1):
            ids = encoder.encode([t.decode("utf-8", "replace") for t in texts])
            mark = np.array([END], "<u2")
            ids = [np.concatenate([i, mark]) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(curve_key(ids)), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([pack.compress(i.tobytes()) for i in ids], pa.binary())],
                names=["doc_id", "_key", "_n", "_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, _key bigint, _n bigint, _ids binary")
    return stage(with_position(out, "_uid"), "op4-ids")


def positions(tokens: DataFrame) -> DataFrame:
    """_uid and _at: where each document begins in the stream, in the order (_key, doc_id, _uid).

    A range exchange of narrow rows, running sums inside each partition, and an offset for each partition.
    """
    spark = tokens.sparkSession
    order = ["_key", "doc_id", "_uid"]
    sorted_rows = (
        tokens.select("_uid", "_key", "doc_id", "_n")
        .repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).select("_uid", "_n")
    )

    def run(batches):
        total = 0
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False)
            end = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(end - n)], names=["_uid", "_n", "_in"])
            total = int(end[-1]) if len(end) else total

    held = stage(
        sorted_rows.mapInArrow(run, "_uid bigint, _n bigint, _in bigint").withColumn("_part", F.spark_partition_id()), "op4-order")
    totals = sorted((r[0], r[1]) for r in held.groupBy("_part").agg(F.sum("_n")).collect())  # one row a partition
    offsets, total = [], 0
    for part, n in totals:
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    return held.join(F.broadcast(table), "_part").select("_uid", (F.col("_in") + F.col("_offset")).alias("_at"))


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each row of docs.

    Null and empty texts are the end mark alone.  Repeated rows are packed once each.  Every id lies in exactly
    one piece; all sequences but the last are full.
    """
    tokens = tokenised(docs, tokenizer)
    placed = tokens.select("_uid", "doc_id", "_n", "_ids").join(positions(tokens), "_uid").select("doc_id", "_n", "_at", "_ids")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for i, (n, begin, blob) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())):
                    ids = np.frombuffer(unpack.decompress(blob, 2 * n), "<u2").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(begin + start, width)
                        length = min(width - offset, n - start)
                        rows.append((i, start, length, zlib.crc32(ids[start:start + length]), n, sequence, offset))
                        start += length
                which, *rest = (list(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which)), *(pa.array(x, pa.int64()) for x in rest)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

