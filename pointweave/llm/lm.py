"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | h) = l0 / (V + 1) + l1 * c(w) / N + l2 * c(hw) / c(h), with weights by the magnitude of c(h). The weights are
learned by expectation-maximisation on a held-out part of the training documents, whose own counts are deleted from the
estimates for it.

How counts travel: documents are packed once into shards of bounded size, a compressed blob each. A shard sends its
distinct words and word pairs, as sorted 64-bit hashes with counts, to the reducers that own their ranges. A reducer
sums and sends back, for each block it got, the corpus-wide counts in the block's order, so keys travel only once and
answers are small. With its answers a shard scores its own documents. Nothing here depends on how often a word, a
document id or a source occurs: a frequent word is one key of every shard. Nothing of the corpus reaches the driver but
sums by magnitude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import discard, stored

SHARD_BYTES = 8_000_000
REDUCER_BYTES = 16_000_000
#: Fold 0 is never learned from, fold 1 is the part on which the weights are learned.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
ROUNDS = 12
#: Each magnitude's weights count as if so many more tokens had the overall weights.
PRIOR = 20.0
LEAST_UNIFORM = 1e-6
_END = xxhash.xxh64_intdigest(b"\n")
_START = xxhash.xxh64_intdigest(b" ")
_MAGNITUDES = 64


def _pack(buffer: list[tuple], deleted: bool, nth: int, id_type: pa.DataType) -> pa.RecordBatch:
    ids, folds, texts = zip(*buffer)
    data = b"".join(texts)
    name = f"{TaskContext.get().partitionId()}-{nth}"
    return pa.RecordBatch.from_arrays([
        pa.array([name]), pa.array([deleted]), pa.array([ids], pa.list_(id_type)), pa.array([folds], pa.list_(pa.int32())),
        pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([len(data)], pa.int64()),
        pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary())],
        ["shard", "deleted", "ids", "folds", "lengths", "bytes", "blob"])


def _shards(docs: DataFrame, id: str, text: str, shard_bytes: int) -> DataFrame:
    """Documents in shards of about ``shard_bytes`` (a longer document is a shard of its own); those of the deleted fold
    are kept apart. Names need to differ only within this one table, which is written once."""
    id_type = docs.schema[id].dataType
    arrow_id = pa.schema(docs.select(id).limit(0).toArrow().schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[bool, list] = {False: [], True: []}
        sizes, nth = {False: 0, True: 0}, 0
        for batch in batches:
            for own, fold, body in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                data, deleted = (body.as_py() or "").encode().lower(), fold == DELETED
                if buffers[deleted] and sizes[deleted] + len(data) > shard_bytes:
                    yield _pack(buffers[deleted], deleted, nth, arrow_id)
                    buffers[deleted], sizes[deleted], nth = [], 0, nth + 1
                buffers[deleted].append((own.as_py(), fold, data))
                sizes[deleted] += len(data)
        for deleted, buffer in buffers.items():
            if buffer:
                yield _pack(buffer, deleted, nth, arrow_id)
                nth += 1

    fold = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % FOLDS
    schema = T.StructType([
        T.StructField("shard", T.StringType()), T.StructField("deleted", T.BooleanType()),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("folds", T.ArrayType(T.IntegerType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.LongType()),
        T.StructField("blob", T.BinaryType())])
    return docs.select(F.col(id), fold.cast("int").alias("fold"), F.col(text).cast("string")).mapInArrow(run, schema)


class _Shard:
    """A shard's tokens: per document its words and one end, as hashes."""

    def __init__(self, row: dict):
        data = pa.decompress(row["blob"], decompressed_size=row["bytes"], codec="zstd", asbytes=True) if row["bytes"] else b""
        parts, counts, at = [], [], 0
        for length in row["lengths"]:
            words = data[at:at + length].split()
            at += length
            hashes = np.empty(len(words) + 1, np.uint64)
            hashes[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            hashes[-1] = _END
            parts.append(hashes)
            counts.append(len(hashes))
        self.ids, self.n_tokens = row["ids"], np.array(counts, np.int64)
        self.starts = np.cumsum(self.n_tokens) - self.n_tokens
        self.words = np.concatenate(parts)
        context = np.empty_like(self.words)
        context[1:] = self.words[:-1]
        context[self.starts] = _START
        self.pairs = _mixed(context, self.words)
        self.learned = np.repeat(np.array(row["folds"]) != HELD_OUT, self.n_tokens)
        self.context = context


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of pairs of hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _encode_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their first one and differences of as few bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    packed = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + packed.tobytes()


def _decode_keys(data: bytes) -> np.ndarray:
    width, first = data[0], int.from_bytes(data[1:9], "little")
    packed = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(packed) + 1, 8), np.uint8)
    steps[1:, :width] = packed
    keys = steps.reshape(-1).view("<u8")
    keys[0] = first
    return np.cumsum(keys, dtype=np.uint64)


def _encode_counts(counts: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _decode_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=learned, minlength=len(unique)).astype(np.int64)


def _count_blocks(reducers: int):
    """Per shard, kind (0 words, 1 pairs) and reducer: the distinct keys in the reducer's range, and their counts."""
    borders = np.array([(i << 64) // reducers for i in range(1, reducers)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = _Shard(row)
                for kind, tokens in enumerate((shard.words, shard.pairs)):
                    keys, counts = _counted(tokens, shard.learned)
                    cuts = [0, *np.searchsorted(keys, borders).tolist(), len(keys)]
                    out: list[list] = [[], [], []]
                    for reducer, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if b > a:
                            for column, value in zip(out, (reducer, _encode_keys(keys[a:b]), _encode_counts(counts[a:b]))):
                                column.append(value)
                    n = len(out[0])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([kind] * n, pa.int32()), pa.array(out[0], pa.int32()), pa.array([row["shard"]] * n),
                        pa.array([row["deleted"]] * n), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                        ["kind", "reducer", "shard", "deleted", "keys", "counts"])

    return run


def _answers(blocks: pa.Table) -> pa.Table:
    """Corpus-wide counts for each block of one reducer, those in the deleted fold for shards of it, and once the number
    of distinct keys and of tokens."""
    keys = [_decode_keys(k) for k in blocks.column("keys").to_pylist()]
    counts = [_decode_counts(c) for c in blocks.column("counts").to_pylist()]
    deleted = blocks.column("deleted").to_pylist()
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.concatenate(counts)
    total = np.bincount(place, every, len(unique)).astype(np.int64)
    own = np.repeat(np.array(deleted), [len(k) for k in keys])
    gone = np.bincount(place, every * own, len(unique)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys]).tolist()
    cuts = list(zip([0, *ends], ends))
    n = len(keys)
    zeros = [0] * (n - 1)
    return pa.table([
        pa.array(blocks.column("shard").to_pylist()), pa.array(deleted), blocks.column("kind").cast(pa.int32()),
        blocks.column("reducer").cast(pa.int32()),
        pa.array([_encode_counts(total[place[a:b]]) for a, b in cuts], pa.binary()),
        pa.array([_encode_counts(gone[place[a:b]]) if d else None for (a, b), d in zip(cuts, deleted)], pa.binary()),
        pa.array([int((total > 0).sum()), *zeros], pa.int64()), pa.array([int(total.sum()), *zeros], pa.int64()),
        pa.array([int(gone.sum()), *zeros], pa.int64())],
        ["shard", "deleted", "kind", "reducer", "total", "gone", "types", "tokens", "gone_tokens"])


class _Counts:
    """Counts of each token of a shard: its word, its pair and its context."""

    def __init__(self, shard: _Shard, answers: pa.Table, column: str):
        rows = sorted(answers.select(["kind", "reducer", column]).to_pylist(), key=lambda r: (r["kind"], r["reducer"]))
        by_kind = [np.concatenate([_decode_counts(r[column]) for r in rows if r["kind"] == kind]) for kind in (0, 1)]
        words, place = np.unique(shard.words, return_inverse=True)
        self.word = by_kind[0][place]
        self.pair = by_kind[1][np.unique(shard.pairs, return_inverse=True)[1]]
        # A word is followed by exactly one token each time, a document starts as often as one ends.
        ends = by_kind[0][np.searchsorted(words, np.uint64(_END))]
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[shard.starts] = ends
        self.context = context


def _magnitude(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else the number of binary digits of its count."""
    return np.frexp(context.astype(np.float64))[1]


def _share(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _events(tokens: int, gone: int):
    """Distinct (magnitude, unigram and bigram estimate) of a deleted shard's tokens with their number; a document's own
    fold is deleted from all counts."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["magnitude", "p1", "p2", "n"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.float64(), pa.float64(), pa.int64())], names)
        shard = _Shard(left.to_pylist()[0])
        total, own = _Counts(shard, right, "total"), _Counts(shard, right, "gone")
        context, pair, word = (getattr(total, k) - getattr(own, k) for k in ("context", "pair", "word"))
        order = np.lexsort((word, pair, context))
        context, pair, word = context[order], pair[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(context) != 0) | (np.diff(pair) != 0) | (np.diff(word) != 0)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(order)))
        context, pair, word = context[at], pair[at], word[at]
        return pa.table([pa.array(_magnitude(context), pa.int32()), pa.array(_share(word, tokens - gone)),
                         pa.array(_share(pair, context)), pa.array(n)], names)

    return run


def _normal(weights: np.ndarray, seen: bool) -> tuple[float, ...]:
    """Weights that sum to 1, none to the bigram after an unseen context, at least a little to the uniform part."""
    w = np.maximum(weights * [1, 1, seen], [LEAST_UNIFORM, 0, 0])
    return tuple((w / w.sum()).tolist())


def learn(events: DataFrame, vocabulary: int, rounds: int = ROUNDS, prior: float = PRIOR) -> list[tuple[float, ...]]:
    """Weights (uniform, unigram, bigram) by magnitude, by expectation-maximisation over ``events``.

    Each round is one aggregate; what comes back are at most 64 rows of sums. Magnitudes without events have the overall
    weights.
    """
    weights = [_normal(np.array([0.1, 0.4, 0.5]), m > 0) for m in range(_MAGNITUDES)]
    p = [F.lit(1.0 / (vocabulary + 1)), F.col("p1"), F.col("p2")]
    for _ in range(rounds):
        table = F.array(*[F.array(*[F.lit(x) for x in w]) for w in weights])
        own = F.element_at(table, F.col("magnitude") + 1)
        parts = [own[k] * p[k] for k in range(3)]
        sums = events.groupBy("magnitude").agg(F.sum("n").alias("n"), *[
            F.sum(F.col("n") * parts[k] / (parts[0] + parts[1] + parts[2])).alias(f"s{k}") for k in range(3)]).collect()
        if not sums:
            break
        found = {r["magnitude"]: (r["n"], np.array([r["s0"], r["s1"], r["s2"]])) for r in sums}
        overall = sum(s for _, s in found.values()) / sum(n for n, _ in found.values())
        none = (0, np.zeros(3))
        weights = [_normal((found.get(m, none)[1] + prior * overall) / (found.get(m, none)[0] + prior), m > 0)
                   for m in range(_MAGNITUDES)]
    return weights


def _score(id: str, id_type: pa.DataType, weights: list[tuple[float, ...]], tokens: int, types: int):
    mix = np.array(weights)
    names = [id, "held_out", "n_tokens", "n_known", "base_score", "score"]
    kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        row = left.to_pylist()[0]
        shard = _Shard(row)
        counts = _Counts(shard, right, "total")
        w = mix[_magnitude(counts.context)]
        p = w[:, 0] / (types + 1) + w[:, 1] * _share(counts.word, tokens) + w[:, 2] * _share(counts.pair, counts.context)
        base = np.log10((counts.word + 0.1) / (tokens + 0.1 * (types + 1)))
        summed = lambda x: np.add.reduceat(x, shard.starts)
        return pa.table([pa.array(x, k) for x, k in zip((
            row["ids"], np.array(row["folds"]) == HELD_OUT, shard.n_tokens, summed((counts.word > 0).astype(np.int64)),
            summed(base), summed(np.log10(p))), kinds)], names)

    return run


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
           reducer_bytes: int = REDUCER_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A document whose crc32(id as text) is divisible by 10 is held out, all others are learned from. A null text counts
    as empty, which is one end token; a null id counts as an empty one. Rows may repeat and are then counted and scored
    each time. Without any training document all weight is on the uniform part. An empty table gives an empty result,
    other columns are ignored.
    """
    packed = stored(_shards(docs, id, text, shard_bytes))
    reducers = max(1, math.ceil((packed.agg(F.sum("bytes")).first()[0] or 0) / reducer_bytes))
    blocks = packed.mapInArrow(_count_blocks(reducers), "kind int, reducer int, shard string, deleted boolean, keys binary, counts binary")
    answers = stored(blocks.groupBy("kind", "reducer").applyInArrow(
        _answers, "shard string, deleted boolean, kind int, reducer int, total binary, gone binary, types long, "
                  "tokens long, gone_tokens long"))
    types, tokens, gone = (x or 0 for x in answers.filter("kind = 0").agg(
        F.sum("types"), F.sum("tokens"), F.sum("gone_tokens")).first())
    needed = ["shard", "kind", "reducer", "total"]
    part, replies = packed.filter("deleted"), answers.filter("deleted").select(*needed, "gone")
    events = stored(part.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(
        _events(tokens, gone), "magnitude int, p1 double, p2 double, n long"))
    weights = learn(events, types, rounds) if tokens else [(1.0, 0.0, 0.0)] * _MAGNITUDES
    discard(events)
    id_type = docs.schema[id].dataType
    arrow_id = docs.select(id).limit(0).toArrow().schema.field(0).type
    schema = T.StructType([T.StructField(id, id_type), T.StructField("held_out", T.BooleanType()), *[
        T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")], *[
        T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]])
    scored = packed.groupBy("shard").cogroup(answers.select(*needed).groupBy("shard")).applyInArrow(
        _score(id, arrow_id, weights, tokens, types), schema)
    return scored.select(id, "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
