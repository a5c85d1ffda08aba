"""Token counts of whole texts with the library of the tokenizer, huge documents in overlapping chunks.

A text up to ``huge`` bytes is encoded as it is. A longer one is cut into chunks that overlap their neighbours on both
sides; chunks are rows of their own, dealt to all tasks, and each is encoded with byte offsets. Two neighbours are
spliced at a stable boundary that both encodings have in their overlap: a token start between two characters that
stand side by side in no piece of the vocabulary. No merge can cross such a place in any context, so the tokens on
either side of it are those of the whole text; this is a proof, not a guess from agreement. Where two neighbours share
no such boundary, the document is encoded again with an overlap four times as wide, in the end as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import stored

HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
_GROUP = 64


class Encoder:
    """A tokenizer file with the counting and the stable boundaries it allows; one for each worker and file."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        normal = [self.model.id_to_piece(i) for i in range(size) if not (
            self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.side_by_side = {pair for piece in normal for pair in zip(piece, piece[1:])}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def boundaries(self, chunk: bytes, zones: list[tuple[int, int]]) -> tuple[int, list[list[tuple[int, int]]]]:
        """Number of tokens, and per zone of bytes its stable boundaries, each with the number of tokens before it."""
        pieces = self.model.encode(chunk.decode(), return_type="proto").pieces
        found: list[list[tuple[int, int]]] = [[] for _ in zones]
        last = -1
        for before, piece in enumerate(pieces):
            at = piece.begin
            if at == last:
                continue
            last = at
            for zone, (low, high) in zip(found, zones):
                if low < at < high and self._stable(chunk, at):
                    zone.append((at, before))
        return len(pieces), found

    def _stable(self, chunk: bytes, at: int) -> bool:
        start = at - 1
        while chunk[start] & 0xC0 == 0x80:
            start -= 1
        stop = at + 1
        while stop < len(chunk) and chunk[stop] & 0xC0 == 0x80:
            stop += 1
        pair = chunk[start:stop].decode().replace(" ", "▁")
        return (pair[0], pair[1]) not in self.side_by_side


def _character_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _chunks(texts: DataFrame, overlap: int, chunk: int) -> DataFrame:
    """``key, nth, chunks, first, left, right, body``: body starts at byte ``first``; left and right are the byte ranges
    shared with the neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "nth", "chunks", "first", "left_end", "right_start", "body"]
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                size = len(data)
                number = max(1, -(-size // chunk)) if overlap < size else 1
                cuts = [_character_start(data, i * chunk) for i in range(number)] + [size]
                for i in range(number):
                    first = _character_start(data, max(0, cuts[i] - overlap)) if i else 0
                    last = _character_start(data, min(size, cuts[i + 1] + overlap))
                    left_end = _character_start(data, min(size, cuts[i] + overlap)) if i else 0
                    right_start = _character_start(data, max(0, cuts[i + 1] - overlap)) if i + 1 < number else size
                    row = [[key], [i], [number], [first], [left_end], [right_start], [data[first:last]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (
                        pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)

    return texts.mapInArrow(run, "key long, nth int, chunks int, first long, left_end long, right_start long, body binary")


def _encoded(chunks: DataFrame, path: str) -> DataFrame:
    """Per chunk its number of tokens and the stable boundaries (place in the document, tokens before) on both sides."""
    marks = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "nth", "chunks", "tokens", "left_marks", "right_marks"]
        encoder = Encoder.at(path)
        for batch in batches:
            for row in batch.to_pylist():
                first = row["first"]
                zones = [(0, row["left_end"] - first), (row["right_start"] - first, len(row["body"]))]
                tokens, found = encoder.boundaries(row["body"], zones)
                left, right = ([{"at": first + at, "before": n} for at, n in zone] for zone in found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["key"]], pa.int64()), pa.array([row["nth"]], pa.int32()),
                    pa.array([row["chunks"]], pa.int32()), pa.array([tokens], pa.int64()),
                    pa.array([left if row["nth"] else []], marks),
                    pa.array([right if row["nth"] + 1 < row["chunks"] else []], marks)], names)

    mark = "array<struct<at:long,before:long>>"
    return chunks.mapInArrow(
        run, f"key long, nth int, chunks int, tokens long, left_marks {mark}, right_marks {mark}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """``key, tokens`` per document; tokens is null where two neighbours share no stable boundary.

    A window holds the chunks of one document, each with the few marks of its overlaps.
    """
    in_order = Window.partitionBy("key").orderBy("nth")
    places = lambda marks: F.transform(marks, lambda m: m["at"])
    both = encoded.withColumn("before_marks", F.lag("right_marks").over(in_order)).withColumn(
        "start", F.array_min(F.array_intersect(places("before_marks"), places("left_marks"))))
    both = both.withColumn("end", F.lead("start").over(in_order))
    before = lambda marks, at: F.filter(marks, lambda m: m["at"] == at)[0]["before"]
    first = F.when(F.col("nth") == 0, F.lit(0)).when(F.col("start").isNotNull(), before(F.col("left_marks"), F.col("start")))
    last = F.when(F.col("nth") + 1 == F.col("chunks"), F.col("tokens")).when(
        F.col("end").isNotNull(), before(F.col("right_marks"), F.col("end")))
    # A chunk's part must not end before it starts; then the overlaps are wider than the chunk and widening goes on.
    own = F.when((last >= first), last - first)
    return both.withColumn("own", own).groupBy("key").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("tokens"))


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, tokens`` from ``key, text`` with unique keys."""
    rest, out = texts, None
    while True:
        cut = _chunks(rest, overlap, chunk)
        spread = cut.repartition(F.col("key"), F.col("nth"))
        spliced = stored(_spliced(_encoded(spread, path)))
        done = spliced.filter(F.col("tokens").isNotNull())
        out = done if out is None else out.unionByName(done)
        failed = spliced.filter(F.col("tokens").isNull())
        if failed.isEmpty():
            return out
        rest, overlap = rest.join(failed.select("key"), "key", "left_semi"), overlap * 4
        chunk = max(chunk, 2 * overlap)


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 4096, huge: int = HUGE,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row, whole texts.

    ``path`` is a SentencePiece model that every executor has. A null text counts as empty, which has no tokens. Rows may
    repeat, ids may be null, an empty table gives an empty result and other columns are ignored.
    """
    kind = docs.schema[id].dataType
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("text"), F.octet_length(body).cast("bigint").alias("n_bytes"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, _GROUP):
                counts += encoder.counts(batch.column(1).slice(at, _GROUP).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    whole = rows.filter(F.col("n_bytes") <= huge).mapInArrow(small, schema)
    # A key per different text: equal texts are encoded once.
    long = rows.filter(F.col("n_bytes") > huge).withColumn("key", F.xxhash64("text"))
    counted = huge_counts(long.select("key", "text").dropDuplicates(["key"]), path, chunk, overlap)
    pieced = long.select("id", "n_bytes", "key").join(counted, "key").select("id", "n_bytes", F.col("tokens").alias("n_tokens"))
    return whole.unionByName(pieced).select(F.col("id").alias(id), "n_bytes", "n_tokens",
                                            (F.col("n_tokens") > limit).alias("over_limit"))
