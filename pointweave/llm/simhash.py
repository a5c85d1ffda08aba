"""SimHash near-duplicates by multi-index hashing.

A document's 64-bit fingerprint has a bit set where more than half of its shingle hashes have it. Documents link when
their fingerprints differ in at most ``distance`` bits, and a component is what links connect.

Finding the links: a fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most d bits, one
of the segments differs in at most d // 2. So every fingerprint is stored in a table under both segments, every
fingerprint looks up the small Hamming ball around both of its segments, and a match counts when the complete distance
is small enough. Only distinct fingerprints take part, so copies cost one row per group.

Skew: a segment value shared by more than ``CROWDED`` distinct fingerprints gets a finer key, a piece of the other
segment that must be equal by the same argument. Joins by fingerprint are plain equi-joins, whose large partitions
adaptive execution splits. Pairs that are too far apart never leave the join, as the distance is part of its condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.components import components
from ..session import discard, stored

SEED = 42
CROWDED = 4096
_HALF = 2**32 - 1
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text: A-Z lower-cased, words joined by one space, XXH64 of each shingle.

    A text with fewer words than ``shingle`` is one shingle, a text without words has fingerprint 0.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = len(tokens) - shingle + 1
    set_bits = np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        last = min(at + _BLOCK, total)
        spans = zip(starts[at:last].tolist(), ends[at + shingle - 1:last + shingle - 1].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64, last - at)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fingerprint`` (as signed BIGINT) of every row."""
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], [id, "fingerprint"])

    schema = T.StructType([T.StructField(id, kind), T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(run, schema)


def _segment(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(_HALF))


def _key(which: int, segment: Column) -> Column:
    """Both segments' keys in one BIGINT column: 32 bits of value, one of position."""
    return segment + F.lit(which * 2**32)


def _ball(radius: int) -> list[int]:
    """All 32-bit masks with at most ``radius`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(32), r)]


def _pieces(distance: int) -> list[tuple[int, int]]:
    """``distance + 1`` pieces (offset, mask) of 32 bits, of which one is equal if at most ``distance`` bits differ."""
    cuts = [round(32 * i / (distance + 1)) for i in range(distance + 2)]
    return [(a, 2 ** (b - a) - 1) for a, b in zip(cuts, cuts[1:])]


def links(distinct: DataFrame, distance: int = 3, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``src < dst`` of distinct ``fingerprint`` values that differ in 1 to ``distance`` bits, each once."""
    if not 0 <= distance <= 5:
        raise ValueError("distance must be from 0 to 5")
    radius = distance // 2
    fp = F.col("fingerprint")
    table = distinct.select(fp.alias("dst"), F.explode(F.array(*[
        F.struct(F.lit(w).alias("which"), _key(w, _segment(fp, w)).alias("key")) for w in (0, 1)])).alias("at")).select(
        "dst", "at.which", "at.key")
    masks = F.array(*[F.lit(m).cast("bigint") for m in _ball(radius)])
    probes = distinct.select(fp.alias("src"), F.explode(masks).alias("mask")).select("src", F.explode(F.array(*[
        _key(w, _segment(F.col("src"), w).bitwiseXOR(F.col("mask"))) for w in (0, 1)])).alias("key"))
    src, dst, which = F.col("src"), F.col("dst"), F.col("which")
    apart = F.bit_count(src.bitwiseXOR(dst))
    high_apart = F.bit_count(_segment(src.bitwiseXOR(dst), 0))
    # A pair is taken where its high segments match; only if they don't, where its low ones do.
    near = (src < dst) & (apart <= distance) & ((which == 0) | (high_apart > radius))
    crowds = stored(table.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > crowded).select("key"))
    if crowds.isEmpty():
        discard(crowds)
        return probes.join(table, "key").filter(near).select("src", "dst")
    plain = probes.join(crowds, "key", "left_anti").join(table, "key").filter(near).select("src", "dst")

    pieces = _pieces(distance)

    def refined(side: DataFrame, of: str) -> DataFrame:
        other = F.when(F.col("key") < 2**32, _segment(F.col(of), 1)).otherwise(_segment(F.col(of), 0))
        return side.join(crowds, "key", "left_semi").select("*", F.explode(F.array(*[
            F.struct(F.lit(i).alias("piece"), F.shiftright(other, at).bitwiseAND(F.lit(mask)).alias("value"))
            for i, (at, mask) in enumerate(pieces)])).alias("sub")).select(*side.columns, "sub.piece", "sub.value")

    changed = src.bitwiseXOR(dst)
    other_changed = F.when(which == 0, _segment(changed, 1)).otherwise(_segment(changed, 0))
    first_equal = F.coalesce(*[F.when(F.shiftright(other_changed, at).bitwiseAND(F.lit(mask)) == 0, F.lit(i))
                               for i, (at, mask) in enumerate(pieces)])
    split = refined(probes, "src").join(refined(table, "dst"), ["key", "piece", "value"]).filter(
        near & (F.col("piece") == first_equal)).select("src", "dst")
    return plain.unionByName(split)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3,
                    crowded: int = CROWDED) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that
    links reach.

    Null and empty texts have fingerprint zero and link like any other. A row with a null id is linked like any other
    but names no component unless all ids of it are null, which gives null. Rows may repeat; rows that share an id are
    linked by their texts alone. Other columns are ignored, an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id, text, shingle))
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(id).alias("first_id")))
    found = stored(links(distinct, distance, crowded))
    labels = components(found)
    grouped = labels.join(distinct, labels["id"] == distinct["fingerprint"]).select("fingerprint", "label", "first_id")
    roots = grouped.groupBy("label").agg(F.min("first_id").alias("root_id"))
    linked = grouped.join(roots, "label").select("fingerprint", "root_id")
    directory = distinct.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root_id", "first_id").alias("component_id"))
    return prints.join(directory, "fingerprint").select(
        F.col(id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
