"""URL filters with a sorted digest array.

A filter list is cut into shards by digest. A shard holds the sorted 64-bit XXH64 digests of its entries and, at the
same places, their full strings. A task maps a shard's digests into memory from a file of its own, probes them with a
vectorised binary search and compares the full string at every equal digest, so a collision can't block a URL.

A URL is looked up as every suffix of its host (at label borders) with every prefix of its path whose length occurs in
the list. Small lists (``SMALL_LIST`` bytes, checked) go to every task and no URL moves. For larger ones the lookups
are dealt by shard, and a shard with many lookups is repeated over several tasks, each with a part of them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stored
from .common import same

SMALL_LIST = 64_000_000
SHARD_ENTRIES = 250_000
PROBES_PER_TASK = 2_000_000
#: Kinds of entries; among those that fit, an own rule goes before the list.
LISTED, ALLOW, BLOCK = 0, 1, 2


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """One shard: sorted digests in a mapped file, their strings and kinds at the same places."""

    def __init__(self, digests: np.ndarray, entries: Sequence[str], kinds: Sequence[int]):
        with tempfile.NamedTemporaryFile(prefix="digests-", delete=False) as file:
            file.write(np.ascontiguousarray(digests, "<u8").tobytes() or b"\0")
        # The mapping outlives the name, so nothing is left behind however the task ends.
        self.digests = np.memmap(file.name, "<u8", "r", shape=(max(1, len(digests)),))[:len(digests)]
        os.unlink(file.name)
        self.entries, self.kinds = entries, kinds

    def probe(self, texts: Sequence[str]) -> np.ndarray:
        """Place of each text, or -1."""
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.digests, keys)
        found = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero(at < len(self.digests))
        for i in inside[self.digests[at[inside]] == keys[inside]].tolist():
            place = int(at[i])
            while place < len(self.digests) and self.digests[place] == keys[i]:  # entries whose digests collide
                if self.entries[place] == texts[i]:
                    found[i] = place
                    break
                place += 1
        return found


def lookups(host_: str, path_: str, lengths: Sequence[int]) -> list[str]:
    """What an entry that fits may read: a host suffix followed by a path prefix."""
    labels = host_.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return [h + path_[:n] for n in lengths if n <= len(path_) for h in hosts]


def _better(entry: str, kind: int, best: tuple[str, int] | None) -> bool:
    """Own rules before the list, the longest first; of equally long ones the one with the longer host."""
    rank = lambda e, k: (k != LISTED, len(e), (e + "/").index("/"), e, k)
    return best is None or rank(entry, kind) > rank(*best)


def index(entries: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``shard, of, digests, entries, kinds`` from ``entry, kind``: one row for each of ``of`` shards that has entries,
    which are sorted by their unsigned digest."""
    unique = stored(entries.filter(F.col("entry").isNotNull()).groupBy("entry").agg(F.max("kind").cast("int").alias("kind")))
    shards = -(-max(1, unique.count()) // shard_entries)

    def digests(values: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((xxhash.xxh64_intdigest(v) for v in values), np.uint64, len(values)).view(np.int64))

    digest = F.pandas_udf(digests, T.LongType())
    # Flipping the first bit sorts signed numbers as the unsigned ones they stand for.
    order = F.col("digest").bitwiseXOR(F.lit(-2**63))
    row = F.struct(order.alias("order"), "digest", "entry", "kind")
    return unique.withColumn("digest", digest("entry")).groupBy(F.pmod("digest", F.lit(shards)).cast("int").alias("shard")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")).select(
        "shard", F.lit(shards).alias("of"), F.col("rows.digest").alias("digests"), F.col("rows.entry").alias("entries"),
        F.col("rows.kind").alias("kinds"))


def _array(row) -> DigestArray:
    return DigestArray(np.array(row["digests"], np.int64).view(np.uint64), row["entries"], row["kinds"])


_RESULT = "struct<entry:string,kind:int>"


def judged(urls: DataFrame, entries: DataFrame, host_column: str = "host", path_column: str = "path",
           small_list: int = SMALL_LIST, shard_entries: int = SHARD_ENTRIES, probes_per_task: int = PROBES_PER_TASK,
           out: str = "match") -> DataFrame:
    """``urls`` with struct ``out (entry, kind)``: the entry that decides, null if none fits.

    ``entries (entry, kind)`` are strings of host and path, such as ``example.com/en/``; kind is LISTED, ALLOW or
    BLOCK. An entry fits its host and all subdomains, if the URL's path starts with the entry's. Null entries are left
    out, of equal ones BLOCK wins; an empty list decides nothing. Null hosts and paths count as empty. Repeated URLs are
    judged alike, other columns stay.
    """
    shards = stored(index(entries, shard_entries))
    # Bounded: an entry's path has at most as many lengths as characters.
    lengths = sorted(r[0] for r in shards.select(F.explode("entries").alias("e")).select(
        F.greatest(F.length("e") - F.length(F.substring_index("e", "/", 1)), F.lit(0)).alias("n")).distinct().collect())
    size = shards.agg(F.sum(F.aggregate("entries", F.lit(0).cast("bigint"), lambda acc, e: acc + F.octet_length(e) + 60))).first()[0]
    if (size or 0) <= small_list:
        return _judged_in_place(urls, shards, lengths, host_column, path_column, out)
    return _judged_by_shard(urls, shards, lengths, host_column, path_column, probes_per_task, out)


def _judged_in_place(urls: DataFrame, shards: DataFrame, lengths: list[int], host_column: str, path_column: str,
                     out: str) -> DataFrame:
    rows = [r.asDict() for r in shards.collect()]  # at most SMALL_LIST bytes
    count = rows[0]["of"] if rows else 1
    shared = urls.sparkSession.sparkContext.broadcast({r["shard"]: r for r in rows})

    @F.pandas_udf(_RESULT)
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        arrays = {k: _array(r) for k, r in shared.value.items()}
        for hosts, paths in batches:
            texts = [lookups(h or "", p or "", lengths) for h, p in zip(hosts, paths)]
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            flat = [t for own in texts for t in own]
            best: list[tuple[str, int] | None] = [None] * len(texts)
            shard = np.fromiter((xxhash.xxh64_intdigest(t) for t in flat), np.uint64, len(flat)).view(np.int64) % count
            for k, array in arrays.items():
                here = np.flatnonzero(shard == k) if count > 1 else np.arange(len(flat))
                for i, place in zip(here.tolist(), array.probe([flat[i] for i in here.tolist()]).tolist()):
                    if place >= 0 and _better(array.entries[place], array.kinds[place], best[owner[i]]):
                        best[owner[i]] = (array.entries[place], int(array.kinds[place]))
            yield pd.DataFrame([b or (None, None) for b in best], columns=["entry", "kind"]).astype({"kind": "Int32"})

    matched = urls.withColumn(out, match(F.col(f"`{host_column}`"), F.col(f"`{path_column}`")))
    return matched.withColumn(out, F.when(F.col(out)["entry"].isNotNull(), F.col(out)))


def _judged_by_shard(urls: DataFrame, shards: DataFrame, lengths: list[int], host_column: str, path_column: str,
                     probes_per_task: int, out: str) -> DataFrame:
    """Distinct (host, path) pairs are looked up; the few that match are joined back."""
    count = shards.select("of").first()[0]
    pairs = stored(urls.select(F.coalesce(F.col(f"`{host_column}`"), F.lit("")).alias("h"),
                               F.coalesce(F.col(f"`{path_column}`"), F.lit("")).alias("p")).distinct())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [lookups(h, p, lengths) for h, p in zip(hosts, paths)]
            flat = [t for own in texts for t in own]
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in flat), np.uint64, len(flat)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys % count, pa.int32()), batch.column(0).take(pa.array(owner)),
                batch.column(1).take(pa.array(owner)), pa.array(flat, pa.string())], ["shard", "h", "p", "text"])

    probes = stored(pairs.mapInArrow(cut, "shard int, h string, p string, text string"))
    parts = stored(probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / probes_per_task).cast("int").alias("parts")))
    spread = probes.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    copies = shards.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["h", "p", "entry", "kind"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.string())] * 3 + [pa.array([], pa.int32())], names)
        array = _array(right.to_pylist()[0])
        place = array.probe(left.column("text").to_pylist())
        hit = np.flatnonzero(place >= 0)
        return pa.table([left.column("h").take(hit), left.column("p").take(hit),
                         pa.array([array.entries[i] for i in place[hit]], pa.string()),
                         pa.array([int(array.kinds[i]) for i in place[hit]], pa.int32())], names)

    hits = spread.select("shard", "part", "h", "p", "text").groupBy("shard", "part").cogroup(
        copies.select("shard", "part", "digests", "entries", "kinds").groupBy("shard", "part")).applyInArrow(
        search, "h string, p string, entry string, kind int")
    rank = F.struct((F.col("kind") != LISTED).alias("own"), F.length("entry").alias("n"),
                    F.instr(F.concat("entry", F.lit("/")), "/").alias("host_n"), "entry", "kind")
    best = hits.groupBy("h", "p").agg(F.max(rank).alias("best")).select(
        "h", "p", F.struct("best.entry", "best.kind").alias("hit"))
    found = urls.join(best, same(F.coalesce(F.col(f"`{host_column}`"), F.lit("")), F.col("h"))
                      & same(F.coalesce(F.col(f"`{path_column}`"), F.lit("")), F.col("p")), "left")
    return found.withColumn(out, F.col("hit")).select(*[F.col(f"`{c}`") for c in urls.columns if c != out], out)


def url_table(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, id: str = "page_id",
              url: str = "url", **sizes: int) -> DataFrame:
    """``id, host, path, rule, verdict`` of every URL.

    ``rules`` are (allow or block, entry); the longest that fits decides. Else the verdict is block if an entry of
    ``listed (entry)`` fits, and allow if not. A null URL or one without ``://`` has an empty host and path.
    """
    spark = pages.sparkSession
    own = spark.createDataFrame([(entry, ALLOW if verdict == "allow" else BLOCK) for verdict, entry in rules],
                                "entry string, kind int")
    entries = own.unionByName(listed.select("entry", F.lit(LISTED).alias("kind")))
    parts = pages.select(F.col(id), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    found = judged(parts, entries, **sizes)
    kind = F.col("match.kind")
    return found.select(F.col(id), "host", "path", F.when(kind != LISTED, F.col("match.entry")).alias("rule"),
                        F.when(kind.isNull() | (kind == ALLOW), "allow").otherwise("block").alias("verdict"))
