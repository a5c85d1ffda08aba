"""Mixing sources to target sizes by pivotal dependent rounding, in DataFrame functions only.

Every source has a target size, so each of its documents has a fractional number of copies. The whole part is taken,
the fractions are rounded in dependent pairs: two documents exchange mass, weighed by their sizes, until one fraction
is 0 or 1. The direction is drawn so that each document's expected copies stay, and the exchange keeps the sum of
copies times size, so a source's total moves only by its very last fraction. Pairs are formed inside small blocks; what
a block leaves over, at most one document, goes to a block of the next level of a reduction tree, up to one per source.
A block pairs its documents from the largest down, so what is left over tends to be small. The last document of a source
has no partner; its fraction is rounded to the nearer whole, so a source is off by half that document at most.
A hot source has more blocks, never a larger one. All draws are hashes of the seed and the ids, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.indexing import dense_index
from ..session import stored
from .common import free_name, same, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 64
SEED = 20_260
#: Targets of up to so many sources (about 60 bytes each) are sent to all tasks, beyond that the join shuffles.
SMALL_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row a source, the null source included).

    Sources in code point order, the null source last, have the weights in turn and share ``share`` times the sum of all
    sizes. No target is above ``most`` times its source's size; the excess is shared again by weight. Each round reads
    one row of sums, and at least one more source reaches its limit, until none is above.
    """
    order = dense_index(sizes.filter(F.col("source").isNotNull()), "source", "place")
    named = order.count()
    order = order.select("source", "source_size", "place").unionByName(
        sizes.filter(F.col("source").isNull()).select("source", "source_size", F.lit(named).alias("place")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(order.select("source", "source_size", weight.cast("bigint").alias("weight")))
    level, full = 0.0, -1
    while True:
        above = (F.col("weight") * F.lit(level) > F.col("source_size") * most) if full >= 0 else F.lit(False)
        n, at_limit, rest, total = weighed.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum("source_size"), F.lit(0))).first()
        if n == full or not rest:
            break
        full, level = n, (share * total - most * at_limit) / rest
    limit = F.col("source_size") * float(most)
    target = F.least(F.col("weight") * F.lit(level), limit) if rest else limit
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(2.0**53)


def _paired(items: Column, seed: int, level: int) -> Column:
    """Fold one block: ``rest`` (one document with a fraction, or null) and ``done`` (documents with whole copies)."""
    kind = "struct<id:string,size:bigint,rows:bigint,base:bigint,part:double>"
    done = "array<struct<id:string,size:bigint,rows:bigint,copies:bigint>>"
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(done).alias("done"))

    def settled(x: Column, copies: Column) -> Column:
        return F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"), x["rows"].alias("rows"),
                                copies.alias("copies")))

    def with_part(x: Column, part: Column) -> Column:
        return F.struct(*[x[f].alias(f) for f in ("id", "size", "rows", "base")], part.alias("part"))

    def step(acc: Column, y: Column) -> Column:
        x = acc["rest"]
        # Mass that can go to x (x reaches 1 or y reaches 0), and to y (x reaches 0 or y reaches 1).
        x_room, y_mass = x["size"] * (1 - x["part"]), y["size"] * y["part"]
        x_mass, y_room = x["size"] * x["part"], y["size"] * (1 - y["part"])
        to_x, to_y = F.least(x_room, y_mass), F.least(x_mass, y_room)
        draw = _uniform(F.lit(seed), F.lit(level), x["id"], x["size"], y["id"], y["size"])
        rises = draw * (to_x + to_y) < to_y
        # Which of the two becomes whole, and with how many copies.
        x_whole = F.when(rises, x_room <= y_mass).otherwise(x_mass <= y_room)
        x_copies, y_copies = x["base"] + rises.cast("bigint"), y["base"] + (~rises).cast("bigint")
        x_part = F.when(rises, x["part"] + y_mass / x["size"]).otherwise(x["part"] - y_room / x["size"])
        y_part = F.when(rises, y["part"] - x_room / y["size"]).otherwise(y["part"] + x_mass / y["size"])
        bounded = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return F.when(x.isNull(), F.struct(y.alias("rest"), acc["done"].alias("done"))).otherwise(F.struct(
            F.when(x_whole, with_part(y, bounded(y_part))).otherwise(with_part(x, bounded(x_part))).alias("rest"),
            F.concat(acc["done"], F.when(x_whole, settled(x, x_copies)).otherwise(settled(y, y_copies))).alias("done")))

    return F.aggregate(items, start, step)


def copies(items: DataFrame, goals: DataFrame, most: float = MOST_COPIES, seed: int = SEED,
           block: int = BLOCK) -> DataFrame:
    """``source, source_size, target, id, size, rows, copies`` for ``items (source, id, size, rows)`` with unique keys.

    ``rows`` documents are alike; ``copies`` is the number taken of them together, at most ``most`` times ``rows``.
    """
    names = {c: "goal_" + c for c in ("source", "source_size", "target")}
    goals = goals.select(*[F.col(c).alias(n) for c, n in names.items()])
    if goals.count() <= SMALL_SOURCES:
        goals = F.broadcast(goals)
    matched = items.join(goals, same(F.col("source"), F.col("goal_source"))).drop("goal_source")
    # A source of size 0 has nothing to take.
    each = F.when(F.col("goal_source_size") > 0, F.col("goal_target") / F.col("goal_source_size")).otherwise(F.lit(0.0))
    wanted = F.when(F.col("size") > 0, F.least(each, F.lit(float(most))) * F.col("rows")).otherwise(F.lit(0.0))
    matched = stored(matched.withColumn("wanted", wanted).select(
        *items.columns, "goal_source_size", "goal_target", F.floor("wanted").cast("bigint").alias("base"),
        (F.col("wanted") - F.floor("wanted")).alias("part")))
    fixed = ["source", "goal_source_size", "goal_target"]
    out = [matched.filter(F.col("part") == 0).select(*fixed, "id", "size", "rows", F.col("base").alias("copies"))]
    open_ = matched.filter(F.col("part") > 0)
    in_source = open_.groupBy(*fixed).agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("bigint")
    sizes = stored(in_source.select(F.col("source").alias("of"), blocks.alias("blocks")))
    largest = sizes.agg(F.max("blocks")).first()[0] or 0
    sides = F.broadcast(sizes) if sizes.count() <= SMALL_SOURCES else sizes
    entry = F.struct("id", "size", "rows", "base", "part")
    place = F.xxhash64(F.lit(seed), "id", "size")
    pending = open_.join(sides, same(F.col("source"), F.col("of"))).select(
        *fixed, F.pmod(place, F.col("blocks")).alias("block"), F.struct((-F.col("size")).alias("order"), place.alias("tie"), entry.alias("item")).alias("x"))
    level = 0
    while largest > 0:
        gathered = pending.groupBy(*fixed, "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        folded = stored(gathered.select(*fixed, "block", _paired(F.transform("xs", lambda x: x["item"]), seed, level).alias("r")))
        out.append(folded.select(*fixed, F.explode("r.done").alias("d")).select(*fixed, "d.*"))
        rest = folded.filter(F.col("r.rest").isNotNull()).select(*fixed, "block", F.col("r.rest").alias("item"))
        if largest == 1:
            up = F.col("item.part") >= 0.5
            out.append(rest.select(*fixed, "item.id", "item.size", "item.rows",
                                   (F.col("item.base") + up.cast("bigint")).alias("copies")))
            break
        largest, level = math.ceil(largest / block), level + 1
        pending = rest.select(*fixed, F.expr(f"block div {block}").alias("block"), F.struct(
            (-F.col("item.size")).alias("order"),
            F.xxhash64(F.lit(seed), F.lit(level), "item.id", "item.size").alias("tie"), "item").alias("x"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result.select("source", F.col("goal_source_size").alias("source_size"), F.col("goal_target").alias("target"),
                         "id", "size", "rows", "copies")


def _items(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """Documents that agree in source, id and size, once, with their number; ids as text to be of one type."""
    return stored(docs.select(F.col(source).alias("source"), F.col(id).cast("string").alias("id"),
                              word_count(F.col(text)).alias("size")).groupBy("source", "id", "size").agg(
        F.count(F.lit(1)).alias("rows")))


def _mixed(docs: DataFrame, id: str, text: str, source: str, weights: tuple[int, ...], share: float, most: float,
           seed: int, block: int) -> DataFrame:
    items = _items(docs, id, text, source)
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    return copies(items, targets(sizes, weights, share, most), most, seed, block)


def mix_table(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
              weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED,
              block: int = BLOCK) -> DataFrame:
    """``id, source, size, source_size, target, copies, taken`` of every row; size in words, taken = copies * size.

    Null and empty texts have size 0 and are taken 0 times. The null source is a source, a null id an id. Rows that agree
    in id, source and size share their copies as evenly as whole numbers allow. An empty table gives an empty result,
    other columns are ignored.
    """
    mixed = _mixed(docs, id, text, source, weights, share, most, seed, block)
    rows = mixed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("nth"))
    own = F.floor((F.col("copies") + F.col("nth")) / F.col("rows")).cast("bigint")
    return rows.select(F.col("id").cast(docs.schema[id].dataType).alias(id), F.col("source").alias(source), "size",
                       "source_size", "target", own.alias("copies"), (own * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED,
                  block: int = BLOCK) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in its own columns."""
    mixed = _mixed(docs, id, text, source, weights, share, most, seed, block)
    names = {c: free_name(docs, "mix_" + c) for c in ("source", "id", "size", "rows", "copies", "nth", "own")}
    mixed = mixed.filter(F.col("copies") > 0).select(*[
        F.col(c).alias(names[c]) for c in ("source", "id", "size", "rows", "copies")])
    of = lambda c: F.col(names[c])
    own_size = free_name(docs, "own_size")
    joined = docs.withColumn(own_size, word_count(F.col(f"`{text}`"))).join(
        mixed, same(F.col(f"`{id}`").cast("string"), of("id")) & same(F.col(f"`{source}`"), of("source"))
        & (F.col(own_size) == of("size")))
    # Only rows that agree in id, source and size need numbers; they are together already, for the join.
    nth = F.expr(f"row_number() over (partition by `{names['id']}`, `{names['source']}`, `{names['size']}` order by "
                 f"`{names['rows']}`)") - 1
    own = F.floor((of("copies") + of("nth")) / of("rows")).cast("int")
    return joined.withColumn(names["nth"], nth).withColumn(names["own"], own).filter(of("own") > 0).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.explode(F.sequence(F.lit(1), of("own"))).alias(names["own"])).drop(names["own"])
