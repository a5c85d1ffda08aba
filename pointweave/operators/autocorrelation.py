"""Spatial autocorrelation of polygon values: local G, local and global Moran's I, permutation inference."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import as_double, one_row, require_columns
from ..functions.special import normal_p
from ..session import stored
from .contiguity import neighbours, row_standardised
from .indexing import dense_index

PERMUTATIONS = 999
# Values held by every permutation task up to this many (8 bytes each); beyond, the same draws are joined instead.
BROADCAST_VALUES = 1_000_000
# Drawn numbers that a task holds at a time.
DRAWS_PER_BATCH = 500_000
# Modulus and rounds of the keyed permutations; 5 is no divisor of PRIME - 1.
PRIME, ROUNDS = 2**31 - 1, 6
# Sums that differ by less than this share of their scale are ties.
TIE = 1e-12
# Two-sided z thresholds with the p-value each must also pass.
HOT_LEVELS = {"hotspot_90": (1.645, 0.10), "hotspot_95": (1.960, 0.05), "hotspot_99": (2.576, 0.01)}
COLD_LEVELS = {"coldspot_95": (-1.960, 0.05)}
# Columns of a polygon table that are no offense counts.
NOT_OFFENSES = ("GEOID", "STATEFP", "population", "risk_score")


# Permutation inference -------------------------------------------------------------------------------------------


def _folded(larger: Column, permutations: int) -> Column:
    return (F.least(larger, F.lit(permutations) - larger) + 1) / F.lit(permutations + 1.0)


def _mixed(x):
    """The fifth power modulo the prime: a bijection that also SQL can state, of integers or integer arrays."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def _keys(seed: int, slot: int, runs):
    """One key of the permutations below for each run of a slot."""
    return _mixed((_mixed((_mixed(seed % PRIME) + slot) % PRIME) + runs) % PRIME)


def _permuted(place: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where the keyed permutation of 0 to n - 1 puts each place.

    A Feistel network over two digits of nearly equal base covers a little more than n numbers; results beyond n go
    through it again until they are below n, which keeps it a bijection.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)
    place, key = (np.array(v, "int64").ravel() for v in np.broadcast_arrays(place, key))
    out, todo = place, np.arange(len(place))
    while len(todo):
        left, right = np.divmod(out[todo], b)
        for i in range(ROUNDS):
            turn = _mixed((key[todo] + i + 1) % PRIME)
            if i % 2:
                right = (right + _mixed((left + turn) % PRIME)) % b
            else:
                left = (left + _mixed((right + turn) % PRIME)) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out


def _neighbour_draws(slot: int, k: int, n: int, permutations: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches ``(runs, slots)`` of bounded size: in each run k different slots, never the unit's own."""
    k = min(k, n - 1)
    step = max(1, DRAWS_PER_BATCH // max(k, 1))
    for first in range(1, permutations + 1, step):
        runs = np.arange(first, min(first + step, permutations + 1))
        picks = _permuted(np.arange(k)[None, :], n - 1, _keys(seed, slot, runs)[:, None]).reshape(len(runs), k)
        yield runs, picks + (picks >= slot)


def conditional_p(units: DataFrame, observed: str, degree: str, value: str, id: str,
                  permutations: int = PERMUTATIONS, seed: int = 42, sign: str | None = None) -> DataFrame:
    """Pseudo p-value per unit: its value stays, its neighbours' values are drawn from the other units.

    ``observed`` is the mean of the neighbours' values; ``sign`` names a column whose sign flips the comparison.
    Draws are a keyed permutation of the units' numbers in id order, so they depend on nothing but ids and seed. Up to
    BROADCAST_VALUES units every task holds the values; beyond, the same draws look them up in a join.
    """
    table = units.select(F.col(id).alias("unit"), F.col(value).cast("double").alias("x"),
                         F.col(observed).cast("double").alias("observed"),
                         F.coalesce(F.col(degree), F.lit(0)).cast("bigint").alias("k"),
                         (F.signum(F.col(sign)) if sign else F.lit(1.0)).cast("double").alias("sign"))
    slots = dense_index(table, "unit", "slot")
    size = slots.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("x")).alias("top")).first()
    n, slack = size["n"], TIE * (size["top"] or 0.0)
    if n <= BROADCAST_VALUES:
        values = slots.select("slot", "x").toPandas().sort_values("slot")["x"].to_numpy()

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                larger = np.zeros(len(batch), "int64")
                for j, r in enumerate(batch.itertuples(index=False)):
                    for _, picks in _neighbour_draws(r.slot, r.k, n, permutations, seed) if min(r.k, n - 1) else ():
                        larger[j] += (values[picks].mean(axis=1) * r.sign >= r.observed * r.sign - slack).sum()
                yield pd.DataFrame({"unit": batch["unit"], "larger": larger})

        schema = T.StructType([table.schema["unit"], T.StructField("larger", T.LongType())])
        counted = slots.mapInPandas(draw, schema)
    else:
        counted = _joined_draws(slots, n, slack, permutations, seed)
    return counted.select(F.col("unit").alias(id), _folded(F.col("larger"), permutations).alias("p_sim"))


def _joined_draws(slots: DataFrame, n: int, slack: float, permutations: int, seed: int) -> DataFrame:
    """The same draws when the values do not fit a task: each is a row that looks its value up."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch[batch["k"] > 0].itertuples(index=False):
                for runs, picks in _neighbour_draws(r.slot, r.k, n, permutations, seed):
                    yield pd.DataFrame({"own": r.slot, "run": np.repeat(runs, picks.shape[1]), "slot": picks.ravel()})

    drawn = slots.select("slot", "k").mapInPandas(draw, "own bigint, run bigint, slot bigint")
    means = drawn.join(slots.select("slot", "x"), "slot").groupBy("own", "run").agg(F.avg("x").alias("mean"))
    compared = means.join(slots.select(F.col("slot").alias("own"), "observed", "sign"), "own")
    larger = compared.groupBy(F.col("own").alias("slot")).agg(F.count_if(
        F.col("mean") * F.col("sign") >= F.col("observed") * F.col("sign") - slack).alias("larger"))
    return slots.select("slot", "unit").join(larger, "slot", "left").fillna(0, ["larger"])


# Local G ---------------------------------------------------------------------------------------------------------


def local_g(units: DataFrame, edges: DataFrame, value: str = "offense_count", id: str = "GEOID",
            star: bool = True) -> DataFrame:
    """Standardised local G per unit with row-standardised weights: ``id, gi_z_score, lag, degree``.

    ``star`` includes the unit itself among its neighbours; otherwise mean and deviation leave the unit out.
    """
    x = F.col(value).cast("double")
    t = one_row(units, n=F.count(F.lit(1)), total=F.sum(x), sq=F.sum(x * x))
    own = units.select(F.col(id).alias("dst"), x.alias("x"))
    around = edges.join(own, "dst").groupBy("src").agg(F.sum("x").alias("around"), F.count(F.lit(1)).alias("degree"))
    table = units.select(id, x.alias("x")).join(around.withColumnRenamed("src", id), id, "left").fillna(
        0, ["around", "degree"])
    degree, xi = F.col("degree"), F.col("x")
    lag = F.try_divide(F.col("around"), degree)
    if star:
        k, n = degree + 1, t["n"].cast("double")
        mean, weighted = t["total"] / n, (F.col("around") + xi) / k
        variance = t["sq"] / n - mean * mean
        spread = (n / k - 1) / (n - 1)
    else:
        k, n = degree, t["n"].cast("double") - 1
        mean, weighted = (t["total"] - xi) / n, lag
        variance = (t["sq"] - xi * xi) / n - mean * mean
        spread = (F.try_divide(n, k) - 1) / (n - 1)
    z = F.try_divide(weighted - mean, F.sqrt(F.greatest(variance * spread, F.lit(0.0))))
    return table.select(id, z.alias("gi_z_score"), F.coalesce(lag, F.lit(0.0)).alias("lag"), "degree")


def getis_ord(units: DataFrame, value: str = "offense_count", id: str = "GEOID", significance: float = 0.05,
              kind: str = "queen", star: bool = True, p_method: str = "permutation",
              permutations: int = PERMUTATIONS, seed: int = 42, edges: DataFrame | None = None) -> DataFrame:
    """Units with z score, p-value, hot and cold spot flags; a flag needs both its z and its p threshold.

    ``p_method`` is ``permutation`` (seeded conditional draws) or ``normal`` (two-sided, deterministic).
    """
    require_columns(units, [value, id])
    edges = neighbours(units, kind, id) if edges is None else edges
    scored = units.join(local_g(units, edges, value, id, star), id)
    if p_method == "normal":
        scored = scored.withColumn("gi_p_value", normal_p("gi_z_score"))
    elif p_method == "permutation":
        p = conditional_p(scored, "lag", "degree", value, id, permutations, seed)
        scored = scored.join(p.withColumnRenamed("p_sim", "gi_p_value"), id)
    else:
        raise ValueError(f"unknown p_method {p_method!r}")
    z, p = F.col("gi_z_score"), F.col("gi_p_value")
    flags = {name: (z > bar) & (p < level) for name, (bar, level) in HOT_LEVELS.items()}
    flags |= {name: (z < bar) & (p < level) for name, (bar, level) in COLD_LEVELS.items()}
    flags["significant"] = p < significance
    return scored.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}).drop("lag", "degree")


def getis_ord_summary(result: DataFrame) -> DataFrame:
    return result.agg(F.count(F.lit(1)).alias("n_polygons"), F.count_if("hotspot_95").alias("n_hotspots_95"),
                      F.count_if("coldspot_95").alias("n_coldspots_95"), F.max("gi_z_score").alias("max_z"),
                      F.min("gi_z_score").alias("min_z"))


def spot_class(df: DataFrame) -> DataFrame:
    """First class that applies, hottest first."""
    label = (F.when(F.col("hotspot_99"), "Hot Spot 99%").when(F.col("hotspot_95"), "Hot Spot 95%")
             .when(F.col("hotspot_90"), "Hot Spot 90%").when(F.col("coldspot_95"), "Cold Spot 95%")
             .otherwise("Not Significant"))
    return df.withColumn("spot_class", label)


# Moran's I -------------------------------------------------------------------------------------------------------


def local_moran(units: DataFrame, value: str = "offense_count", id: str = "GEOID", kind: str = "queen",
                p_method: str = "permutation", permutations: int = PERMUTATIONS, seed: int = 42,
                edges: DataFrame | None = None) -> DataFrame:
    """Units with local Moran's I, its p-value and the quadrant label (HH, LH, LL, HL or Not Significant)."""
    require_columns(units, [value, id])
    edges = neighbours(units, kind, id) if edges is None else edges
    x = F.col(value).cast("double")
    t = one_row(units, n=F.count(F.lit(1)), mean=F.avg(x), var=F.var_pop(x))
    deviations = units.select(F.col(id).alias("dst"), (x - t["mean"]).alias("z"))
    lags = edges.join(deviations, "dst").groupBy(F.col("src").alias(id)).agg(
        F.avg("z").alias("lag"), F.count(F.lit(1)).alias("degree"))
    table = units.join(lags, id, "left").fillna(0.0, ["lag"]).fillna(0, ["degree"]).withColumn("z", x - t["mean"])
    n = t["n"].cast("double")
    table = table.withColumn("lisa_I", F.try_divide((n - 1) * F.col("z") * F.col("lag"), n * t["var"]))
    if p_method == "permutation":
        p = conditional_p(table, "lag", "degree", "z", id, permutations, seed, sign="z")
        table = table.join(p.withColumnRenamed("p_sim", "lisa_p"), id)
    elif p_method == "normal":
        # Lag of k draws without replacement from the other deviations, whose mean is -z / (n - 1).
        centre = -F.col("z") / (n - 1)
        variance = (n * t["var"] - F.col("z") * F.col("z")) / (n - 1) - centre * centre
        spread = variance * F.try_divide(n - 1 - F.col("degree"), F.col("degree") * (n - 2))
        score = F.try_divide(F.col("lag") - centre, F.sqrt(F.greatest(spread, F.lit(0.0))))
        table = table.withColumn("lisa_p", F.coalesce(normal_p(score), F.lit(1.0)))
    else:
        raise ValueError(f"unknown p_method {p_method!r}")
    significant = F.col("lisa_p") < 0.05
    return table.withColumn("lisa_sig", significant).withColumn(
        "lisa_quadrant", F.when(~significant, "Not Significant").otherwise(quadrant(F.col("z"), F.col("lag")))
    ).withColumnRenamed("lag", "lisa_lag").drop("z", "degree")


def quadrant(z: Column, lag: Column) -> Column:
    return (F.when((z > 0) & (lag > 0), "HH").when((z <= 0) & (lag > 0), "LH")
            .when((z <= 0) & (lag <= 0), "LL").otherwise("HL"))


def _moran_from_sums(sums: DataFrame) -> DataFrame:
    """Moran's I with its expectation, variance under normality, z and p from the sums of one or more variables."""
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    i = F.try_divide(n * F.col("cross"), s0 * F.col("zz"))
    expected = -1 / (n - 1)
    variance = F.try_divide(n * n * s1 - n * s2 + 3 * s0 * s0, (n * n - 1) * s0 * s0) - expected * expected
    table = sums.withColumns({"I": i, "expected": expected, "variance": variance})
    table = table.withColumn("z_score", F.try_divide(F.col("I") - F.col("expected"), F.sqrt("variance")))
    table = table.withColumn("p_value", normal_p("z_score"))
    return table.withColumn("is_clustered", (F.col("p_value") < 0.05) & (F.col("I") > F.col("expected")))


def _graph_sums(edges: DataFrame) -> Column:
    """S0, S1, S2 of the row-standardised graph."""
    forward = row_standardised(edges)
    back = edges.groupBy(F.col("src").alias("dst")).agg((1 / F.count(F.lit(1))).alias("w_back"))
    both = forward.join(back, "dst")
    per_unit = both.groupBy("src").agg(F.sum("w").alias("row"), F.sum("w_back").alias("column"),
                                       F.sum((F.col("w") + F.col("w_back")) ** 2).alias("pair"))
    return one_row(per_unit, s0=F.sum("row"), s1=F.sum("pair") / 2, s2=F.sum((F.col("row") + F.col("column")) ** 2))


def _moran_by_variable(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Sums for every variable of a long table ``unit, variable, x`` in one pass over the graph."""
    stats = long.groupBy("variable").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mean"),
                                         (F.var_pop("x") * F.count(F.lit(1))).alias("zz"))
    centred = long.join(F.broadcast(stats.select("variable", "mean")), "variable").select(
        "unit", "variable", (F.col("x") - F.col("mean")).alias("z"))
    lagged = (row_standardised(edges).join(centred.withColumnsRenamed({"unit": "dst", "z": "z_dst"}), "dst")
              .groupBy("src", "variable").agg(F.sum(F.col("w") * F.col("z_dst")).alias("lag")))
    cross = (centred.join(lagged.withColumnRenamed("src", "unit"), ["unit", "variable"])
             .groupBy("variable").agg(F.sum(F.col("z") * F.col("lag")).alias("cross")))
    g = _graph_sums(edges)
    return stats.join(cross, "variable").withColumns({c: g[c] for c in ("s0", "s1", "s2")})


def global_moran(units: DataFrame, value: str = "offense_count", id: str = "GEOID", kind: str = "queen",
                 edges: DataFrame | None = None) -> DataFrame:
    """One row: ``I, expected, variance, z_score, p_value, is_clustered``."""
    require_columns(units, [value, id])
    edges = neighbours(units, kind, id) if edges is None else edges
    # Unpivoted rather than tagged with a literal: joins on a literal would turn into products.
    long = units.select(F.col(id).alias("unit"), F.col(value).cast("double").alias("value")).unpivot(
        ["unit"], ["value"], "variable", "x")
    return _moran_from_sums(_moran_by_variable(long, edges)).select(
        "I", "expected", "variance", "z_score", "p_value", "is_clustered")


def global_moran_permutation_p(units: DataFrame, value: str = "offense_count", id: str = "GEOID",
                               edges: DataFrame | None = None, permutations: int = PERMUTATIONS,
                               seed: int = 42) -> DataFrame:
    """One row ``I, p_sim`` from random relabelings of all units.

    A relabeling is a keyed permutation of the units' numbers in id order. Up to BROADCAST_VALUES units and edges every
    task holds the graph and does some of the relabelings; beyond, the same ones are looked up by joins.
    """
    edges = stored(neighbours(units, "queen", id) if edges is None else edges)
    moran = global_moran(units, value, id, edges=edges)
    indexed = dense_index(units.select(F.col(id).alias("unit"), F.col(value).cast("double").alias("x")), "unit", "slot")
    t = one_row(indexed, mean=F.avg("x"))
    slots = stored(indexed.select("unit", "slot", (F.col("x") - t["mean"]).alias("z")))
    end = lambda unit, name: slots.select(F.col("unit").alias(unit), F.col("slot").alias(name))
    linked = stored(row_standardised(edges).join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b", "w"))
    n, slack = slots.agg(F.count(F.lit(1)), TIE * F.sum(F.col("z") * F.col("z"))).first()
    slack = slack or 0.0
    if max(n, linked.count()) > BROADCAST_VALUES:
        larger = _joined_relabelings(slots, linked, n, slack, permutations, seed)
        return moran.select("I", _folded(larger.scalar(), permutations).alias("p_sim"))
    z = slots.select("slot", "z").toPandas().sort_values("slot")["z"].to_numpy()
    graph = linked.toPandas()
    a, b, w = (graph[c].to_numpy() for c in ("a", "b", "w"))
    observed = (w * z[a] * z[b]).sum()

    def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = 0
            for run in batch["id"]:
                mixed = z[_permuted(np.arange(n), n, _keys(seed, n, int(run)))]
                hits += int((w * mixed[a] * mixed[b]).sum() >= observed - slack)
            yield pd.DataFrame({"larger": [hits]})

    larger = units.sparkSession.range(1, permutations + 1).mapInPandas(relabel, "larger bigint").agg(
        F.sum("larger").alias("larger")).scalar()
    return moran.select("I", _folded(larger, permutations).alias("p_sim"))


def _joined_relabelings(slots: DataFrame, linked: DataFrame, n: int, slack: float, permutations: int,
                        seed: int) -> DataFrame:
    """``larger`` of all relabelings for a graph beyond one task. Each unit gets the array of its values, the observed
    one first; the products of an edge are summed per run before anything is shuffled."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = np.arange(1, permutations + 1)
        for batch in batches:
            for some in np.array_split(batch["slot"].to_numpy(), max(1, len(batch) * permutations // DRAWS_PER_BATCH)):
                found = _permuted(some[:, None], n, _keys(seed, n, runs)[None, :]).reshape(len(some), permutations)
                found = np.concatenate([some[:, None], found], axis=1)
                yield pd.DataFrame({"own": np.repeat(some, permutations + 1), "run": np.tile(np.arange(permutations + 1), len(some)),
                                    "slot": found.ravel()})

    placed = slots.select("slot").mapInPandas(place, "own bigint, run bigint, slot bigint")
    # One entry per run in each list.
    entries = F.array_sort(F.collect_list(F.struct("run", "z")))
    values = stored(placed.join(slots.select("slot", "z"), "slot").groupBy("own").agg(entries["z"].alias("zs")))
    both = linked.join(values.withColumnsRenamed({"own": "a", "zs": "za"}), "a").join(
        values.withColumnsRenamed({"own": "b", "zs": "zb"}), "b")
    products = both.select(F.posexplode(F.zip_with("za", "zb", lambda p, q: p * q * F.col("w"))).alias("run", "product"))
    sums = stored(products.groupBy("run").agg(F.sum("product").alias("total")))
    observed = sums.filter("run = 0").select("total").scalar()
    return sums.filter("run > 0").agg(F.count_if(F.col("total") >= observed - slack).alias("larger"))


def lisa(units: DataFrame, value: str = "offense_count", id: str = "GEOID", permutations: int = PERMUTATIONS,
         seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Local table and the one-row global ``I, p_sim``, both by permutation."""
    edges = neighbours(units, "queen", id)
    return (local_moran(units, value, id, permutations=permutations, seed=seed, edges=edges),
            global_moran_permutation_p(units, value, id, edges, permutations, seed))


def moran_by_type(units: DataFrame, types: Sequence[str] | None = None, id: str = "GEOID", kind: str = "queen",
                  edges: DataFrame | None = None) -> DataFrame:
    """Global Moran's I of every offense column in one job, highest first; constant columns are left out."""
    if types is None:
        types = [f.name for f in units.schema if isinstance(f.dataType, T.NumericType)
                 and f.name not in NOT_OFFENSES and f.name != id]
    types = [c for c in types if c in units.columns]
    edges = neighbours(units, kind, id) if edges is None else edges
    wide = units.select(F.col(id).alias("unit"), *[F.coalesce(as_double(F.col(c)), F.lit(0.0)).alias(c) for c in types])
    long = wide.unpivot(["unit"], list(types), "variable", "x")
    table = _moran_from_sums(_moran_by_variable(long, edges).filter(F.col("zz") > 0))
    return table.select(F.col("variable").alias("crime_type"), F.bround("I", 4).alias("morans_I"),
                        F.bround("p_value", 4).alias("p_value"), F.col("is_clustered").alias("clustered")
                        ).orderBy(F.desc("morans_I"), "crime_type")
