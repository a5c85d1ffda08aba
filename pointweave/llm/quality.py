"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document has integer measures. A quantile sketch per language, source and measure counts values in buckets that
keep the six leading binary digits of a value, so a quantile is off by at most 1/32 of itself. Sketches are plain
(bucket, count) rows: they merge by adding counts, across tasks, and from sources up to languages and to all documents.
A group's thresholds come from the quartiles of its own sketch; a group with few documents uses its language's sketch,
then that of all documents. The thresholds are joined to the documents, which are then filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .common import SPACE_CHARACTERS, free_name, same, words

SYMBOLS = "#*$%&|<>"
#: Smallest spread between the quartiles that is believed, per measure (units below).
LEAST_SPREAD = {"symbols": 15, "word_length": 40, "repeated_lines": 150}
FENCE = 3
LEAST_DOCS = 100
#: Thresholds for up to so many groups (about 100 bytes each) are sent to all tasks, beyond that the join shuffles.
SMALL_GROUPS = 100_000
MIN_WORDS = 10
#: Fewest words over which a mean word length says something.
MEAN_WORDS = 20
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def _repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more: the length of the union of their intervals.

    Almost all documents have no such window, which one pass over a hash set tells. Else the windows are sorted by hash,
    equal neighbours give the positions, and each position adds what the one before it doesn't cover.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    several = F.size(hashes) - 1
    twins = F.zip_with(F.slice(ordered, F.lit(1), several), F.slice(ordered, F.lit(2), several), lambda a, b: F.when(
        a["h"] == b["h"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")))
    at = F.sort_array(F.array_distinct(F.flatten(twins)))
    start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(at, start, lambda acc, p: F.struct(
        (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"), p.alias("last")), lambda acc: acc["total"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("bigint")


def _pairwise(a: Column, b: Column, ahead: int) -> Column:
    """Hash of each element of ``a`` with the element of ``b`` that is ``ahead`` places on."""
    rest = F.slice(b, F.lit(ahead + 1), F.greatest(F.size(b) - ahead, F.lit(0)))
    return F.zip_with(a, rest, lambda x, y: F.xxhash64(x, y))


def with_counts(docs: DataFrame, text: str, out: str, windows_too: bool = True) -> DataFrame:
    """Add struct ``out``: n_words, word_chars, n_symbols, n_lines, n_dup_lines and, if asked for, n_repeat_words.

    All are BIGINT and count over the whole text. A null or empty text has zero of everything. A window's hash is built
    from its words' hashes in three steps (1 + 1, 2 + 2, 4 + 1 words), each an array made from the one before.
    """
    name = {k: free_name(docs, k) for k in ("word_array", "line_array", "h1", "h2", "h4", "h5")}
    col = lambda k: F.col(name[k])
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumns({
        name["word_array"]: words(F.col(text)),
        name["line_array"]: F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARACTERS)) != "")})
    counts = [
        F.size(col("word_array")).cast("bigint").alias("n_words"),
        F.length(F.array_join(col("word_array"), "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        F.size(col("line_array")).cast("bigint").alias("n_lines"),
        (F.size(col("line_array")) - F.size(F.array_distinct(col("line_array")))).cast("bigint").alias("n_dup_lines")]
    if windows_too:
        split = split.withColumn(name["h1"], F.transform(col("word_array"), lambda w: F.xxhash64(w)))
        split = split.withColumn(name["h2"], _pairwise(col("h1"), col("h1"), 1))
        split = split.withColumn(name["h4"], _pairwise(col("h2"), col("h2"), 2))
        whole = F.greatest(F.size(col("h1")) - (WINDOW - 1), F.lit(0))
        split = split.withColumn(name["h5"], F.slice(_pairwise(col("h4"), col("h1"), 4), F.lit(1), whole))
        counts.append(_repeat_words(col("h5")).alias("n_repeat_words"))
    # The explode of one element keeps a filter on the counts from being moved below them, where all would be worked out
    # again for each place that uses them.
    return split.withColumn(out, F.explode(F.array(F.struct(*counts)))).drop(*name.values())


def measures(counts: Column) -> dict[str, Column]:
    """Symbols per 1000 words, word length in hundredths, repeated lines per 1000 lines; null where there are too few
    words for a mean or no words at all."""
    n = F.nullif(counts["n_words"], F.lit(0))
    return {"symbols": F.floor(counts["n_symbols"] * 1000 / n),
            "word_length": F.when(n >= MEAN_WORDS, F.floor(counts["word_chars"] * 100 / n)),
            "repeated_lines": F.floor(counts["n_dup_lines"] * 1000 / F.nullif(counts["n_lines"], F.lit(0)))}


def bucket(value: Column) -> Column:
    """Lowest value of the sketch bucket: the six leading binary digits of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return value - F.pmod(value, F.pow(F.lit(2.0), shift).cast("bigint"))


def sketches(docs: DataFrame, counts: str, lang: str, source: str) -> DataFrame:
    """``lang, source, measure, bucket, docs``: the quantile sketches of all groups."""
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("bigint").alias("value"))
                     for k, v in measures(F.col(counts)).items()])
    return docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(rows).alias("m")).filter(
        F.col("m.value").isNotNull()).groupBy("lang", "source", F.col("m.measure").alias("measure"),
                                              bucket(F.col("m.value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("docs"))


def _fences(sketch: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Quartile fences of each group, one row a group. A window holds one group's buckets: below 2,000 rows."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("docs").alias("docs"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({
        "total": F.sum("docs").over(group),
        "below": F.sum("docs").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    quartile = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("total") * q, F.col("bucket")))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.coalesce(*[
        F.when(F.col("measure") == k, F.lit(v)) for k, v in LEAST_SPREAD.items()])) * FENCE
    fences = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), quartile(1).alias("q1"),
                                                  quartile(3).alias("q3")).select(
        *keys, "measure", "docs", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    pick = lambda k, c: F.max(F.when(F.col("measure") == k, F.struct("docs", "low", "high")))[c]
    return fences.groupBy(*keys).agg(
        F.max("docs").alias(f"docs{suffix}"),
        *[pick(k, c).alias(f"{k}_{c}{suffix}") for k in LEAST_SPREAD for c in ("low", "high")])


def thresholds(docs: DataFrame, counts: str, lang: str = "lang", source: str = "source",
               least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source`` and the low and high fence of every measure, from the finest sketch with enough documents."""
    sketch = stored(sketches(docs, counts, lang, source))
    everything = F.lit(0).alias("everything")
    own = _fences(sketch, ["lang", "source"], "").withColumn("everything", F.lit(0))
    by_lang = _fences(sketch, ["lang"], "_lang").withColumnRenamed("lang", "of_lang")
    overall = _fences(sketch.select("*", everything), ["everything"], "_all")
    joined = own.join(by_lang, same(F.col("lang"), F.col("of_lang")), "left").join(overall, "everything")
    chosen = lambda name: F.when(F.col("docs") >= least_docs, F.col(name)).when(
        F.col("docs_lang") >= least_docs, F.col(name + "_lang")).otherwise(F.col(name + "_all"))
    return stored(joined.select("lang", "source", *[
        chosen(f"{k}_{c}").alias(f"{k}_{c}") for k in LEAST_SPREAD for c in ("low", "high")]))


def _verdicts(counted: DataFrame, limits: DataFrame, out: str, lang: str, source: str) -> DataFrame:
    """Join the thresholds to the documents and add base_failed and kept to struct ``out``."""
    names = {c: free_name(counted, "limit_" + c) for c in limits.columns}
    limits = limits.select(*[F.col(c).alias(n) for c, n in names.items()])
    if limits.count() <= SMALL_GROUPS:
        limits = F.broadcast(limits)
    at = lambda c: F.col(names[c])
    joined = counted.join(limits, same(F.col(lang), at("lang")) & same(F.col(source), at("source")), "left")
    counts = F.col(out)
    failed = (counts["n_words"] < MIN_WORDS) | (counts["n_repeat_words"] * 100 > counts["n_words"] * MAX_REPEAT_PERCENT)
    inside = F.lit(True)
    for k, v in measures(counts).items():
        inside = inside & F.coalesce(v.between(at(f"{k}_low"), at(f"{k}_high")), F.lit(True))
    return joined.withColumn(out, counts.withField("base_failed", failed).withField("kept", ~failed & inside)).drop(
        *names.values())


def quality_table(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                  least_docs: int = LEAST_DOCS) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept`` of every row.

    ``base_failed``: fewer than 10 words, or more than 20 % of them in repeated 5-word windows. ``kept``: not
    base_failed, and every measure within the fences of the document's language and source. Null languages and sources
    are groups of their own, null and empty texts fail, repeated rows are judged alike, an empty table gives an empty
    result and other columns are ignored. Texts are read once; the small table of counts serves both steps.
    """
    needed = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                         F.col(source).alias("source"))
    counted = stored(with_counts(needed, "text", "counts").drop("text"))
    limits = thresholds(counted, "counts", least_docs=least_docs)
    return _verdicts(counted, limits, "counts", "lang", "source").select(F.col("id").alias(id), "counts.*")


def keep_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                   least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Texts stay where they are: they are read once for the
    sketches and once for the verdicts, and only the thresholds move."""
    out = free_name(docs, "judgement")
    limits = thresholds(with_counts(docs, text, out, windows_too=False), out, lang, source, least_docs)
    return _verdicts(with_counts(docs, text, out), limits, out, lang, source).filter(F.col(out)["kept"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
