import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import quality, topk, urls
from pointweave.llm.queries import URL_RULES
from .conftest import SMALL


def brute_top(rows, k, is_query):
    sound = [(i, np.floor(256 * np.array(v, float)).astype(int).tolist()) for i, v in rows if i is not None and v is not None
             and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if is_query(i)}):
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, own in sound if j == q
                        for i, v in sound if i != q and len(v) == len(own))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(32_768, 16_384), (60, 3)])
def test_top_k_matches_brute_force(spark, tiles):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    found = topk.top_k(e.filter("vec_id % 50 = 0"), e, 5, item_tile=tiles[0], query_tile=tiles[1]).collect()
    assert sorted(map(tuple, found)) == brute_top([(r.vec_id, r.embedding) for r in e.collect()], 5, lambda i: i % 50 == 0)


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (50, [-1.0, 0.5]), (8, [1e9, 1e9]), (100, []),
            (1, [3.0, 1.0]), (0, [-2.0, 1.0]), (0, [1.0, 2.0]), (1, [-7.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, tile int")
    for k in (1, 3, 20):
        found = sorted(map(tuple, topk.top_k(frame.filter("vec_id % 50 = 0"), frame, k, item_tile=2, query_tile=1).collect()))
        assert found == brute_top(rows, k, lambda i: i % 50 == 0)
    none = frame.limit(0)
    assert topk.top_k(none, frame).count() == topk.top_k(frame, none).count() == 0


def brute_url(url, listed):
    m = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[2].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[3]) if m else ("", "")

    def fits(entry):
        h, _, p = entry.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p if "/" in entry else "")

    rules = sorted((len(e), e, v) for v, e in URL_RULES if fits(e))
    if rules:
        return host, path, rules[-1][1], rules[-1][2]
    return host, path, None, "block" if any(fits(e) for e in listed) else "allow"


@pytest.mark.parametrize("sizes", [{}, {"small_list": 0, "shard_entries": 2, "probes_per_task": 3}])
def test_url_filter(spark, sizes):
    given = [None, "", "no scheme", "http://", "http://x.com", "http://X.com/", "https://www.example.com/en/1?x=http://y",
             "http://a.example.com/en/", "http://a.example.com/en", "http://b.net/es/q", "http://spam.org/x", "http://a.spam.org",
             "http://notspam.org/", "http://bad.org/dir/page", "http://bad.org/di", "x://h#f", "http://net/fr/", "http://ü.org/ä",
             "http://spam.org/x"]
    given += [r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    listed = ["spam.org", "bad.org/dir", "ü.org/ä", None, "spam.org"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(given)], "page_id bigint, url string, host string")
    found = urls.url_table(pages, URL_RULES, spark.createDataFrame([(e,) for e in listed], "entry string"), **sizes)
    assert [tuple(r)[1:] for r in found.orderBy("page_id").collect()] == [brute_url(u, [e for e in listed if e]) for u in given]
    none = urls.url_table(pages.limit(0), URL_RULES, spark.createDataFrame([], "entry string"), **sizes)
    assert none.count() == 0


def test_equal_digests_are_told_apart():
    digests = np.array([5, 5, 9], np.uint64)
    array = urls.DigestArray(digests, ["a", "b", "c"], [0, 0, 0])
    keys = {"a": 5, "b": 5, "x": 5, "c": 9, "y": 7}
    original = urls.xxhash.xxh64_intdigest
    try:
        urls.xxhash.xxh64_intdigest = keys.__getitem__
        assert array.probe(list(keys)).tolist() == [0, 1, -1, 2, -1]
    finally:
        urls.xxhash.xxh64_intdigest = original


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeated = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines),
            len(lines) - len(set(lines)), len(repeated))


@pytest.mark.parametrize("which", ["docs", "odd", "nothing", "clashing"])
def test_quality(request, which):
    frame = request.getfixturevalue(which)
    found = quality.quality_table(frame, least_docs=5).collect()
    texts = [r.text for r in frame.collect()]
    assert sorted(tuple(r)[1:7] for r in found) == sorted(map(brute_counts, texts))
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept in (True, False) and not (r.kept and r.base_failed)
    kept = quality.keep_documents(frame, least_docs=5)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in found)


def test_sketch_quantiles(spark):
    values = [int(x) for x in np.random.default_rng(1).lognormal(5, 2, 3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    pairs = frame.select("v", quality.bucket(F.col("v")).alias("b")).collect()
    assert all(b <= v <= b + b / 32 for v, b in pairs) and all(v == b for v, b in pairs if v < 64)


def test_quality_keeps_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality_table(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    clean, junk = judged.filter("quality = 1 and not base_failed"), judged.filter("quality = 0")
    assert clean.filter("not kept").count() <= 0.01 * clean.count()
    assert junk.filter("kept").count() <= 0.05 * junk.count()
