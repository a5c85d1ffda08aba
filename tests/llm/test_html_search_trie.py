import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pointweave.llm import html_text, ranked, trie
from .conftest import SMALL

# Main text of pages ----------------------------------------------------------------------------------------------------

LONG = "A paragraph of running text that goes on for a while, as those of an article do."
PAGES = [
    ("<html><head><title>T</title></head><body><nav><ul><li><a href=/>home</a></ul></nav><article><h1>T</h1><p>a<p>b&amp;c &lt;"
     "<br>d</article><footer>&copy; us</footer>", "T\na\nb&c < d"),
    (f"<body class=has-sidebar><div class='site-header'>My site</div><div id=content><h1>T</h1><p>Short.</p><p>{LONG}</p><p>Hm.</p>"
     f"<p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div>", f"T\nShort.\n{LONG}\nHm.\n{LONG}"),
    (f"<main><article><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG}{LONG}</p></article></section></main>", LONG),
    (f"<article><header><h1>T</h1><p>by me</p></header><p>{LONG}<script>var a='</p>';</script><form><input><p>mail?</form><aside>x</aside>"
     f"<div class='advert'>{LONG}</div><!-- {LONG} --></article>", f"T\n{LONG}"),
    (f"<div class=menu><article><p>{LONG}</article></div>", LONG),
    (f"<article><p>{LONG}<ul><li><a href=1>r1</a><li><a href=1>r2</a></ul><ul><li>x<li><a href=2>y</a></ul></article>", f"{LONG}\nx\ny"),
    (f"<div role=main><p hidden>no</p><p style='display: none'>no</p><p>{LONG} <span class=ad>no</span> {LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<table><tr><td>{LONG}<td>{LONG}</table>", f"{LONG}\n{LONG}"),
    ("<article><p>one<br><br>two<br>three\n\t four&nbsp;five</article>", "one\ntwo three four five"),
    ("only text &eacute;", "only text é"), ("<p>a", "a"), ("", ""), (None, ""), ("<article></article>", ""), ("<<<>&&;", "<<<>&&;"),
    ("<script>x", ""), ("<article><p>cut o", "cut o"), ("</p></b></article>", ""), ("<!-- <p>x", ""),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <b> <br> <article> </article> <nav> </nav> <li> </div> <div> <a href=x> </a> word < & &am "
                                "<!-- --> <script> </script> <td> <h1> </h1>".split(" ")), max_size=40).map(" ".join))
def test_any_markup_is_parsed(html):
    text = html_text.main_text(html)
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n"))


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 50_000 + LONG) == LONG
    assert html_text.main_text("<article>" + f"<p>{LONG}" * 20_000) == "\n".join([LONG] * 20_000)
    assert html_text.main_text("<article><p>" + "word " * 400_000).count("word") == 400_000


def test_gaussian_and_threshold():
    assert np.allclose(html_text.smoothed(np.full(7, 3.0)), 3)
    single = html_text.smoothed(np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert single.argmax() == 3 and single[2] == single[4] > single[1] > 0 == single[0]
    assert 2 < html_text.threshold(np.array([1, 2, 1, 50, 60, 55.0])) < 50


def test_extracted(spark):
    rows = [(i, "u", h, "x", 1) for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None, None), (0, "u", PAGES[0][0], "x", 1)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    found = html_text.extracted(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    expected = [(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, "", 0), (0, PAGES[0][1], len(PAGES[0][1]))]
    assert sorted(map(str, ((r.page_id, r.text, r.n_chars) for r in found.collect()))) == sorted(map(str, expected))
    assert html_text.extracted(frame.limit(0)).count() == 0


# Ranked search -----------------------------------------------------------------------------------------------------------


def brute_search(items, docs, k):
    terms = lambda t: [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x)
                       for x in re.findall(ranked.TERM, t or "")]
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    out = []
    for item, text in items:
        scored = []
        own = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t in set(terms(text))
               if (df := sum(t in c for _, c in counts))}
        for i, c in counts:
            if c:
                m = 10 + 90 * c.total() * n_docs // total
                score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in own.items())
                if score > 0:
                    scored.append((-score, i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


ITEMS = "item_id bigint, text string"
SIZES = [{}, {"small_vocabulary": 3, "shard_docs": 3, "block_queries": 2, "look": 1}, {"shard_docs": 16, "look": 3}]


@pytest.mark.parametrize("which", ["docs", "odd", "nothing", "clashing"])
@pytest.mark.parametrize("sizes", SIZES)
def test_search(request, spark, which, sizes):
    frame = request.getfixturevalue(which)
    rows = [(1, "One two, THREE three ü"), (2, None), (3, ""), (None, "four a abc"), (1, "One two, THREE three ü"), (1, "nine wörd"),
            (4, "the and of"), (5, "zzzz not there")]
    if which == "docs":
        rows += [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").limit(6).collect()]
    items = spark.createDataFrame(rows, ITEMS).withColumn("query", F.lit(1)).withColumn("rank", F.lit(2))
    found = ranked.search(items, frame, 10, **sizes).collect()
    assert sorted(map(str, map(tuple, found))) == brute_search(rows, [(r.doc_id, r.text) for r in frame.collect()], 10)
    assert ranked.search(items.limit(0), frame, 10, **sizes).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=6), min_size=1, max_size=40), st.integers(1, 8), st.integers(1, 60))
def test_best_first_equals_all_scores(docs, k, bar):
    """Small whole impacts, so that ties are frequent."""
    terms = range(7)
    places = [np.array([i for i, d in enumerate(docs) if t in d], np.int64) for t in terms]
    impact = [np.array([docs[i].count(t) * 7 % 5 + 1 for i in p], np.int64) for t, p in zip(terms, places)]
    lists = ranked.Lists(len(docs), places, impact)
    weights = np.array([3, 1, 4, 1, 5, 9, 2])
    total = np.zeros(len(docs), np.int64)
    for w, p, i in zip(weights, places, impact):
        total[p] += w * i
    expected = sorted((-s, i) for i, s in enumerate(total.tolist()) if s >= bar)[:k]
    scores, where = lists.best(np.array(terms), weights, k, bar)
    assert list(zip((-scores).tolist(), where.tolist())) == expected


def test_sparse_table_is_the_maximum():
    random = np.random.default_rng(5)
    places = [np.sort(random.choice(300, n, replace=False)) for n in (0, 1, 2, 150, 300)]
    impact = [random.integers(1, 50, len(p)) for p in places]
    lists = ranked.Lists(300, places, impact)
    low, high = random.integers(0, 301, (2, 500))
    best = lists.highest(np.arange(5), np.minimum(low, high), np.maximum(low, high))
    for row, a, b in zip(best, np.minimum(low, high), np.maximum(low, high)):
        for e, p, i in zip(row, places, impact):
            inside = i[(p >= a) & (p < b)]
            assert lists.impact[e] == (inside.max() if len(inside) else 0)
            if len(inside):
                assert lists.place[e] == p[(p >= a) & (p < b)][inside.argmax()]


# Conversation trie -------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        sequence = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *own[c][h:])
        for d in range(len(sequence) + 1):
            members[sequence[:d]].append(c)
        ends[sequence].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(str((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
                       hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())) for node, m in members.items())


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
TINY = {"least": 2, "slice_rows": 40, "shard_nodes": 30, "in_memory": 3}


@pytest.mark.parametrize("sizes", [{}, TINY])
def test_trie(spark, sizes):
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    found = trie.trie(frame, **sizes).collect()
    assert sorted(str(tuple(r)) for r in found) == brute_trie([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("sizes", [{}, TINY])
def test_trie_of_odd_conversations(spark, sizes):
    """A hot first turn, copies, one long conversation, absent bases, gaps, nulls, repeated rows, ids below zero."""
    rows = [(c, t, "user" if t % 2 == 0 else None, "same" if t == 0 or c % 7 == 0 else f"{c} {t}") for c in range(90, 330) for t in range(c % 9)]
    rows += [(1000, t, "a", f"long {t % 3}") for t in range(400)] + [(1001, t, "a", f"long {t % 3}") for t in range(400)]
    rows += [(5003, None, None, None), (5003, 1, "", ""), (5003, 1, "", ""), (-5, 0, "user", "same"), (-105, 3, "x", "é🙂"), (-200, 0, "x", "y")]
    rows += [(None, 0, "user", "same"), (7000, 0, "b", "tie"), (7000, 0, "a", "tie")]
    frame = spark.createDataFrame(rows, CONVERSATIONS).withColumn("depth", F.lit("x")).withColumn("number", F.lit(1))
    found = trie.trie(frame.repartition(5), **sizes).collect()
    assert sorted(str(tuple(r)) for r in found) == brute_trie(rows)
    assert trie.trie(frame.limit(0), **sizes).count() == 0


def test_spilling_queue():
    random = np.random.default_rng(3)
    messages = [(*map(int, random.integers(-4, 4, 3)), i, 0, 0) for i in range(500)]
    queue = trie.SpillingQueue(7)
    for m in messages:
        queue.push(m)
    keys = sorted({m[:3] for m in messages})
    for key in [k for i, k in enumerate(keys) if i % 5] + [keys[-1]]:
        assert sorted(queue.take(key)) == sorted(m for m in messages if m[:3] == key)
        messages = [m for m in messages if m[:3] != key]
    assert not queue.young and not queue.runs
