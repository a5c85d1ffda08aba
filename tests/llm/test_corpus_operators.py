import collections
import math
import re
import zlib

import pytest
import public_tokenizers
import sentencepiece
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pointweave.llm import licenses, lm, mixing, pii, sentencepiece_fst, simhash, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
FRAMES = ["docs", "odd", "nothing", "clashing"]


# Personal data ------------------------------------------------------------------------------------------------------


def replaced(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return pii.pii_table(rows, "key").orderBy("doc_id").collect()


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def test_only_valid_values_change(spark):
    wrong = ["4111 1111 1111 1112", "1.2.3.256", "1.2.3.4.5", "2021-02-29", "000-12-3456", "666-12-3456", "123-00-4567",
             "DE88 3704 0044 0532 0130 00", "31/31/2020", "1234", "plain words", "a@b", "", "5555"]
    for row, text in zip(replaced(spark, *wrong), wrong):
        assert row.text == text and row.n_values == 0


def test_formats_are_kept(spark):
    card, iban, day, ssn, ip, phone = (r.text for r in replaced(
        spark, "4111-1111 11111111", "GB82 WEST 1234 5698 7654 32", "2020-02-29", "123-45-6789", "97.51.17.173", "+1 (017) 555-7713"))
    assert re.fullmatch(r"\d{4}-\d{4} \d{8}", card) and luhn(card) and card != "4111-1111 11111111"
    assert re.fullmatch(r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d", iban)
    moved = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", day) and re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn)
    assert all(0 <= int(p) < 256 for p in ip.split(".")) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone)


def test_equal_values_stay_linked(spark):
    first, second, other = (r.text.split()[1] for r in replaced(
        spark, "x 4111111111111111 y", "z 4111111111111111", "x 5500005555555559"))
    assert first == second != other
    assert replaced(spark, "Jo.1@X.example.com")[0].text == replaced(spark, "jo.1@x.example.com")[0].text


def test_neighbours_do_not_hide_values(spark):
    card, iban = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"
    alone, bank, solid = (r.text for r in replaced(spark, card, iban, "4111111111111111"))
    texts = [f"{card} 123", f"{card} 12/27", "Order 12 4111111111111111", f"1234 {card} 123", f"{iban} EUR",
             "AT611904300234573201 BIC", f"AT12 {iban}", f"AB12 {card}"]
    expected = [f"{alone} 123", f"{alone} 12/27", f"Order 12 {solid}", f"1234 {alone} 123", f"{bank} EUR",
                bank.replace(" ", "") + " BIC", f"AT12 {bank}", f"AB12 {alone}"]
    assert [r.text for r in replaced(spark, *texts)] == expected
    rows = replaced(spark, f"{card} 2021-01-05", "123 555-123-4567", "2021-03-04T10:00:00Z", f"{card} 10.0.0.1", "\ufdd1 a@b.com \ufdd0")
    assert [(r.n_values, r.n_card, r.n_date, r.n_phone, r.n_ip, r.n_email) for r in rows] == [
        (2, 1, 1, 0, 0, 0), (1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 0, 0), (2, 1, 0, 0, 1, 0), (1, 0, 0, 0, 0, 1)]
    assert rows[0].text.startswith(alone) and rows[2].text.endswith("T10:00:00Z") and rows[4].text[0] == "\ufdd1"


def test_dates_map_one_to_one(spark):
    """Every way of writing a day of 1900 to 2099 in numbers, and the ends of the calendar."""
    day = spark.sql("SELECT explode(sequence(date'1900-01-01', date'2099-12-31')) AS d")
    layouts = {"iso": "yyyy-MM-dd", "dots": "dd.MM.yyyy", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy"}
    written = day.select("d", F.explode(F.create_map(*[x for k, p in layouts.items() for x in (F.lit(k), F.date_format("d", p))])).alias("layout", "text"))
    written = written.filter("layout <> 'eu' or dayofmonth(d) > 12")
    found = written.select("d", "layout", F.col("text").alias("old"), pii._date(F.col("text"), "key").alias("text")).cache()
    assert found.filter("text is null").count() == 0 and found.filter("text = old").count() <= 3
    slashes = found.filter("layout in ('us', 'eu')")
    assert slashes.count() == slashes.select("text").distinct().count() == 73049 + found.filter("layout = 'eu'").count()
    back = {"iso": "yyyy-MM-dd", "dots": "dd.MM.yyyy", "us": "MM/dd/yyyy"}
    read = F.coalesce(*[F.when(F.col("layout") == k, F.try_to_date("text", p)) for k, p in back.items()])
    linked = found.filter("layout <> 'eu'").groupBy("d").agg(F.count_distinct(read).alias("n"))
    assert linked.filter("n <> 1").count() == 0
    found.unpersist()
    ends = ["0001-01-01", "9999-12-31", "31.12.9999", "12/31/0001", "31/12/9999", "0000-01-01"]
    rows = replaced(spark, *ends)
    assert [r.n_date for r in rows] == [1, 1, 1, 1, 1, 0] and all(r.text != t for r, t in zip(rows[:5], ends))


def test_long_mail_addresses(spark):
    row, = replaced(spark, "x " + "a.b-" * 60 + "c@example.com y")
    assert row.n_email == 1 and "example" not in row.text


def test_long_runs_of_numbers(spark):
    row, = replaced(spark, "7 " * 30_000 + "x")
    assert len(row.text) == 60_001


def test_feistel_is_a_permutation(spark):
    a, b = pii.feistel(F.col("id") % 20, F.floor(F.col("id") / 20), F.lit(20), F.lit(30), "key", F.lit("t"))
    pairs = spark.range(600).select(a.alias("a"), b.alias("b")).collect()
    assert len(set(map(tuple, pairs))) == 600 and all(0 <= r.a < 20 and 0 <= r.b < 30 for r in pairs)
    digits = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", F.lit("t"))).collect()
    assert len({r[0] for r in digits}) == 1000 and all(len(r[0]) == 3 for r in digits)


@pytest.mark.parametrize("which", FRAMES)
def test_pii_leaves_the_rest(request, which):
    frame = request.getfixturevalue(which)
    after = pii.pseudonymise(frame, "key")
    assert after.columns == frame.columns and after.count() == frame.count()
    clean = frame.filter(~F.coalesce(F.col("text"), F.lit("")).rlike("[0-9@]"))
    assert clean.exceptAll(after).count() == 0
    found = {r.doc_id: r for r in pii.pii_table(frame, "key").collect()}
    for r in frame.collect():
        for value in re.findall(r"[\w.]+@[\w.]+\.com", r.text or ""):
            assert value not in found[r.doc_id].text


# Language model -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", FRAMES)
def test_lm_counts_and_model(request, which):
    frame = request.getfixturevalue(which)
    found = lm.scores(frame, shard_bytes=20_000, reducer_bytes=50_000).collect()
    rows = [(r.doc_id, [*re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower()), None]) for r in frame.collect()]
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10
    counts = collections.Counter(w for i, t in rows if fold(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i is not None, i), fold(i) == 0, len(t), sum(counts[w] > 0 for w in t),
                       round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in rows)
    got = sorted(((r.doc_id is not None, r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found)
    assert got == expected
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score <= 0 for r in found)


def test_lm_beats_the_base_on_held_out(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = lm.scores(frame).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_lm_weights_by_brute_force(spark):
    events = [(0, 0.2, 0.0, 5), (1, 0.1, 0.5, 3), (1, 0.3, 0.0, 4), (6, 0.01, 0.9, 50)]
    weights = lm.learn(spark.createDataFrame(events, "magnitude int, p1 double, p2 double, n bigint"), 99, rounds=200, prior=1e-6)
    one = [e for e in events if e[0] == 1]
    like = lambda w: sum(n * math.log(w[0] / 100 + w[1] * p1 + w[2] * p2) for _, p1, p2, n in one)
    steps = [i / 50 for i in range(1, 50)]
    assert like(weights[1]) >= max(like((1 - a - b, a, b)) for a in steps for b in steps if a + b < 1) - 1e-3
    assert weights[0][2] == 0 and all(abs(sum(w) - 1) < 1e-9 for w in weights)


def test_lm_probabilities_sum_to_one(spark):
    """All words after a seen context, and the rest of the vocabulary as one unseen word."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b b a", "c a b", "a", "b c c a b", "a c"] * 6)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = ["a", "b", "c", "unseen"]
    probes = [(1000 + 10 * i, w) for i, w in enumerate(words)] + [(2000, "")]
    probes = [(next(j for j in range(i * 100, i * 100 + 90) if zlib.crc32(str(j).encode()) % 10 == 0), w) for i, w in probes]
    found = {r.doc_id: r for r in lm.scores(frame.unionByName(spark.createDataFrame(probes, frame.schema))).collect()}
    assert all(found[i].held_out for i, _ in probes)
    assert found[probes[3][0]].n_known == 1


# Token counts and SentencePiece ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", FRAMES)
@pytest.mark.parametrize("sizes", [{}, {"huge": 500, "chunk": 200, "overlap": 4}])
def test_token_counts(request, which, sizes):
    frame = request.getfixturevalue(which)
    found = token_counts.token_counts(frame, MODEL, **sizes).collect()
    expected = [(len((r.text or "").encode()), n := len(LIBRARY.encode(r.text or "")), n > 4096) for r in frame.collect()]
    assert sorted(tuple(r)[1:] for r in found) == sorted(expected)


def test_overlaps_widen_without_boundaries(spark):
    texts = ["a" * 3000, "ab" * 2000 + " c" + "the" * 900, "é" * 2500, "x y " * 900]
    frame = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    found = dict(map(tuple, token_counts.huge_counts(frame, MODEL, chunk=300, overlap=4).collect()))
    assert found == {i: len(LIBRARY.encode(t)) for i, t in enumerate(texts)}


ALPHABET = st.sampled_from(list("abehnotTIÉé .,\n\t▁  0<>") + ["the", "ing", " and", "世界", "🙂", "\u0301", "\x00", "<s>", "<0x0A>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_transducer_equals_the_library(text):
    machine = sentencepiece_fst.Transducer.at(MODEL)
    ids = machine.encode(text)
    assert ids == LIBRARY.encode(text)
    assert machine.decode(ids) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=30))
def test_transducer_decodes_any_ids(ids):
    assert sentencepiece_fst.Transducer.at(MODEL).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("which", FRAMES)
def test_encoded(request, spark, which):
    frame = request.getfixturevalue(which)
    rows = sentencepiece_fst.encoded(frame, MODEL)
    assert sorted(r.ids for r in rows.collect()) == sorted(LIBRARY.encode(r.text or "") for r in frame.collect())
    assert rows.filter("not round_trip or n_ids <> size(ids)").count() == 0
    texts = sentencepiece_fst.decoded(rows, MODEL, out="back").select("back")
    assert sorted(r.back for r in texts.collect()) == sorted(r.text or "" for r in frame.collect())


# SimHash -------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    return {f: root(f) for f in distinct}


@pytest.mark.parametrize("which", FRAMES)
def test_near_duplicates(request, which):
    frame = request.getfixturevalue(which)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in frame.collect()]
    roots = brute_components([f for _, f in rows], 3)
    smallest = {}
    for i, f in rows:
        if i is not None:
            smallest[roots[f]] = min(i, smallest.get(roots[f], i))
    expected = sorted((str(i), f"{f:016x}", str(smallest.get(roots[f]))) for i, f in rows)
    for crowded in (simhash.CROWDED, 0):
        found = simhash.near_duplicates(frame, crowded=crowded).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("crowded", [simhash.CROWDED, 2])
def test_links_in_crowds(spark, distance, crowded):
    """Fingerprints a few bits around few centres: crowded segments, and links through every segment."""
    import random

    random.seed(distance)
    centres = [random.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    prints = {c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for c in centres for _ in range(25)}
    signed = {f - 2**64 if f >= 2**63 else f: f for f in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "fingerprint bigint")
    found = [tuple(r) for r in simhash.links(frame, distance, crowded).collect()]
    expected = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= distance}
    assert len(found) == len(set(found)) and set(found) == expected


# Mixing --------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in sizes if s not in full)
        goal = {s: most * sizes[s] if s in full else rest * weight[s] / total for s in sizes}
        above = {s for s in sizes if s not in full and goal[s] > most * sizes[s]}
        if not above:
            return goal
        full |= above


@pytest.mark.parametrize("which", FRAMES)
@pytest.mark.parametrize("block", [mixing.BLOCK, 2])
def test_mix(request, which, block):
    frame = request.getfixturevalue(which)
    found = mixing.mix_table(frame, block=block).collect()
    words = [(str(r.doc_id), r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in frame.collect()]
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in found) == sorted((i, str(s), n) for i, s, n in words)
    sizes = collections.defaultdict(int)
    for _, source, n in words:
        sizes[source] += n
    goals = brute_targets(dict(sizes)) if words else {}
    taken, largest = collections.Counter(), collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - goals[s]) <= largest[s] / 2 + 1e-6 for s in taken)
    again = mixing.mix_table(frame.repartition(3), block=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    copies = mixing.mix_documents(frame, block=block)
    assert copies.columns == frame.columns and copies.count() == sum(r.copies for r in found if r.size)


def test_expected_copies_stay(spark):
    """Over many seeds a document is taken as often as its source's share says."""
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)], "doc_id bigint, text string, source string")
    runs = [mixing.mix_table(rows, seed=s, block=8).select("doc_id", "copies", "target", "source_size") for s in range(40)]
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    bias = every.groupBy("doc_id").agg((F.avg("copies") - F.first(F.col("target") / F.col("source_size"))).alias("d"))
    assert bias.agg(F.max(F.abs("d"))).first()[0] < 0.35 and abs(bias.agg(F.avg("d")).first()[0]) < 0.02


# Licences ------------------------------------------------------------------------------------------------------------


FAMILY = {"MIT": r"under the MIT License", "Apache": r"under the Apache License", "GPL": r"GNU General Public", "CC": r"under CC BY"}


def test_licenses_are_found_and_nothing_else(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in frame.collect()}
    found = licenses.license_table(frame).collect()
    for r in found:
        assert r.licenses == sorted(k for k, p in FAMILY.items() if re.search(p, texts[r.doc_id], re.I))
        assert (r.license is None) == (not r.licenses)


@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_licenses_of_odd_rows(request, which):
    frame = request.getfixturevalue(which)
    found = licenses.license_table(frame, sample=50).collect()
    assert len(found) == frame.count() and all(r.licenses == [] and r.license is None for r in found)


def test_unseen_wordings(spark):
    rows = [(1, "x\nOur data is released under the MIT license, see LICENSE.", ["MIT"]), (2, "The licensed driver was released.", []),
            (3, "Licensed under the Apache License, Version 2.0 by us\nReleased under the MIT License.", ["Apache", "MIT"]),
            (4, "all the general public was there", [])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, expected array<string>")
    found = {r.doc_id: r.licenses for r in licenses.license_table(frame, sample=50).collect()}
    assert found == {i: e for i, _, e in rows}


def test_notices_below_the_threshold_are_unknown(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (2, "all the general public was there")],
                                  "doc_id bigint, text string")
    lines = licenses.paragraphs(frame, "doc_id", "text")
    strict = licenses.fit(lines, 50)
    strict.threshold = 1.1
    assert [(r.id, r.known, r.confirmed) for r in licenses.notices(lines, strict).collect()] == [(1, False, False)]
    monkeypatch.setattr(licenses, "fit", lambda *_: strict)
    found = {r.doc_id: (r.licenses, r.n_unknown) for r in licenses.license_table(frame).collect()}
    assert found == {1: ([], 1), 2: ([], 0)}
