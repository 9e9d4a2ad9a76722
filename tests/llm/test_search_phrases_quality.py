"""Lexical search, phrases and quality against brute force, and defined edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from posolog.llm import collocations, max_sketch, quality
from posolog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, rank int, score long, id long, i long, label int"
LONG = "word and more, " * 20_000


def rows_of(*rows):
    return [(*r, "s", 1, 2, 3, 4, 5, 6, 7) for r in rows]


#: Nulls, empty and long texts, ties, repeated rows, and columns with clashing names.
ODD = rows_of(
    (1, "alpha beta gamma delta. alpha beta", "en"),
    (1, "alpha beta gamma delta. alpha beta", "en"),
    (2, None, None),
    (3, "", "en"),
    (None, "alpha beta", "und"),
    (None, "alpha beta", None),
    (4, LONG, "en"),
    (5, " \t\n .,;", "en"),
    (6, "ÜNÏ alpha\x00beta İß\x1c漢字 ALPHA\tBeta", "de"),
    (7, "alpha beta", "en"),
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Ranked search


def brute_search(docs, items, best=10):
    """Scores of every pair, from the formula."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    terms = [pattern.findall((text or "").translate(low)) for _, text in docs]
    big_n, big_l = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for found in terms for t in set(found))
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), found in zip(docs, terms, strict=True):
            if not found:
                continue
            m, tf = 10 + 90 * len(found) * big_n // big_l, Counter(found)
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in set(pattern.findall((text or "").translate(low)))
                if tf[t]
            )
            if score:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, n + 1, None if no else d, -s) for n, (s, no, d) in enumerate(sorted(scored)[:best])]
    return out


def test_search_equals_brute_force(spark, odd, none):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    odd_items = spark.createDataFrame(
        [(1, "alpha BETA alpha", 1, "x"), (1, "beta", 1, "x"), (None, "alpha", 1, "x"), (2, None, 1, "x"), (3, " .,", 1, "x"), (4, LONG, 1, "x"), (5, "unseen", 1, "x")],
        "item_id long, text string, doc_id long, term string",
    )
    for docs, queries in ((documents, items), (odd, odd_items), (documents, odd_items), (none, items), (odd, odd_items.limit(0))):
        expected = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in queries.collect()])
        got = max_sketch.search(docs, queries)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_search_in_several_batches_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(max_sketch, "BATCH_TERMS", 300)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = brute_search([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    assert sorted(map(tuple, max_sketch.search(documents, items, best=3).collect())) == sorted(expected)


def sketch_queries(places):
    return max_sketch.Queries(40, 4000, [0, 1], [{b"a": 900, b"b": 5000, b"zz": 70}, {f"t{i}".encode(): i for i in range(1, places)}])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"zz", *(f"t{i}".encode() for i in range(400))]), min_size=1, max_size=300), min_size=1, max_size=12), st.sampled_from([1, 8]))
def test_bounds_are_never_below_scores(texts, load):
    queries = sketch_queries(200)
    before, max_sketch.LOAD = max_sketch.LOAD, load
    try:
        search, block = max_sketch.Search(queries, 2), max_sketch.Block()
        for n, found in enumerate(texts):
            block.add(n, found, queries.sought, max_sketch.Memory(zlib.crc32))
        exact = [[search.score(q, block.sought[d], block.lengths[d]) for q in (0, 1)] for d in range(len(texts))]
        for own, sketches in block.sketches(queries):
            for d, bounds in zip(own, queries.bounds(sketches), strict=True):
                assert all(b >= s for b, s in zip(bounds, exact[d], strict=True))
        search.take(block)
        for q in (0, 1):
            best = sorted((-exact[d][q], False, d) for d in range(len(texts)) if exact[d][q])[:2]
            assert sorted(search.found[q])[:2] == best
    finally:
        max_sketch.LOAD = before


def test_bounds_spare_most_exact_scores(spark):
    """The sketches must decide: a small part of the pairs is scored exactly."""
    documents = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    found = [max_sketch.terms(text) for _, text in documents]
    df = Counter(t for own in found for t in set(own))
    big_n, big_l = sum(map(bool, found)), sum(map(len, found))
    weights = [{t: max_sketch.weight(big_n, df[t]) for t in set(max_sketch.terms(i.text)) if t in df} for i in items]
    queries = max_sketch.Queries(big_n, big_l, list(range(len(items))), weights)
    search, block, hashed = max_sketch.Search(queries, 10), max_sketch.Block(), max_sketch.Memory(zlib.crc32)
    for (doc_id, _), own in zip(documents, found, strict=True):
        if own:
            block.add(doc_id, own, queries.sought, hashed)
    search.take(block)
    assert search.rescored < 0.1 * big_n * len(items)


# Phrases


def brute_phrases(docs, least, top, held=80):
    low = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            found = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(found)
            for m in (1, 2, 3, 4):
                count.update((lang, tuple(found[s : s + m])) for s in range(len(found) - m + 1))
    frequent = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= least}
    holders = {}
    for (lang, ws), n in frequent.items():
        for m in range(2, len(ws)):
            for s in range(len(ws) - m + 1):
                part = (lang, ws[s : s + m])
                holders[part] = max(holders.get(part, 0), n)
    out = []
    for lang in total:
        kept = []
        for (own, ws), a in frequent.items():
            if own != lang or 100 * holders.get((lang, ws), 0) >= held * a:
                continue
            cuts = [(2_000_000 * a // (count[lang, ws[:k]] + count[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(ws).encode(), count[lang, ws[:k]], count[lang, ws[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return out


def top(docs, least, n):
    import pyspark.sql.functions as F
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations.phrases(docs, least=least).filter("not dropped").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return sorted(tuple(r) for r in ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("head_bits", [16, 10, 4])
def test_phrases_equal_brute_force(spark, odd, monkeypatch, head_bits):
    """Ranked and hashed ids, crowded tiles and coordinates give the same counts."""
    if head_bits != 16:  # most words and pairs are hashed, tiles crowded
        monkeypatch.setattr(collocations, "HEAD_BITS", head_bits)
        monkeypatch.setattr(collocations, "HEAD", 1 << head_bits)
        monkeypatch.setattr(collocations, "SIDE_BITS", 3)
        monkeypatch.setattr(collocations, "SIDE", 8)
        monkeypatch.setattr(collocations, "TILES", 1 << 2 * (head_bits - 3))
        monkeypatch.setattr(collocations, "DENSE_PAIRS", 4)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for docs, least in ((documents, 5), (odd, 2)):
        expected = brute_phrases([(r.lang, r.text) for r in docs.collect()], least, 300)
        assert expected
        assert top(docs, least, 300) == sorted(expected)


def test_phrases_of_nothing(spark, none):
    assert collocations.top_phrases(none).collect() == []
    assert collocations.top_phrases(spark.createDataFrame(rows_of((1, None, None), (2, " .", "en")), SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90)), max_size=200), st.integers(0, 3))
def test_tiles_count_pairs(pairs, crowd):
    before = collocations.SIDE_BITS, collocations.SIDE, collocations.HEAD_BITS, collocations.HEAD, collocations.TILES, collocations.DENSE_PAIRS, collocations.HELD_PAIRS
    collocations.SIDE_BITS, collocations.SIDE, collocations.HEAD_BITS, collocations.HEAD, collocations.TILES = 3, 8, 6, 64, 64
    collocations.DENSE_PAIRS, collocations.HELD_PAIRS = 1 << crowd, 16
    try:
        tiles = collocations.Tiles()
        for at in range(0, len(pairs), 40):
            i, j = (np.array([p[k] for p in pairs[at : at + 40]], np.int64) for k in (0, 1))
            tiles.add(i, j)
        got = Counter()
        for batch in tiles.rows():
            for i, j, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[i, j] += n
        assert got == Counter(pairs)
    finally:
        (collocations.SIDE_BITS, collocations.SIDE, collocations.HEAD_BITS, collocations.HEAD, collocations.TILES,
         collocations.DENSE_PAIRS, collocations.HELD_PAIRS) = before


def test_scores_beyond_64_bits(spark):
    import pyspark.sql.functions as F

    cases = [(9 * 10**18, 4 * 10**18 + 7), (3, 7), (10**13, 2 * 10**13 + 1)]
    frame = spark.createDataFrame(cases, "a long, parts long")
    got = [r.s for r in frame.select(collocations._floored(F.col("a"), F.col("parts")).alias("s")).collect()]
    assert got == [2_000_000 * a // parts for a, parts in cases]


# Quality


def test_quality_tells_junk_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op13_quality"](spark, sf).collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, junk = ([s for s, _, y in held if y == want] for want in (1, 0))
    assert sum(a > b for a in good for b in junk) > 0.99 * len(good) * len(junk)
    assert sum(p for _, p, y in held if y) >= 0.98 * len(good)
    assert sum(1 - p for _, p, y in held if not y) >= 0.85 * len(junk)


def test_ridge_equals_plain_normal_equations(spark, monkeypatch):
    """Partition sums and ridge scores against one direct computation."""
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = [(r.doc_id, r.text or "") for r in documents.collect()]
    values = np.array([quality.statistics(text) for _, text in texts])
    kernel = quality.Kernel(values.mean(0), values.std(0))
    z = kernel(values)
    mod = [zlib.crc32(str(d).encode()) % 5 for d, _ in texts]
    rows = [n for n, (d, _) in enumerate(texts) if d in known and mod[n] in (1, 2, 3)]
    y = np.array([known[texts[n][0]] for n in rows], float)
    weights = quality.solved(np.column_stack([z[rows].T @ z[rows], z[rows].T @ y]))
    monkeypatch.setattr(quality, "ROWS", 16)
    got = {r.doc_id: r.ridge for r in quality.quality_scores(documents.repartition(7), labels).collect()}
    expected = {d: s for (d, _), s in zip(texts, z @ weights, strict=True)}
    assert got.keys() == expected.keys()
    assert max(abs(got[d] - expected[d]) for d in got) < 1e-4


def plain_isotonic(x, y, n):
    """Greatest convex minorant of the cumulated labels, by its definition."""
    total, ones = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(y)])
    out = np.zeros(len(x))
    for k in range(len(x)):
        out[k] = max(min((ones[b] - ones[a]) / (total[b] - total[a]) for b in range(k + 1, len(total))) for a in range(k + 1))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 6)), min_size=1, max_size=14))
def test_isotonic_pools(cells):
    rows = np.array([n for _, n in cells])
    ones = np.array([min(y, n) for y, n in cells])
    x = np.arange(len(cells)).astype(float)
    middles, shares = quality.isotonic(x, ones, rows)
    assert (np.diff(middles) > 0).all() and (np.diff(shares) >= -1e-9).all() or len(middles) == 1
    plain = plain_isotonic(x, ones, rows)
    assert len(middles) == len(np.unique(np.round(plain, 12)))


def test_quality_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame(
        [(i, i % 2, 7, "x") for i in (1, 3, 4, 5, 6, 7)] + [(1, None, 7, "x"), (None, 1, 7, "x"), (7, 5, 7, "x"), (4, 1, 7, "x")],
        "doc_id long, quality int, label int, statistics string",
    )
    for known in (labels, labels.filter("quality = 1"), labels.filter("quality = 0"), labels.limit(0)):
        got = quality.quality_scores(odd, known)
        rows = got.collect()
        assert got.columns == ["doc_id", "held_out", "ridge", "score", "predicted"]
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
        assert all(r.score is not None and 0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert quality.quality_scores(none, labels).collect() == []
    assert all(r.score == 0 for r in quality.quality_scores(odd, labels.limit(0)).collect())
    assert all(r.score == 1 for r in quality.quality_scores(odd, labels.filter("quality = 1")).collect())
    held = {r.doc_id for r in quality.quality_scores(odd, labels).filter("held_out").collect()}
    assert held == {i for i in range(1, 8) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert odd.select(F.count("*")).first()[0] == len(ODD)
