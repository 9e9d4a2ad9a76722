"""Operators of the training-data package against brute force, and defined edge cases."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posolog.llm import cap_filters, common, exact_dedup, html_text, line_dedup, mixing, near_texts, packing, repeated_bytes, simhash
from posolog.llm import token_counts, toxicity
from posolog.llm.graph import components
from posolog.llm.queries import CHECKS, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, drops int"
LONG = "word " * 30_000

#: Nulls, empty and long texts, ties, repeated rows, and columns with clashing names.
ODD = [
    (1, "a b c d e f", "en", "s1", 11, "x", "y", 3),
    (1, "a b c d e f", "en", "s1", 11, "x", "y", 3),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "s1", 0, "x", "y", 3),
    (None, "null id", "en", "s2", 7, "x", "y", 3),
    (4, LONG, "en", None, len(LONG), "x", "y", 3),
    (5, LONG, "en", "s2", len(LONG), "x", "y", 3),
    (6, "  \n\n \t ", "en", "s3", 7, "x", "y", 3),
    (7, "Ünïcode İß Σ\x1c\x85　 <|endoftext|> 漢字", "en", "s3", 9, "x", "y", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


TEXTS = st.lists(st.sampled_from(list("ab 'sdt12\n\t.,!éßİΣ́ \x1c\x85漢½") + ["  ", "the ", "<|endoftext|>"]), max_size=24).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_tokens_equal_the_library(text):
    count = token_counts.counter(vocabulary("byte_bpe_50k.json"))
    assert count(text) == len(library_byte().encode(text, add_special_tokens=False).ids)
    ids = np.frombuffer(packing.word_ids(vocabulary("word_bpe_49k.json"))(text), "<u4").tolist()
    assert ids == library_word().encode(text, add_special_tokens=False).ids


_held = {}


def library_byte():
    return _held.setdefault("byte", library("byte_bpe_50k.json"))


def library_word():
    return _held.setdefault("word", library("word_bpe_49k.json"))


def test_character_classes_agree_where_they_are_used():
    split, pattern = library_byte().pre_tokenizer, token_counts.counter(vocabulary("byte_bpe_50k.json")).pattern
    for low, high in token_counts.SAME_CLASSES[:3]:
        for point in range(low, high + 1):
            for text in ("a" + chr(point), "1" + chr(point), "!" + chr(point)):
                assert len(split.pre_tokenize_str(text)) == len(pattern.findall(text)), hex(point)


def test_token_counts(documents, odd, none):
    path, tokens = vocabulary("byte_bpe_50k.json"), library_byte()
    for docs in (documents, odd):
        expected = [(r.doc_id, len((r.text or "").encode()), len(tokens.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
        got = token_counts.token_counts(docs, path).collect()
        assert [tuple(r)[:3] for r in got] == expected
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(none, path).collect() == []


def test_mix_is_near_its_targets(documents, odd, none):
    rows = mixing.mix(documents).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in rows))
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.01 * target + 8
    assert sorted(map(tuple, mixing.mix(documents).collect())) == sorted(map(tuple, rows))
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(none).collect() == []
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == pytest.approx(sum(r.taken for r in rows), rel=1e-3)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(none).collect() == []


def test_small_source_of_short_texts_reaches_its_target(spark):
    docs = spark.range(40_000).selectExpr(
        "id AS doc_id", "if(id < 100, 'small', 'hot') AS source", "repeat('word ', if(id < 100, 10, 50)) AS text"
    )
    rows = mixing.mix(docs).filter("source_size = 1000").collect()
    assert {r.target for r in rows} == {3000}
    block = 3000 // mixing.BLOCK_SHARE
    assert sum(r.taken for r in rows) >= 3000 - block
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.passes + r.part for r in rows)


def test_seats_are_the_highest_quotients(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(30):
        house = int(rng.integers(0, 60))
        rows += [(group, i, int(rng.integers(0, 50) ** 2), house) for i in range(int(rng.integers(1, 8)))]
    got = mixing.seats(spark.createDataFrame(rows, "g long, i long, votes long, house long"), ["g"], "votes", "house", ["i"]).collect()
    for group in range(30):
        parties = [(i, v, h) for g, i, v, h in rows if g == group]
        won = dict.fromkeys([i for i, _, _ in parties], 0)
        for _ in range(parties[0][2] if any(v for _, v, _ in parties) else 0):
            best = min(parties, key=lambda p: (-p[1] / (2 * won[p[0]] + 1), p[0]))
            won[best[0]] += 1
        assert {r.i: r.seats for r in got if r.g == group} == won


def test_toxicity_learns_words_and_holds_rows_out(spark, none):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        text = [*rng.choice(words, 40), *(["vileword", "nastyword"] if bad else [])]
        docs.append((i, " ".join(text)))
        # Labels of held-out rows are wrong: they must not matter.
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(bad != held)))
    docs += [(5000, None), (5001, ""), (None, "w1"), (3, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.toxicity_scores(frame, spark.createDataFrame([*labels, (3, 0), (9, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 1200]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in known]) > 0.98
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(frame, no_labels).collect()} == {0.0}
    assert toxicity.toxicity_scores(none, no_labels).collect() == []


def newton(x, y):
    """Weights (bias first) of the ridge-held logistic model of op3, over all rows at once."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.array([1e-3] + [1.0] * (x.shape[1] - 1))
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ weights))
        weights += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * weights)
    return weights


def test_toxicity_weights_are_fitted_on_all_labelled_rows(spark):
    """Of 24,000 labelled rows of remainder 3 none is left out, whatever its hashed id."""
    rng = np.random.default_rng(5)
    ids = {r: [i for i in range(120_000) if zlib.crc32(str(i).encode()) % 4 == r] for r in (0, 3)}
    fit, n = ids[3][:24_000], 24_000
    toxic = rng.random(n) < 0.3
    # Rows that the former limit of 20,000 by hashed id left out have the other label.
    hashed = spark.createDataFrame([(i,) for i in fit], "doc_id long").orderBy(F.xxhash64("doc_id")).collect()
    late = {r.doc_id for r in hashed[20_000:]}
    docs = [(i, "vile plain" if t else "plain plain") for i, t in zip(fit, toxic, strict=True)]
    labels = [(i, int(t != (i in late))) for i, t in zip(fit, toxic, strict=True)]
    train = ids[0][:200]
    docs += [(i, "vile plain" if at % 2 else "plain plain") for at, i in enumerate(train)]
    labels += [(i, at % 2) for at, i in enumerate(train)]
    scores = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in scores.collect()}
    # With two texts only, the fit gives the label's share among all rows of a text.
    y = dict(labels)
    for kind in (True, False):
        rows = [i for i, t in zip(fit, toxic, strict=True) if t == kind]
        assert len({got[i] for i in rows}) == 1
        assert abs(got[rows[0]] - np.mean([y[i] for i in rows])) < 2e-3


def brute_statistics(docs, labels):
    """Every text's statistics from plain counts of its words and stems."""
    words = [re.findall(r"[^\W_]+(?:'[^\W_]+)*", (t or "").lower()) for _, t in docs]
    stem = lambda w: w[:5]
    tokens, documents = collections.Counter(), collections.Counter()
    c, d = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for (i, _), found in zip(docs, words, strict=True):
        tokens.update(found)
        documents.update({stem(w) for w in found})
        if i is not None and i in labels and zlib.crc32(str(i).encode()) % 4 < 2:
            c[labels[i]].update(found)
            d[labels[i]].update({stem(w) for w in found})
    in_stem = collections.Counter()
    for w, n in tokens.items():
        in_stem[stem(w)] += n + 1
    below = {s: (n + 1) / sum(m + 1 for m in documents.values()) for s, n in documents.items()}

    def ratio(w):
        p = []
        for k in (0, 1):
            n, m = sum(c[k].values()), sum(d[k].values())
            q = max(d[k][stem(w)] - 0.75, 0) / m + 0.75 * len(d[k]) / m * below[stem(w)]
            p.append(max(c[k][w] - 0.75, 0) / n + 0.75 * len(c[k]) / n * q * (tokens[w] + 1) / in_stem[stem(w)])
        return math.log(p[1] / p[0])

    ratios = {w: ratio(w) for w in tokens}
    return [(i, *toxicity.statistics(np.array([ratios[w] for w in found]))) for (i, _), found in zip(docs, words, strict=True)]


@pytest.mark.parametrize("chunk, bucket", [(30, 20), (1 << 16, 1 << 17)])
def test_toxicity_counts_are_exact(spark, chunk, bucket):
    """Words that fell into one hashed cell before keep counts of their own."""
    cell = collections.defaultdict(list)
    for i in range(100_000):
        cell[zlib.crc32(f"stem{i}".encode()) & 0x3FFFF].append(f"stem{i}")
    alike = next(v for v in cell.values() if len(v) > 1)
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(60)] + ["it's", "Ünïcode", "stem_1"]
    docs = [(i, " ".join([*rng.choice(plain, rng.integers(1, 30)), *([alike[i % 2]] * 3)])) for i in range(300)]
    docs += [(900, None), (901, ""), (None, "w1 nobody"), (7, docs[8][1]), (902, "w1 " * 5000)]
    labels = {i: int(i % 2 == 0) for i in range(200)}
    rows = spark.createDataFrame(docs, "doc_id long, text string").select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), F.coalesce("text", F.lit("")).alias("text")
    )
    known = spark.createDataFrame([*labels.items()], "labelled long, toxic int")
    before = toxicity.CHUNK_WORDS, toxicity.BUCKET_WORDS
    try:
        toxicity.CHUNK_WORDS, toxicity.BUCKET_WORDS = chunk, bucket
        found = toxicity.measured_texts(rows.repartition(3), known).drop("content").collect()
    finally:
        toxicity.CHUNK_WORDS, toxicity.BUCKET_WORDS = before
    in_order = lambda some: sorted(some, key=lambda r: (-1 if r[0] is None else r[0], *r[1:]))
    got, want = in_order(map(tuple, found)), in_order(brute_statistics(docs, labels))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose([r[1:] for r in got], [r[1:] for r in want], atol=1e-9)


def test_toxicity_newton_steps(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, len(toxicity.FEATURES))) * [1, 2, 3, 0.1, 1, 5] + 4
    raw = x @ [1, -1, 0.5, 3, 0, 0.2] + rng.normal(size=500)
    y = (raw > np.median(raw)).astype(float)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, x, strict=True)], "toxic int, " + ", ".join(f"{f} double" for f in toxicity.FEATURES))
    mean, deviation, weights = toxicity.fitted(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(deviation, x.std(0))
    assert np.allclose(weights, newton((x - x.mean(0)) / x.std(0), y), atol=1e-6)
    assert toxicity.fitted(rows.filter("toxic = 1")) is None and toxicity.fitted(rows.filter("false")) is None


def brute_repeats(rows):
    seen, out = {}, []
    for doc, body in sorted(rows):
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - 99):
            if seen.setdefault(body[i : i + 100], (doc, i)) < (doc, i):
                gone[i : i + 100] = True
        out.append((doc, len(body), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()),
                    hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("cover", ["content", "difference"])
def test_repeated_bytes(spark, documents, odd, none, cover, monkeypatch):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdé "), 400)) for _ in range(5)]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rng.integers(0, 5)):
            start = rng.integers(0, 300)
            text += base[rng.integers(0, 5)][start : start + rng.integers(20, 300)] + "z" * int(rng.choice([0, 1, 99, 250]))
        rows.append((int(i * 7 % 150) - 20, text))
    got = repeated_bytes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), cover=cover).collect()
    assert sorted(map(tuple, got)) == brute_repeats([(d, t.encode()) for d, t in rows])
    got = repeated_bytes.without_repeats(documents, cover=cover).collect()
    assert sorted(map(tuple, got)) == brute_repeats([(r.doc_id, (r.text or "").encode()) for r in documents.collect()])
    got = repeated_bytes.without_repeats(odd, cover=cover).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode())) for r in ODD)
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (1, 5)} == {(1, 0), (5, len(LONG))}
    assert repeated_bytes.without_repeats(none, cover=cover).collect() == []


def test_portions_hold_every_string():
    body = bytes(range(256)) * (repeated_bytes.PORTION // 100)
    parts = [p for portion in repeated_bytes.portions(iter([(1, body)])) for p in portion]
    starts = [range(at, at + len(part) - 99) for _, at, part in parts]
    assert [s.start for s in starts[1:]] == [s.stop for s in starts[:-1]] and starts[-1].stop == len(body) - 99


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 200), st.integers(0, 200)), min_size=1, max_size=30), st.integers(2, 9), st.sampled_from([16, 40, 64]))
def test_pack_keeps_its_limits(sizes, segments, loss):
    tokens, bears = [n for n, _ in sizes], [min(n, b) for n, b in sizes]
    held = [np.zeros(n, int) for n in tokens]
    for pieces in packing.pack(tokens, bears, 64, segments, loss):
        used = sum(length for _, _, length in pieces)
        assert used == 64 or used & (used - 1) == 0
        assert len(pieces) <= segments
        assert sum(max(0, min(bears[i], start + length) - start) for i, start, length in pieces) <= loss
        for i, start, length in pieces:
            held[i][start : start + length] += 1
    assert all((h == 1).all() for h in held)


def test_packed_pieces_make_up_every_document(documents, odd, none):
    path, tokens = vocabulary("word_bpe_49k.json"), library_word()
    assert packing.packed(none, path).collect() == []
    assert packing.packed(odd, path).count() >= len(ODD)
    rows = packing.packed(documents, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc in documents.collect():
        ids = np.array([*tokens.encode(doc.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[doc.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(ids[r.start : at].tobytes()) == r.ids_crc32
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0


def brute_lines(rows):
    """The template tree of line_dedup, line by line."""
    mask = lambda w: "<*>" if re.search("[0-9]", w) else w
    lines = [
        (d if d is not None else -(10**9), t, at, [mask(w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)])
        for d, t in {(d, t or "") for d, t in rows}
        for at, line in enumerate(t.split("\n"))
    ]
    lines = [x for x in lines if len(x[3]) >= 3]

    def enough(group):
        return len({x[1] for x in group}) >= line_dedup.LEAST_TEXTS

    def grouped(group, key):
        out = {}
        for x in group:
            out.setdefault(key(x), []).append(x)
        return out

    templates = {}
    for leaf, group in filter(lambda x: enough(x[1]), grouped(lines, lambda x: (len(x[3]), *x[3][:4])).items()):
        voters = {(x[1], x[2]): x[3] for x in group}
        votes = collections.Counter((i, w) for words in voters.values() for i, w in enumerate(words) if w != "<*>")
        others = []
        for x in group:
            equal = sum(2 * votes[i, w] > len(voters) for i, w in enumerate(x[3]) if w != "<*>")
            if equal >= 3 and equal >= 0.7 * len(x[3]):
                templates.setdefault(("leaf", leaf), []).append(x)
            elif sum(w != "<*>" for w in x[3]) >= 3:
                others.append(x)
        parts = {leaf: others}
        for _ in range(line_dedup.SPLITS + 1):
            below = {}
            for leaf, group in parts.items():
                voters = {(x[1], x[2]): x[3] for x in group}
                votes = collections.Counter((i, w) for words in voters.values() for i, w in enumerate(words) if w != "<*>")
                votes = {p: n for p, n in votes.items() if n >= line_dedup.LEAST_TEXTS}
                members = {}
                for x in group:
                    for level in range(40):
                        fixed = tuple((i, w) for i, w in enumerate(x[3]) if votes.get((i, w), 0) >= 2**level)
                        if len(fixed) >= 3 and len(fixed) >= 0.7 * len(x[3]) and x not in members.get(fixed, []):
                            members.setdefault(fixed, []).append(x)
                texts = {fixed: len({x[1] for x in lines}) for fixed, lines in members.items() if enough(lines)}
                for x in group:
                    # Of templates of one line with equal texts and sizes there is one only: levels are nested.
                    best = max(((n, len(fixed), fixed) for fixed, n in texts.items() if x in members[fixed]), default=None)
                    if best:
                        templates.setdefault((leaf, best[2]), []).append(x)
                        continue
                    voted = [(votes[p], -p[0], p[1]) for p in enumerate(x[3]) if p in votes]
                    split = max((v for v in voted if v[0] < len(voters)), default=None)
                    if len(voted) >= 3 and len(voted) >= 0.7 * len(x[3]) and split:
                        below.setdefault((leaf, split), []).append(x)
                    else:
                        templates.setdefault(tuple(x[3]), []).append(x)
            parts = below
        for group in parts.values():
            for x in group:
                templates.setdefault(tuple(x[3]), []).append(x)
    out = set()
    for group in filter(enough, templates.values()):
        first = min(group, key=lambda x: (x[0], x[2]))
        out |= {x[:3] for x in group if (x[0], x[2]) != (first[0], first[2])}
    return out


def test_recurring_lines(spark, documents, odd, none):
    rows = [(i, f"Unique start {'abcdefghijklmnop'[i]} of text\nPosted on day {i} by the team {i * i}\nShort one\n{'q' * i} own line here {i}") for i in range(14)]
    rows += [(100, rows[0][1]), (101, None), (102, ""), (None, rows[3][1])]
    # Two and three templates of one leaf, in equal and unequal shares; a name in a late place.
    names = ["Ann", "Bo", "Cy", "Di", "Ed", "Flo"]
    leaf = [f"Thanks to all who read this page written by {n} today" for n in names]
    leaf += [f"Thanks to all who send us their old stamps from {n} again" for n in names]
    leaf += [f"Thanks to all who came along when {n} sang so very well" for n in names[:3]]
    # Four templates of a leaf in equal shares: none has a majority.
    leaf += [f"Please do not ever {verb} {n} {thing}" for verb, thing in (
        ("feed", "any bread at the old pond"), ("send", "letters after the first heavy snow"),
        ("call", "while the choir is still singing"), ("wake", "before noon on a long holiday"),
    ) for n in names[:4]]
    several = [(i, line) for i, line in enumerate(leaf)] + [(90 + i, "Only two texts have this line here") for i in range(2)]
    several += [(95 + i, f"Only two texts have this line here\nbut they differ {n}") for i, n in enumerate(names[:1])]
    got = {(r.doc_id, r.at) for r in line_dedup.recurring_lines(spark.createDataFrame(several, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 13, 14, *range(16, 19), *range(20, 23), *range(24, 27), *range(28, 31))}
    for docs in (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(several, "doc_id long, text string"),
        documents,
    ):
        expected = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
        texts = {}
        for r in docs.collect():
            texts[r.doc_id if r.doc_id is not None else -(10**9)] = r.text or ""
        got = {(r.doc_id if r.doc_id is not None else -(10**9), r.at) for r in line_dedup.recurring_lines(docs).collect()}
        assert got == {(d, at) for d, _, at in expected}
        result = line_dedup.without_recurring_lines(docs).select("row.doc_id", "row.text").collect()
        for r in result:
            key = r.doc_id if r.doc_id is not None else -(10**9)
            assert (r.text or "") == "\n".join(x for i, x in enumerate(texts[key].split("\n")) if (key, i) not in got)
    assert line_dedup.without_recurring_lines(odd).select("row.*").columns == odd.columns
    assert sorted(map(str, line_dedup.without_recurring_lines(odd).select("row.*").collect())) == sorted(map(str, odd.collect()))
    assert line_dedup.without_recurring_lines(none).collect() == []


def brute_components(values, near):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents, odd, none):
    for docs in (documents, odd):
        rows = simhash.simhash_components(docs).collect()
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append(plain_fingerprint(r.text))
        assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(d), f"{f:016x}") for d, fs in texts.items() for f in fs)
        values = [int(r.fingerprint, 16) for r in rows]
        group = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
        least = {}
        for g, r in zip(group, rows, strict=True):
            if r.doc_id is not None:
                least[g] = min(least.get(g, r.doc_id), r.doc_id)
        assert [r.component_id for r in rows] == [least.get(g) for g in group]
    assert simhash.simhash_components(none).collect() == []
    assert simhash.one_of_each(odd).columns == odd.columns


def test_near_texts_are_linked_from_a_jaccard_share_of_08(spark, documents, odd, none):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        words = [f"w{i}x{k}" for k in rng.integers(0, 10**6, 300)]
        rows.append((len(rows), " ".join(words)))
        for changed in (2, 5, 8):
            copy = list(words)
            for at in rng.choice(300, changed, replace=False):
                copy[at] = "other"
            rows.append((len(rows), " ".join(copy)))
    far = 0
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), documents):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        sets = {d: set(near_texts.shingles(t).tolist()) for d, t in texts.items()}
        got = {r.doc_id: r.component_id for r in near_texts.near_components(docs).collect()}
        names = sorted(sets)
        group = brute_components(names, lambda a, b: len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4)
        least = {}
        for g, d in zip(group, names, strict=True):
            least[g] = min(least.get(g, d), d)
        assert got == {d: least[g] for g, d in zip(group, names, strict=True)}
        prints = {d: plain_fingerprint(t) for d, t in texts.items()}
        far += sum(got[d] != d and (prints[d] ^ prints[got[d]]).bit_count() > simhash.MOST_BITS for d in names)
        kept = [r.doc_id for r in near_texts.one_of_each_near(docs).collect()]
        assert sorted(kept) == sorted({least[g] for g in group})
    assert far  # the bits of op7 alone would leave these
    assert near_texts.one_of_each_near(odd).columns == odd.columns
    assert near_texts.near_components(odd).count() == len(ODD)
    assert near_texts.near_components(none).collect() == []


def test_shuffle_files_of_a_stored_step_go_with_it(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    rows = spark.range(1000).repartition(3, "id")
    before = held()
    kept = common.stored_alone(rows)
    assert not held() - before
    common.stored(rows)
    assert held() - before  # these stay until they are collected
    assert kept.count() == 1000


def test_simhash_index_gives_the_pairs_within_its_bits(spark):
    """Stage ``simhash``: fingerprints of five-word shingles up to three bits apart meet in op7's index."""
    rng = np.random.default_rng(7)
    texts = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in rng.integers(0, 10**6, 600)]
        texts += [" ".join(words), " ".join(words) + " end", " ".join(words[1:])]
    texts += [texts[0] + " " + texts[0], ""]  # nearly one set; the empty one meets none
    sets = [near_texts.shingles(t) for t in texts]
    prints = [near_texts.set_fingerprint(s) for s in sets]
    assert prints[0] == int(np.packbits(2 * np.unpackbits(sets[0].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int) > len(sets[0]), bitorder="little").view(np.uint64)[0])
    rows = [(bytes([i]), len(s), int(np.uint64(f).astype(np.int64))) for i, (s, f) in enumerate(zip(sets, prints, strict=True))]
    found = near_texts.simhash_candidates(spark.createDataFrame(rows, "node binary, n int, value long")).collect()
    pairs = {tuple(sorted((r.a[0], r.b[0]))) for r in found}
    size = len(texts)
    bits = [[bin(prints[i] ^ prints[j]).count("1") for j in range(size)] for i in range(size)]
    assert pairs and all(bits[i][j] <= simhash.MOST_BITS for i, j in pairs)
    names = list(range(size - 1))
    near = brute_components(names, lambda i, j: bits[i][j] <= simhash.MOST_BITS and min(len(sets[i]), len(sets[j])) * 5 >= max(len(sets[i]), len(sets[j])) * 4)
    got = brute_components(names, lambda i, j: tuple(sorted((i, j))) in pairs)
    assert got == near


def test_large_entries_are_linked_like_small_ones(monkeypatch):
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    sizes = []
    for limit in (4096, 1):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        links = simhash.tree(values, bits=1)
        assert all((a ^ b).bit_count() <= 1 for a, b in links)
        sizes.append(len(links))
    groups = len(set(brute_components(values.tolist(), lambda a, b: (a ^ b).bit_count() <= 1)))
    assert sizes == [len(values) - groups] * 2


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 160)] + [(5, 5)]
    near = {frozenset(e) for e in edges}
    group = brute_components(list(range(200)), lambda a, b: frozenset((a, b)) in near)
    least = [min(i for i in range(200) if group[i] == g) for g in group]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(least[n] == c for n, c in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact_groups(spark, documents, odd, none):
    long = [(10 + i, "x" * (5000 + i % 3), None, None, None, None, None, None) for i in range(9)]
    for docs in (documents, odd, spark.createDataFrame(ODD + long, SCHEMA)):
        rows = docs.collect()
        by = {}
        for r in rows:
            by.setdefault(r.text or "", []).append(r.doc_id)
        expected = []
        for r in rows:
            ids = by[r.text or ""]
            keep = max((i for i in ids if i is not None), default=None)
            expected.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(str, map(tuple, exact_dedup.exact_groups(docs).collect()))) == sorted(map(str, expected))
    assert exact_dedup.exact_groups(none).collect() == []


def test_names_are_collision_free_beside_equal_hashes(spark):
    """Naming alone separates texts that length and hash would not."""
    rows = [(i, 4, at, bytes([b])) for i, text in enumerate(["abca", "abcb", "abca", "bbca"]) for at, b in enumerate(text.encode())]
    named = exact_dedup.identities(spark.createDataFrame(rows, "row long, bytes long, at int, block binary")).collect()
    names = {r.row: r.name for r in named}
    assert names[0] == names[2] and len(set(names.values())) == 3


def test_texts_that_share_a_passage_are_not_paired(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200)) for _ in range(400)]
    texts += [t.replace(" p150 ", " q ") for t in texts[:20]]  # 20 pairs at 0.98
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [(i, i, near_texts.shingles(t).view(np.int64).tolist()) for i, t in enumerate(texts)]
    pairs = near_texts.candidates(spark.createDataFrame(sets, "node long, part long, hashes array<long>")).collect()
    assert {tuple(sorted(p)) for p in pairs} == {(i, 400 + i) for i in range(20)}
    got = {r.doc_id: r.component_id for r in near_texts.near_components(frame).collect()}
    assert got == {i: i if i < 400 else i - 400 for i in range(420)}


def test_rare_shingles_find_every_pair_from_08(spark):
    rng = np.random.default_rng(6)
    sets = []
    for g in range(60):
        base = rng.choice(4000, rng.integers(1, 60), replace=False)
        for _ in range(6):
            keep = base[rng.random(len(base)) < rng.choice([0.8, 0.9, 1.0])]
            sets.append(sorted({*keep.tolist(), *rng.integers(4000, 8000, rng.integers(0, 4)).tolist()}))
    rows = [(i, i // 2, s) for i, s in enumerate(sets)]
    got = {tuple(sorted(p)) for p in near_texts.candidates(spark.createDataFrame(rows, "node long, part long, hashes array<long>")).collect()}
    held = [set(s) for s in sets]
    true = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if i // 2 != j // 2 and held[i] and held[j] and len(held[i] & held[j]) * 5 >= len(held[i] | held[j]) * 4
    }
    assert len(true) > 100 and true <= got


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    rows = []
    for i in range(900):
        vector = centres[i % 60] + rng.standard_normal(32) * (0.1 if i % 3 else 0.14)
        rows.append((i, [float(np.float32(x)) for x in vector], int(i % 60 % 4)))
    rows += [(1000, rows[7][1], rows[7][2]), (1001, rows[7][1], None), (1002, None, 1), (1003, [0.0] * 32, 1), (1004, [], 1),
             (1005, [float("nan")] + [1.0] * 31, 1), (1006, [None] + [1.0] * 31, 1), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), (7, rows[7][1], rows[7][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: [] for i, _, _ in rows}
    links = 0
    for x, (i, v, label) in enumerate(usable):
        for j, w, other in usable[:x]:
            if len(v) == len(w) and label == other and float(v @ w) >= 0.98:
                links += 1
                near[i].append(j)
                near[j].append(i)
    for tile in (2048, 3):
        got = cap_filters.near_vectors(frame, tile=tile).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got) / 2
        assert 0.99 * links <= found <= links
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
        assert {r.n_links for r in got if 1001 <= r.vec_id <= 1006} == {0}
        # Per vector: never more links than there are, and components only along them.
        assert all(r.n_links <= len(near[r.vec_id]) for r in got)
        group = {}
        for i in sorted(near):
            queue = [i] if i not in group else []
            while queue:
                at = queue.pop()
                if at not in group:
                    group[at] = i
                    queue += near[at]
        assert sum(r.component_id == group[r.vec_id] for r in got) >= 0.99 * len(got)
        assert all(r.component_id >= group[r.vec_id] for r in got)
    assert cap_filters.near_vectors(spark.createDataFrame([], frame.schema)).collect() == []


@pytest.mark.parametrize("vectors, dims", [(10_000, 32), (51_282, 64), (1_000_000, 64), (1_000_000, 384)])
def test_pairs_at_098_share_a_filter(vectors, dims):
    rng = np.random.default_rng(8)
    x, z = rng.standard_normal((2, 2000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    words = cap_filters.code_words(vectors)
    one, two = (cap_filters.decode(v, words, cap_filters.FILTERS_PER_VECTOR) for v in (x, 0.98 * x + math.sqrt(1 - 0.98**2) * z))
    assert (one[:, :, None] == two[:, None, :]).any((1, 2)).mean() >= 0.99


def test_list_decoding_finds_the_largest_products():
    vectors = np.random.default_rng(7).standard_normal((9, 20))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    at, scores = 0, np.zeros((9, 1))
    for block in cap_filters.code(20, 9):
        scores = (scores[:, :, None] + (vectors[:, at : at + block.shape[1]] @ block.T)[:, None, :]).reshape(9, -1)
        at += block.shape[1]
    for k in (1, 16, 700):
        assert (cap_filters.decode(vectors, 9, k) == np.sort(np.argsort(-scores, axis=1)[:, :k], axis=1)).all()


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_texts(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", article)]
        assert got[page.page_id].text == "\n".join(part for part in parts if part)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>a &amp; b<p>c<"), (2, "u", "<div><p>" * 3000 + "deep")]
    texts = [r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert texts == ["", "", "a & b\nc<", "deep"]
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_text_without_article_element():
    page = """<body><div class="menu"><a href=a>Home</a></div><div id=content><h2>Title &ndash; x</h2><p>One, two
      three. Four five, six; seven.<p>Eight <b>nine</b> ten, eleven.</div><div class="comments"><p>Nice post, really.</p></div>
      <ul><li><a href=x>About</a><li><a href=y>Contact</a></ul><form>Name<input></form><div class="cookie-notice">We use cookies.</div>"""
    assert html_text.main_text(page) == "Title – x\nOne, two three. Four five, six; seven.\nEight nine ten, eleven."


PARAGRAPHS = [f"Real text number {i}, with commas, that goes on; and on for a good while, until it ends at last." for i in range(6)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


def test_main_text_is_chosen_by_ratios_beside_article_elements():
    cards = "".join(f"<article><h3>Teaser {i}</h3><p>Short teaser {i}</p></article>" for i in range(3))
    page = f"<body><div><h1>Title</h1>{ARTICLE}</div><div>{cards}</div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *PARAGRAPHS])
    page = (
        f"<body><main><div>We use data files</div><h1>Title</h1>{ARTICLE}<ul><li>An item</li></ul>"
        "<div><span>Buy now</span></div><section><div>ok thanks</div></section></main></body>"
    )
    assert html_text.main_text(page) == "\n".join(["Title", *PARAGRAPHS, "An item"])


@pytest.mark.parametrize(
    "tag", ["div class='has-sidebar'", "div class='no-sidebar'", "div class='sidebar-right'", "div id='nav-fixed'",
            "div class='menu-open'", "div class='page-banner content'", "div class='legal'", "form action='x'", "header"],
)
def test_main_text_keeps_wrappers_of_most_text(tag):
    inner = f"<div class='sidebar'><p>Aside, more.</p></div><div class='content'><h1>Title</h1>{ARTICLE}</div>"
    page = f"<body><{tag}>{inner}</{tag.split()[0]}><div class='menu'>Menu, here.</div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *PARAGRAPHS])


@pytest.mark.parametrize(
    "attributes", ["class='overflow-hidden'", "data-x='not hidden'", 'data-hidden="true" title="display: none"', "hidden=false", "aria-hidden='false'"]
)
def test_main_text_keeps_what_only_speaks_of_hiding(attributes):
    page = f"<body><div class='menu'>Menu, here.</div><article {attributes}><h1>Title</h1>{ARTICLE}</article></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *PARAGRAPHS])


@pytest.mark.parametrize("attributes", ["hidden", "class='x' hidden=''", 'style="color: red; display:none"', "aria-hidden='true'", "id=a hidden/"])
def test_main_text_leaves_out_what_is_hidden(attributes):
    page = f"<body><article><h1>Title</h1>{ARTICLE}<div {attributes}><p>Not, to be read. Never, at all.</p></div></article></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *PARAGRAPHS])


@pytest.mark.parametrize("tag", ["div class='comments'", "section id='comments'", "div class='comment-list'"])
@pytest.mark.parametrize("inside", [True, False])
def test_main_text_leaves_out_many_comments(tag, inside):
    said = "".join(f"<p>Reader {i} says, at some length, that this was good. And more, too.</p>" for i in range(40))
    comments = f"<{tag}><h2>Comments</h2>{said}</{tag.split()[0]}>"
    for name in ("article", "div class='content'"):
        end = f"</{name.split()[0]}>"
        page = f"<body><{name}><h1>Title</h1>{ARTICLE}{comments + end if inside else end + comments}</body>"
        assert html_text.main_text(page) == "\n".join(["Title", *PARAGRAPHS])


def test_main_text_keeps_a_page_wrapped_as_comments():
    page = f"<body><div class='has-comments'><h1>Title</h1>{ARTICLE}</div><div class='menu'>Menu, here.</div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *PARAGRAPHS])


def test_repeated_bytes_of_ids_with_several_texts(spark):
    """Rows of one id, or without id, that differ in text and length are documents of their own."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400)]
    long = " ".join(words)
    rows = [(7, long), (7, long[1000:1400]), (7, "short"), (None, long[200:700] + "x"), (None, None), (None, long[:150]), (9, long[300:900]), (8, long[1390:1600]), (7, long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for cover in ("difference", "content"):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeated_bytes.without_repeats(frame, cover=cover).collect()]
        assert sorted(str(g[:2]) for g in got) == sorted(str((d, len(t or ""))) for d, t in rows)
        by = {(d, n): removed for d, n, removed, _ in got}
        assert by[9, 600] == 600 and by[8, 210] == 210 and by[7, 5] == 0
        # A null id comes first: its texts stay but for what another of them holds.
        assert by[None, 501] + by[None, 150] in (0, 0) or by[None, 150] == 0
        assert sum(n - r for _, n, r, _ in got) >= len(long)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    expected = con.execute(CHECKS[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    got, expected = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert got.equals(expected.astype(got.dtypes.to_dict()))


def test_source_mix_equals_its_sql_where_caps_bind(spark):
    """A small source of short texts: shards win more than they may take and hand it on."""
    import duckdb

    rows = [(i, " ".join(["w"] * (3 + i % 9)), "a" if i % 40 else "b") for i in range(4000)] + [(9000 + i, "one two", None) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).toPandas()
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    expected = con.execute(CHECKS["op2_source_mix"]).df()
    columns = sorted(got.columns)
    got, expected = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert got.equals(expected.astype(got.dtypes.to_dict()))
    assert (got.groupby("source_size").taken.sum() >= 0.99 * got.groupby("source_size").target.first()).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as corpus

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus.STAGES[:-1]:
        after = corpus.stored(stage(spark, before, SF))
        assert after.columns == docs.columns, name
        if name == "toxicity":
            scores = toxicity.toxicity_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scores if not r.predicted)
        if name == "line_templates":
            assert after.count() == before.count()
        if name == "simhash":
            sets = {r.doc_id: set(near_texts.shingles(r.text or "").tolist()) for r in before.collect()}
            ids = sorted(sets)
            group = brute_components(ids, lambda a, b: len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4)
            kept = {}
            for g, d in zip(group, ids, strict=True):
                kept.setdefault(g, d)
            assert sorted(r.doc_id for r in after.collect()) == sorted(kept.values())
        before = after
    pieces = corpus.packing(spark, before, SF).collect()
    assert sum(r.length for r in pieces) == sum(
        len(library_word().encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()
    )
    assert len(corpus.run(spark, SF).collect()) == len(pieces)


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """Every file that an executor writes to a local folder starts a process beside it."""
    from posolog.llm import graph

    files = []

    def counted(df):
        out = stored(df)
        files.append(len(out.inputFiles()))
        return out

    stored = graph.stored
    monkeypatch.setattr(graph, "stored", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 2000) for i in range(300)]
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys([*range(1000, 1300), 2000], 1000)}
    assert len(files) > 2 and set(files[1:]) == {1}
