"""Substring deduplication against brute force, and at its edges."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substrings


def brute(rows, window=50):
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, words in split:
        for p in range(len(words) - window + 1) if i is not None else []:
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - window + 1) if i is not None else []:
            if first[tuple(words[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, window=50):
    return sorted((tuple(r) for r in substrings.repeats(df, window).collect()), key=str)


def texts(seed, n=120, window=50):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["naïve", "É", "😀", "a b", "a b"]

    def words(k):
        return [r.choice(vocabulary) for _ in range(k)]

    hot, others = words(window + 11), [words(window + r.randrange(0, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(n):
        body = words(r.randrange(0, 4 * window))
        for passage in ([hot] if i % 3 == 0 else []) + ([r.choice(others)] if r.random() < 0.5 else []):
            a, b = sorted((r.randrange(len(passage)), r.randrange(len(passage) + 1)))
            part = passage if r.random() < 0.6 else passage[a:b]
            at = r.randrange(len(body) + 1)
            body[at:at] = part
        rows.append((i, r.choice([" ", "\n", "\t "]).join(body)))
    rows += [(n + i, rows[5 * i][1]) for i in range(20)]  # whole copies
    rows += [(n + 20 + i, " ".join(rows[5 * i][1].split()[3:])) for i in range(20)]  # and all but their first words
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "window"), [(1, 50), (2, 8), (3, 2)])
def test_equals_brute_force(spark, seed, window):
    rows = texts(seed, window=window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(df, window)
    assert got == brute(rows, window)
    assert sum(r[2] for r in got) > 100


def test_lengths_about_the_window(spark):
    words = [f"x{i}" for i in range(120)]
    rows = [(i, " ".join(words[a:b])) for i, (a, b) in enumerate([(0, 120), (0, 49), (0, 50), (1, 51), (35, 84), (35, 85), (70, 120), (71, 120), (24, 74)])]
    # In every place against the blocks.
    rows += [(100 + k, " ".join([f"y{k}"] * k + words[13 : 13 + 50] + ["z"])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df)
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] in (1, 4, 7)] == [0, 0, 0]
    # Those after the first share its last word as well.
    assert [r[2] for r in got if r[0] >= 100] == [50] + [51] * 59


def test_runs_of_one_word_and_own_repeats(spark):
    rows = [(3, "a " * 200), (2, "a " * 60), (1, "b " * 70 + "a " * 55), (5, "c d " * 100), (6, "d c " * 40), (7, "q " * 50 + "a " * 49 + "q"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_awkward_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == brute(rows)
    assert substrings.repeats(nothing).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert substrings.repeats(nothing).count() == 0


def test_shared_and_null_ids(spark):
    long_ = " ".join(f"w{i}" for i in range(80))
    rows = [(4, long_), (4, long_), (4, long_ + " more"), (None, long_), (9, long_.replace(" ", "\n")), (9, "x " + long_), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df)
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] == 4] == [0, 0, 0] and [r[2] for r in got if r[0] is None] == [0]


def test_full_filters_lose_nothing(spark, monkeypatch):
    # One bit set for most keys: the joins alone decide.
    monkeypatch.setattr(substrings, "MOST_BITS", 1 << 15)
    rows = texts(7)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_filter_holds_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    known = substrings.key_filter(spark, spark.createDataFrame([(int(k),) for k in keys], "h long"), len(keys)).value
    assert substrings.held(known, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 2**63 - 1, 5000).astype(np.uint64)
    assert substrings.held(known, other).mean() < 0.05
    assert not substrings.held(substrings.key_filter(spark, spark.createDataFrame([], "h long"), 0).value, other).any()


def test_words_and_their_hashes():
    texts = [b" one  two\tthree\x0b", None, b"", b"two", b"o" * 64 + b" " + b"o" * 65, b"\x1cone \xc2\xa0x", b"\r\n", b"x" * 300]
    column = pa.array([b"skipped", *texts], pa.binary()).slice(1)
    data, starts, stops, edges = substrings.word_places(column)
    found = [bytes(data[a:b]) for a, b in zip(starts, stops, strict=True)]
    split = [(t or b"").split() for t in texts]
    assert found == [w for own in split for w in own]
    assert edges.tolist() == np.cumsum([0, *map(len, split)]).tolist()
    h = substrings.word_hashes(data, starts, stops)
    keys = {}
    for w, x in zip(found, h.tolist(), strict=True):
        assert keys.setdefault(w, x) == x
    assert len({tuple(x) for x in keys.values()}) == len(keys) and len({x[0] for x in keys.values()}) == len(keys)


def test_word_hashes_keep_words_apart():
    r = random.Random(5)
    words = list({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 30))) for _ in range(60_000)})
    data, starts, stops, _ = substrings.word_places(pa.array([b" ".join(words)], pa.binary()))
    h = substrings.word_hashes(data, starts, stops)
    assert all(len(np.unique(h[:, k])) == len(words) for k in (0, 1))
