"""Blocks of bytes: texts without grams, short strings that recur, and the places of a row."""

from __future__ import annotations

import random

import brute
import numpy as np

from folioflow.llm import suffix_dedup, windows

SCHEMA = "doc_id long, text string"
SPEC = windows.Bytes(suffix_dedup.WINDOW, suffix_dedup.EVERY)


def say(rng, k):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(k))


def test_texts_without_grams(spark):
    """Junk of one repeated word has no trigger or few: it equals brute force, alone in a table too, in few blocks."""
    rng = random.Random(3)
    docs = [(i, w * k) for i, (w, k) in enumerate([("the ", 100), ("the ", 101), ("the ", 1500), ("Oure ", 80), ("Oure ", 79), ("Reanwh ", 400), ("a", 400), ("a", 399), ("b", 402)])]
    docs += [(20, "Oure " * 30 + "the " * 300), (21, "x" + "the " * 104), (22, None)]
    for some in (docs, docs + [(30 + i, f"{say(rng, 90)} {docs[i][1]} {say(rng, 90)}") for i in range(9)]):
        for hot in (4096, 2):
            found = suffix_dedup.remove_bytes(suffix_dedup.duplicate_bytes(spark.createDataFrame(some, SCHEMA), hot=hot))
            got = sorted((tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
            assert got == sorted(brute.op5(some), key=repr)
    symbols = np.frombuffer(b"Oure " * 2000, dtype=np.uint8)
    start, n, _ = windows.blocks(SPEC, symbols, np.array([0, len(symbols)]))
    assert n.sum() == len(symbols) - 399 and len(n) <= n.sum() / 5 + 2


def test_windows_are_in_one_block_each():
    rng = random.Random(4)
    for _ in range(20):
        pieces = [(say(rng, rng.randint(1, 300)) + " go" * rng.choice([0, 0, 300])).encode() for _ in range(4)]
        symbols, bounds = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum([0, *map(len, pieces)])
        start, n, key = windows.blocks(SPEC, symbols, bounds)
        got = sorted(w for s, k in zip(start.tolist(), n.tolist()) for w in range(s, s + k))
        assert got == [w for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for w in range(lo, hi - 399)]


def test_short_strings_that_recur_make_no_candidates(spark):
    """A gram in 40 texts without a common window: at most the two blocks of a gram that a longer one comes between."""
    rng = random.Random(6)
    phrase = say(rng, 30)[:160]
    docs = spark.createDataFrame([(i, f"{say(rng, 120)} {phrase} {say(rng, 120)}") for i in range(40)], SCHEMA)
    keyed = docs.select(*windows.row_key("doc_id", "text"), "text")
    repeated, hot, most = windows.count_grams(SPEC, keyed, windows.HOT)
    assert len(windows.triggers(np.frombuffer(phrase.encode(), dtype=np.uint8), SPEC.every)) > 1
    assert most <= 2 and windows.candidate_blocks(SPEC, keyed, (repeated, hot), 1).count() <= 4


def test_places_that_cover_the_same():
    rng = random.Random(7)
    for _ in range(50):
        places = np.unique(np.array([(rng.randrange(2), rng.randrange(2), rng.randrange(300)) for _ in range(rng.randint(1, 60))], dtype=windows.PLACE))
        covered = lambda some: {(a, b, c + i) for a, b, c in some.tolist() for i in range(20)}
        assert covered(windows._thinned(places, 20)) == covered(places)
    run = np.array([(1, 1, 5 * i) for i in range(1000)], dtype=windows.PLACE)
    assert len(windows._thinned(run, 404)) < 20
