"""Near copies of the pipeline's stage against all pairs."""

from __future__ import annotations

import random

import brute
import pytest

import corpus_pipeline
from folioflow.llm import near_copies

SCHEMA = "doc_id long, text string"


def five_words(text):
    w = brute.words_of((text or "").translate(brute.ASCII_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept(docs):
    sets = [five_words(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def near(seed=5):
    rng = random.Random(seed)
    say = lambda k: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(k)]
    docs = [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "one two three")]
    for base in range(12):
        words = say(rng.randint(60, 400))
        for _ in range(10):
            copy = list(words)
            for _ in range(rng.randint(0, len(copy) // 25)):
                copy[rng.randrange(len(copy))] = say(1)[0]
            docs.append((len(docs), " ".join(copy)))
    return docs


@pytest.mark.parametrize("members", [4096, 5])
def test_kept_rows_are_those_of_all_pairs(spark, members):
    docs = near()
    got = near_copies.keep_one_similar(spark.createDataFrame(docs, SCHEMA), members=members)
    assert sorted(r["doc_id"] for r in got.collect()) == kept(docs)


def test_stage_keeps_one_of_texts_with_far_fingerprints(spark):
    docs = near(6)
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert sorted(r["doc_id"] for r in got.collect()) == kept(docs)
