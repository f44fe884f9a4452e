"""The first step of the near-duplicate stage: SimHash and its one-wildcard variants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_copies import SCHEMA, five_words, near

from folioflow.llm import near_copies


def components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [2048, 2])
def test_near_prints_connect_all_within_seven_bits(spark, bucket):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints for k in (1, 5, 7, 8)] + [0, (1 << 64) - 1]
    prints = list(dict.fromkeys(prints))
    links = near_copies.near_prints(spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long"), bucket).collect()
    at = {p - (p >> 63 << 64): i for i, p in enumerate(prints)}
    want = components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 7])
    got = components(len(prints), [(at[r["a"]], at[r["b"]]) for r in links])
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_variants_alone_link_what_lies_within_their_bits(spark, monkeypatch):
    """Without any band, similar texts of near fingerprints are still linked; before, all links came from bands."""
    monkeypatch.setattr(near_copies, "_first_of_band", lambda keyed: keyed.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    docs = near(8)
    sets = [five_words(t) for _, t in docs]
    prints = [near_copies.majority(s) if len(s := near_copies.shingles((t or "").encode())) else None for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i)]
    family = components(len(docs), [(i, j) for i, j in pairs if None not in (prints[i], prints[j]) and (prints[i] ^ prints[j]).bit_count() <= 7])
    similar = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = components(len(docs), [(i, j) for i, j in pairs if sets[i] == sets[j] or family[i] == family[j] and similar(i, j)])
    equal = components(len(docs), [(i, j) for i, j in pairs if sets[i] == sets[j]])
    assert len(set(want)) < len(set(equal)) - 10
    least = {}
    for r, (d, _) in zip(want, docs):
        least[r] = min(least.get(r, d), d)
    got = near_copies.keep_one_similar(spark.createDataFrame(docs, SCHEMA))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())


def test_fingerprint_is_the_majority_of_hashes():
    h = np.array([0b011, 0b001, 0b101], dtype=np.uint64)
    assert near_copies.majority(h) == 0b001 and near_copies.majority(h[:2]) == 0b001 and near_copies.majority(h[:1]) == 0b011
