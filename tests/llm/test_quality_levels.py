"""Which estimate judges the documents of small sources and languages."""

from __future__ import annotations

import random

from folioflow.llm import quality


def test_small_sources_are_judged_by_their_language(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word("etaoin") for _ in range(120)) + "."
    bad = lambda: " ".join(word("ETAOIN") + "$$$" for _ in range(120))
    docs = [(i, good(), "de", "large") for i in range(200)] + [(1000 + i, good(), "de", "small") for i in range(10)] + [(1100, bad(), "de", "small"), (1101, "few words", "de", "small")]
    docs += [(1200 + i, good(), "xx", "tiny") for i in range(3)] + [(1300, bad(), "xx", "tiny"), (1301, good(), None, None), (1302, good(), "de", "")]
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert len(found) == len(docs)
    assert all((r["distance"] is None) == r["base_failed"] for r in found.values())
    assert sorted(i for i, r in found.items() if not r["kept"]) == [1100, 1101, 1300]


def test_estimates_are_drawn_without_a_switch(spark):
    """The distance of one document as its source grows: no jump where one estimate gives way to another."""
    rng = random.Random(5)
    text = lambda letters, end="": " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) + end for _ in range(120))
    common = [(i, text("etaoin"), "en", "large") for i in range(300)]
    odd = [(2000 + i, text("etaoinETAOIN", ","), "en", "own") for i in range(90)]
    distances = []
    for n in (1, 59, 60, 61, 90):
        found = quality.judge(spark.createDataFrame(common + odd[:n], "doc_id long, text string, lang string, source string"))
        distances.append(found.where("doc_id = 2000").first()["distance"])
    near = distances[1:4]
    assert max(near) < 1.5 * min(near) and distances[0] > distances[-1]
