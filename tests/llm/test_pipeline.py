"""Each stage of the pipeline, and its whole."""

from __future__ import annotations

import random

import brute
from test_near_copies import kept

import corpus_pipeline
from folioflow.llm import secret_scan

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(f"file://{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
    texts = [{r["doc_id"]: r["text"] for r in x.collect()} for x in seen[:-1]]
    assert all(x.columns == columns for x in seen[:-1])
    assert not any(brute.op8_base(t)[-1] for t in texts[1].values())
    assert sorted(texts[2]) == kept(sorted(texts[1].items()))
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(" ".join(i.split()) in " ".join(t.lower().split()) for t in texts[3].values() for i in items)
    assert set(texts[4]) == set(texts[3])
    # No value that few owners and documents carry is left.
    owner = {r["doc_id"]: r["source"] for r in seen[3].collect()}
    carried: dict[str, tuple[set, set]] = {}
    for i, t in texts[3].items():
        for *_, value in secret_scan.find_base(t.encode(), t):
            owners, documents = carried.setdefault(value, (set(), set()))
            owners.add(owner[i])
            documents.add(i)
    live = [v for v, (owners, documents) in carried.items() if len(owners) <= secret_scan.LIVE_OWNERS and len(documents) <= secret_scan.LIVE_REPOSITORIES]
    assert not any(v in t for v in live for t in texts[4].values())
    assert {r["doc_id"] for r in seen[5].collect()} == set(texts[4])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_awkward_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing names; and no rows at all."""
    rng = random.Random(3)
    say = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(80)) + "."
    texts = [say() for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), "x") for i, t in enumerate(texts)]
    rows += [(None, say(), None, None, None, None), (50, None, "en", "s0", None, "x"), (51, "", None, "s1", 0, "x"), (None, None, None, None, None, None), rows[3], rows[3], (60, texts[4], "en", "s1", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k_id string"
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None), (2, texts[5])] if data else [], "item_id long, text string").write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()
    ids = [r["doc_id"] for r in found]
    assert set(ids) <= {*range(12), None} - {5} and ids.count(3) <= 1 and len(ids) >= 10
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
