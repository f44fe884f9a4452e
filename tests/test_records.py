"""The planted cases of the record, graph and source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import graph, records
from folioflow.sources import bibliography
from folioflow.streaming import incremental


def test_doi_variants(spark):
    given = ["https://doi.org/10.1000/X1.", "10.1000/x1", "http://doi.org/10.1000/x1/", "https://dx.doi.org/10.1000/x1"]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in given], "d string").select(records.norm_doi(F.col("d"))).collect()]
    assert found[:3] == ["10.1000/x1"] * 3 and found[3] != "10.1000/x1"


def test_winner_is_published_then_richest(spark):
    rows = [(1, "NBER Working Paper", "x" * 500, "10.1/a", "s1"), (2, "Journal", "x" * 10, "10.1/A", "s2"), (3, "Journal", "x" * 200, "https://doi.org/10.1/a", "s1"), (4, "Journal", "", "", "s3")]
    found = {r["doi_key"]: r for r in records.doi_groups(spark.createDataFrame(rows, "doc_id long, journal string, abstract string, doi string, source string")).collect()}
    assert found["10.1/a"]["winner"] == 3 and found["10.1/a"]["sources"] == "s1,s2" and found["#4"]["winner"] == 4


def test_null_dois_and_abstracts(spark):
    rows = [(1, None, None, None, "s1"), (2, None, None, None, "s2"), (3, "J", None, "10.1/b", "s1"), (4, None, "long enough", "10.1/B", None), (5, "J", "x", " ", "s1"), (6, "J", "x", "https://doi.org/", "s1")]
    found = {r["doi_key"]: r for r in records.doi_groups(spark.createDataFrame(rows, "doc_id long, journal string, abstract string, doi string, source string")).collect()}
    assert set(found) == {"#1", "#2", "10.1/b", "#5", "#6"} and all(found[k]["n_records"] == 1 for k in ("#1", "#2", "#5"))
    assert found["10.1/b"]["winner"] == 4 and found["10.1/b"]["sources"] == "s1"
    assert records.doi_groups(spark.createDataFrame([], "doc_id long, journal string, abstract string, doi string, source string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 500), (700, 700), (None, 3)]
    found = dict(graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(found[i] == 1 for i in range(1, 201)) and found[501] == 500 and found[700] == 700 and len(found) == 203
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_verdicts(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "i long, j long")
    given = spark.createDataFrame([(1, 0, "no", 1), (1, 0, "yes", 2), (5, 5, "yes", 3), (0, 99, "yes", 4)], "a long, b long, verdict string, ord int")
    assert {(r["i"], r["j"]): r["verdict"] for r in records.verdict_join(pairs, given).collect()} == {(0, 1): "yes", (1, 2): "no", (0, 2): "no"}


def test_verdicts_on_awkward_pairs(spark):
    rows = [(1, ["a", "b"], ["smith"]), (2, ["x", "y"], ["doe", "smith"]), (3, ["a", "b", "c"], ["roe"]), (4, None, None), (5, ["q"], []), (6, [], ["roe"])]
    works = spark.createDataFrame(rows, "id long, words array<string>, names array<string>")
    given = [(2, 1, "yes", 1), (1, 3, "no", 1), (3, 1, "yes", 2), (2, 3, "yes", 1), (4, 5, "yes", 1), (1, 1, "yes", 1), (1, 99, "yes", 1), (None, 1, "yes", 1), (3, 6, None, 1)]
    verdicts = spark.createDataFrame(given, "a long, b long, verdict string, ord int")
    found = {(r["i"], r["j"]): r["verdict"] for r in records.allowed_verdicts(works, verdicts).collect()}
    assert found == {(1, 2): "yes", (1, 3): "yes", (3, 6): None}  # by surname, by title (the last verdict), by surname
    assert records.allowed_verdicts(works, verdicts.where("false")).count() == records.allowed_verdicts(works.where("false"), verdicts).count() == 0


def test_first_links_keep_the_classes(spark):
    rows = [(3, ["a", "b"]), (1, ["a"]), (2, ["b", "b", None]), (2, ["b"]), (4, None), (5, []), (6, ["c"]), (7, ["a", "b"])]
    found = {tuple(r) for r in records.first_links(spark.createDataFrame(rows, "id long, ks array<string>"), "id", "ks").collect()}
    assert found == {("a", 1, 3), ("a", 1, 7), ("b", 2, 3), ("b", 2, 7)}


def test_audit_status(spark):
    entries = spark.createDataFrame([(1, ["a", "study", "of", "widgets"]), (2, ["other", "study", "x", "y"]), (3, ["none"])], "id long, words array<string>")
    index = spark.createDataFrame([(9, ["a", "study", "of", "widgets"])], "id long, words array<string>")
    assert {r["id"]: r["status"] for r in records.audit_status(entries, index).collect()} == {1: "verified", 2: "hallucinated", 3: "unverified"}


def test_garbled_runs(spark):
    lines = ["A long sentence that stays where it is, of course."] + ["(d)", "a", "", "b", "{3 *", "xx", "yyy"] + ["Another long sentence that also stays here."] + ["Ann", "Bob", "Eve"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    kept = [r["line"] for r in records.garbled_runs(df, F.length("line") <= 26, F.length("line") <= 3, F.trim("line") == "").orderBy("line_no").collect()]
    assert kept == [lines[0], lines[8], "Ann", "Bob", "Eve"]


def test_ris_and_bibtex_text(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - One\nAU  - A, B\nAU  - C, D\nPY  - 2020\nER  - \nTY  - RPRT\nTI  - Two\nER  - \n")
    found = bibliography.read_ris(spark, f"file://{tmp_path}/a.ris").collect()
    assert [(r["type"], r["title"], r["authors"], r["doi"]) for r in found] == [("JOUR", "One", "A, B; C, D", ""), ("RPRT", "Two", "", "")]
    (tmp_path / "a.bib").write_text('@article{smith2020, title = {On Widgets}, author="Smith, A", year = 2020}\n@techreport{jones,\n  title={T},\n  doi = {10.1/x}\n}\n')
    found = bibliography.read_bibtex(spark, f"file://{tmp_path}/a.bib").collect()
    assert [(r["entry_type"], r["cite_key"], r["title"], r["year"], r["doi"]) for r in found] == [("article", "smith2020", "On Widgets", "2020", ""), ("techreport", "jones", "T", "", "10.1/x")]


def test_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows.write.parquet(f"file://{tmp_path}/in/1")
    run = lambda: incremental.checkpointed_append(incremental.stream_files(spark, f"file://{tmp_path}/in/*", rows.schema), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    run()
    run()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_similar_pairs_against_all(spark):
    import random

    rng = random.Random(5)
    sets = [sorted({f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(0, 12))}) for _ in range(150)] + [["x"], ["x"], []]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, ws array<string>")
    classes, members = records.word_classes(df, "id", "ws")
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(tuple(s), i)
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) > 0.4}
    assert {tuple(r) for r in records.similar_pairs(classes).collect()} == want and len(want) > 50
    assert {tuple(r) for r in members.collect()} == {(first[tuple(s)], i) for i, s in enumerate(sets) if s and first[tuple(s)] != i}
    assert records.similar_pairs(classes.where("false")).count() == 0


def test_first_of_either_key(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["", None, *(f"d{k}" for k in range(40))]), rng.choice(["", *(f"t{k}" for k in range(60))])) for i in range(200)]
    seen, want = set(), []
    for i, d, t in rows:
        keys = {("d", d), ("t", t)} - {("d", ""), ("d", None), ("t", "")}
        if not keys & seen:
            seen |= keys
            want.append(i)
    df = spark.createDataFrame(rows, "o long, d string, t string")
    assert sorted(r["o"] for r in records.first_of_either_key(df, "o", ["d", "t"]).collect()) == want
    assert records.first_of_either_key(df.where("false"), "o", ["d", "t"]).count() == 0


def shuffled(spark, run):
    """Records that the stages of ``run`` put into shuffles."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def total():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_similar_pairs_travel_in_proportion(spark):
    """Sets that share words but are not similar are met and left where they meet: four times the rows, four times the shuffle."""
    import random

    rng = random.Random(7)
    rows = [(i, [f"v{w}" for w in sorted(rng.sample(range(80), rng.randrange(15, 25)))]) for i in range(800)]
    rows += [(1000 + i, ws[1:] + [f"x{i}"]) for i, ws in rows[:40]]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) > 0.4}
    taken = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    for part in (rows[:200], rows):
        classes, _ = records.word_classes(spark.createDataFrame(part, "id long, ws array<string>"), "id", "ws")
        held = []
        taken.append(shuffled(spark, lambda: held.extend(tuple(r) for r in records.similar_pairs(classes).collect())))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(held) == want and len(held) == len(want) >= 40
    assert taken[1] < 5 * taken[0]


def test_titles_are_paired_once_for_verdicts(spark, monkeypatch):
    """verdict_merge takes its links and its verdicts from one table of similar titles."""
    from folioflow.plans import records as plans

    calls, similar = [], records.similar_pairs
    monkeypatch.setattr(records, "similar_pairs", lambda *a: calls.append(1) or similar(*a))
    plans.verdict_merge(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
