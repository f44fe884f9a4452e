from folioflow.operators import fidelity


def test_report_stays_with_its_row(spark):
    """Nothing is shuffled, and rows of one id or of none have each their own tokens."""
    rows = [(1, "one two three 4.5", "one three"), (1, "six seven", "six seven"), (None, "eight 9", "nine"), (2, None, None)]
    found = fidelity.report(spark.createDataFrame(rows, "doc_id long, compiled string, converted string"))
    assert "Exchange" not in found._jdf.queryExecution().toString()
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_missing"], r["n_missing_numbers"], r["verdict"]) for r in found.collect())
    assert got == [(0, 2, 2, 1, "FLAG"), (1, 2, 0, 0, "OK"), (1, 4, 2, 1, "FLAG"), (2, 0, 0, 0, "OK")]
