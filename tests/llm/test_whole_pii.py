"""Identifiers that only contexts found on the way lead to."""

from pyspark.sql import functions as F

from parterre.llm import pii


def spans_of(spark, rows):
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", pii.span_text(F.col("base")).alias("base"), pii.span_text(F.col("spans")).alias("spans")).collect()
    return {r.doc_id: (r.base, r.spans) for r in found}


def test_second_hop(spark):
    """Seeds lead to agents; only those lead to the second context, which no seed stands in."""
    first = [(k, f"please contact agent ann{k}@mail.example.com today about w") for k in range(30)]
    bridge = [(100 + k, f"please contact agent bob{k}(at)mail{k} today about it") for k in range(8)]
    second = [(200 + k, f"orders placed via bob{k}(at)mail{k} yesterday were late") for k in range(8)]
    far = [(300 + k, f"orders placed via eve{k}(at)mail{k} yesterday were late") for k in range(3)]
    other = [(400 + k, f"the number {k}x{k} was {k}y in all") for k in range(40)]
    got = spans_of(spark, first + bridge + second + far + other)
    for i, text in bridge + second + far:
        at = text.index("bob" if "bob" in text else "eve")
        assert got[i] == ("", f"email:{at}:{text.index(' ', at)}")
    assert all(got[i][0] == got[i][1] for i, _ in first + other)
