"""Small tables for the tests of the text operators."""

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int"


def docs_of(spark, rows):
    """Documents of (doc_id, text) pairs, with a column whose name an operator may add."""
    return spark.createDataFrame(
        [(i, t, "en", f"s{n % 3}", len(t or ""), n) for n, (i, t) in enumerate(rows)], SCHEMA
    )
