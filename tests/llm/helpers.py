import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, as further columns of an input.
CLASHING = ("_id", "_text", "block", "bucket", "shard", "slot", "_sha", "_keep", "component", "rep", "node", "h1", "_docs", "id", "label", "score", "kept", "size")


def docs(spark, rows):
    """rows: (doc_id, text)"""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "very long text " * 20_000
    rows = [
        (1, "same words here in a row of five or more", "en"), (2, "same words here in a row of five or more", None), (2, "same words here in a row of five or more", None),
        (3, "", "en"), (4, None, "en"), (5, None, None), (None, "an id is missing from this row of words", "en"), (None, None, None), (6, long, "en"), (7, long, "en"), (8, " \n\t ", "en"), (9, "x", "en"), (9, "y", "en"),
    ]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, lang, *(["z"] * len(CLASHING))) for i, t, lang in rows], f"doc_id long, text string, lang string, {names}")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
