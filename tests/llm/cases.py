"""Small tables that the tests of several operators share."""

from pyspark.sql import functions as F

#: Texts that are null, empty, blank, tied, repeated, very long or full of odd characters.
ODD = [
    (1, "One two three four five six seven"), (2, "one TWO three four five six seven"), (2, "one TWO three four five six seven"),
    (3, None), (4, ""), (5, "  \t\n\x0b "), (None, "One two three four five six seven"), (None, None),
    (6, "é È ß 漢字 \U0001f600 İ"), (7, "word " * 30_000), (8, "x" * 200_000), (9, "\n\n\nshort\n"), (10, "12345 !!! ..."),
]


def odd_documents(spark):
    """ODD as documents with extra columns, among them names that operators use themselves."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({
        "lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return rows.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING)})


CLASHING = ("size shard slot place score n digest kept rate copies p id key row n_lines kept_text lang_pred raw "
            "words tokens domain number part map_id mix_own own_id sample_id c0 body").split()


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def lowered(text):
    return (text or "").encode().lower().decode()
