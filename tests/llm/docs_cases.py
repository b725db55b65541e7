"""Documents every operator must survive: nulls, empty and long texts, ties, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, "the same words in the same order here again", "en", None, 5),
    (4, "the same words in the same order here again", "en", "b", 5),
    (5, "the  same words\tin the same order here again", "en", "b", 5),
    (6, "word " * 30000, "de", "c", 1),
    (7, "x" * 20000, "de", "c", 1),
    (8, "é ü \U0001f600 mail ann.b@mail.example.com, +1 (499) 555-6503 and 10.0.0.255", "fr", "c", 1),
    (9, "card 4111 1111 1111 1111 or 4111-1111-1111-1112; 300.1.1.1.5.6.7.8 1.2.3.4.5.6.7.8", "fr", "c", 1),
    (None, "no id but a text", "fr", "c", 1),
    (10, " \t\n\r ", "fr", "c", 1),
    (10, "one id twice", "fr", "c", 1),
    (10, "one id twice", "fr", "c", 1),
]


def documents(spark, rows=ROWS):
    """With extra columns whose names operators may use inside."""
    from pyspark.sql import functions as F

    extra = {k: F.lit("extra") for k in ("salt", "digest", "norm", "size", "label", "kept", "spans", "fp", "words", "key")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)
