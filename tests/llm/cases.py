"""Tables that every operator must handle: nulls, empty and long texts, ties, repeats, clashing names, no rows."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, fp string, held_out int, piece string"
LONG = ("alpha beta gamma delta. " * 30_000).strip()
ROWS = [
    (1, "One small text about nothing much.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "A text without an id, and so it is.", "en", None, 3),
    (5, "One small text about nothing much.", "en", "a", 1),
    (5, "One small text about nothing much.", "en", "a", 1),
    (6, LONG, "en", "b", len(LONG)),
    (7, " \n\t ", "de", "b", 4),
    (8, "Grüße aus Köln — ½ 日本 <|endoftext|> \x1c \x85 end", "de", "b", 9),
    (9, "x" * 5000, None, "c", 5000),
    (10, "12345 67.8 !!!", "fr", "c", 14),
]


def table(spark, rows=ROWS):
    full = [(*r, 0.5, 77, "clash", 3, "piece") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3, "source")


def empty(spark):
    return table(spark, [])
