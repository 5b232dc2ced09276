"""Tables of odd rows that every operator must get through."""

LONG = ("lorem ipsum dolor " * 20_000).strip()


def odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns whose names clash with added ones."""
    rows = [
        (1, "one two three four five six", "en", 9), (1, "one two three four five six", "en", 9), (2, None, None, None), (None, "a b c d e f g h", "en", 1), (3, "", "en", 1), (4, " \t\n ", "en", 1), (5, LONG, "en", 1),
        (6, "\x00 null byte ퟿ \U0001f600", None, 2), (None, None, None, None), (7, "one two three four five six", "fr", 3),
    ]
    names = "doc_id long, text string, lang string, score int"
    return spark.createDataFrame(rows, names).selectExpr("*", "lang as FP", "score as predicted", "lang as digest", "lang as kept", "lang as sequence_id", "score as n_words", "lang as part", "lang as local", "lang as component_id")


def no_documents(spark):
    return odd_documents(spark).limit(0)
