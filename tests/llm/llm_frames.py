"""Documents the tests of this folder are made of."""

#: Digits would make words variable fields.
LETTERS = str.maketrans("0123456789", "abcdefghij")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, word string, block int, row int, copy int, a int, size int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own; rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "k", "w", 1, 2, 3, 4, 5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join("w" + str(rng.randrange(vocabulary)).translate(LETTERS) + "x" for _ in range(n))
