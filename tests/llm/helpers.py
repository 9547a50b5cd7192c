"""Small documents with everything that operators have to bear: nulls, blanks, copies, ties, long texts, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, size string, score double, kept string, rank int"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r + (None, None))[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(i, t, la, so, len(t or ""), "x", 1, "y", 0.5, "z", 7) for i, t, la, so in full], SCHEMA)


def hostile(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[(i * 7 + i // 5) % 12] for i in range(6000))
    return documents(spark, [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, "Same text here for all of us"), (7, "same TEXT here for all of us"),
        (6, "Same text here for all of us"), (None, "no id here"), (8, long), (9, long + " end"), (10, "é ß 日本語 🙂 \u0000 x"), (-11, "Same text here  for all of us")])
