"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(40_000))
CLASH = ("words", "hs", "lines", "row", "kept", "spans", "label", "component", "node", "seed", "found", "mask", "value", "score")


def frame(spark, rows):
    """(doc_id, text) rows as a table with further columns whose names operators use inside."""
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, None, None, 0, *["z"] * len(CLASH)) for i, t in rows],
                                 f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


EDGE = [(1, None), (2, ""), (3, " \t\n "), (None, "a row without an id"), (4, "one"), (5, "one"), (5, "one"),
        (6, LONG), (7, LONG), (8, "é ß 漢字 \x00 tab\tend")]
