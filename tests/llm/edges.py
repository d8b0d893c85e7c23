"""One table with the awkward cases, for all operators."""

from pyspark.sql import functions as F

PROSE = "It was the best of all the ways in which a person could go on with the work that they had to do, and so it went on for a long time."

TEXTS = [
    (1, None), (2, ""), (3, "   \n\t\n"), (4, PROSE), (5, PROSE), (5, PROSE), (6, "word"), (7, "a b c d"), (8, "é ü ñ " * 20 + "\n" + PROSE), (9, "x" * 200_000), (10, (PROSE + "\n") * 2000),
    (11, "key: \U0001f600\U0001f600 token = \"abcdef0123456789\" mail a.b@c.de and +1 (555) 010-9999 or 10.0.0.255"), (12, "1" * 50_000), (13, "@" * 5000 + "." * 5000), (None, PROSE), (None, None),
    (14, "Licensed under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0."), (15, "a\0b \x0b\x0c\x1c\x85   end"), (16, "\r\n".join([PROSE.upper()] * 3)),
]


def table(spark, clash=()):
    """doc_id and text, with columns whose names operators use themselves."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    names = ["id", "row", "t", "words", "stats", "score", "n_words", "n_lines", "n_dropped", "class_id", "a", "b", "h1", "text_a", "_id", "_lines", "at", "sequence_id", "lang", "total", "verdict", "key", *clash]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names))).repartition(3)


def empty(spark):
    return table(spark).where("false")
