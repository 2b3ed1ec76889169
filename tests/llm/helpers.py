"""Small fixtures shared by the tests of the corpus operators."""

import random

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))

#: (doc_id, text, lang): nulls, empty, white space, ties, repeated rows, a very long text, other scripts.
EDGE = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, "one two three", "en"), (6, LONG, "en"), (7, LONG, "en"),
    (8, "naïve café — façade 😀 日本語", "fr"), (9, "Plain words stand here, and more of them follow.", "en"), (9, "Plain words stand here, and more of them follow.", "en"),
    (10, "1234 5678 !!! ???", None), (11, "\x00\x1c odd \x85 signs ​ here", "en"),
]


def edge_docs(spark, clash=()):
    """The edge rows, with columns of clashing names."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string")
    for name in clash:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def random_docs(n, seed=1, vocabulary=400):
    """Texts with exact copies, near copies and shared openings."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append((i, rng.choice(out)[1]))
        elif out and kind < 0.4:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(1, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))))
    return out
