"""Small tables with the odd rows that every operator must take: nulls, empties, repeats, clashing names."""

import random
import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(r, n):
    return " ".join("".join(r.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou"], k=r.randint(1, 4))) for _ in range(n))


def odd_rows():
    return [(None, None, None, None, None), (1000, "", "en", None, 0), (1001, None, "en", "s1", 0), (1002, "one", None, "s1", 3), (1003, " \t\n ", "en", "s2", 4), (1004, "x" * 5000, "en", "s0", 5000), (1005, "same text here again now", "en", "s0", 5), (1005, "same text here again now", "en", "s0", 5)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "'clash' AS size", "7 AS n", "'y' AS key", "1.5 AS weight", "'z' AS cid")


def docs(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = [(i, prose(r, r.randint(1, 120)), r.choice(["en", "de"]), f"s{r.choice([0, 0, 1, 2])}", 0) for i in range(n)]
    return rows + odd_rows()
