"""Small tables with every awkward case, and plain versions of shared steps."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, id string, v long, node int, label string, rid int, key double, size string, n int"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randint(0, vocabulary)}" for _ in range(n)]


def awkward_texts():
    rnd = random.Random(7)
    base = words(rnd, 120)
    near = [*base[:60], "other", *base[61:]]
    prose = "The first line ends well. " + " ".join(base[:30]) + "."
    return [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, " ".join(base)), (6, " ".join(base)), (7, " ".join(near)),
        (8, " ".join(base).upper()), (9, "x" * 50_000), (10, " ".join(words(rnd, 30_000))), (None, "a row without an id and some words"), (None, None),
        (11, prose), (11, prose), (12, prose + "\n" + prose + "\nHome | About | News | Contact\nAccept cookies to go on."), (13, "é ñ 中文 😀 ▁ mixed\nlines\n\nhere"),
        (14, "\n".join(["A common line that many texts share."] * 3)), (15, "a b c d"), (16, "a b c d"), (17, "a b c"), (18, "<|endoftext|> and 'll Σς İ \x1c \x00"),
    ]


def table(spark, rows=None, partitions=3):
    rows = awkward_texts() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = [F.lit("x").alias("id"), F.lit(1).cast("long").alias("v"), F.lit(2).alias("node"), F.lit("y").alias("label"), F.lit(3).alias("rid"), F.lit(None).cast("double").alias("key"), F.lit("z").alias("size"), F.lit(4).alias("n")]
    return df.select("doc_id", "text", *extra).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_set(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def tokens(text):
    return (text or "").encode().split()
