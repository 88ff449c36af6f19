"""The awkward cases in one table."""

from __future__ import annotations

from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over the lazy dog and runs through the green forest to meet its old friends by the river"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
DOCS = [
    (1, PROSE),
    (2, PROSE.replace(" ", "  ")),
    (3, PROSE + "\n"),
    (3, PROSE + "\n"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b\x0c\r "),
    (7, PROSE.upper()),
    (8, PROSE.replace("quick", "quiet")),
    (9, "Ünïcode Σας ΟΔΟΣ naïve\nshared line \n\n  SHARED LINE"),
    (10, "shared line\nshared line\nother"),
    (11, "one two three"),
    (12, LONG),
    (13, LONG + " and an end"),
    (14, "a" * 900),
    (15, "x\nshared LINE\ty"),
    (None, "no id at all, but words enough for a shingle or two"),
    (16, "<|endoftext|> it's 12345 $$ \U0001f600 <|startoftext|>"),
]
CLASH = ["digest", "content", "salt", "fp", "key", "n", "start", "k", "row", "win", "kept", "g", "c", "score", "n_tokens", "shard", "n_words", "held_out", "terms", "hits"]


def frame(spark, rows=DOCS, lang=False):
    schema = "doc_id long, text string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("lang", F.lit("en")) if lang else df


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
