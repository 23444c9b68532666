"""Small tables with every awkward row, and readings of them without Spark."""

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; as extra columns they must not clash.
CLASHES = ("id", "row", "row_hash", "part", "size", "key", "cls", "root", "n_words", "score", "tokens", "copies", "ghost", "site")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", _lower(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def awkward():
    """Nulls in every column, empty and blank texts, one very long text, repeated rows, equal ids."""
    return [
        (7, "The quick brown fox jumps over the lazy dog today", "en", "b", 10),
        (7, "The quick brown fox jumps over the lazy dog today", "en", "b", 10),
        (7, "another text under the same id", "en", "a", None),
        (None, "a text without an id", None, "a", 3),
        (None, None, None, None, None),
        (3, None, "en", None, 0),
        (4, "", "fr", "c", 0),
        (5, " \t\r\n\x0b\x0c ", "fr", "c", 7),
        (6, "É", None, "é", 1),
        (8, LONG, "de", "b", len(LONG)),
        (9, "1234 5678 !!!", "de", "a", 13),
        (-2, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG TODAY", "en", "", 5),
    ]


def table(spark, rows, extra=CLASHES, partitions=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return table(spark, [])
