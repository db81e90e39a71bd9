"""Inputs that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as extra columns of other kinds.
CLASHING = ["words", "key", "keys", "cls", "score", "rank", "h", "row", "prefix", "position", "n_words", "labels", "q_w", "comp", "u", "size", "n"]


def lower(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def hard_texts() -> list:
    long = " ".join(f"word{i % 997} the" for i in range(40_000))
    return [
        (1, "the quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "one"), (8, "one two"),
        (1, "the quick brown fox jumps over the lazy dog again and again"), (9, "x" * 300_000), (None, "a text without an id that is here"), (10, "été ÀÉ 漢字 😀 <|endoftext|> it's 12\u00a0x"),
        (11, "the quick brown fox jumps over the lazy dog again and again"),
    ]


def hard_docs(spark):
    df = spark.createDataFrame([(i, t, "en", None if i == 7 else f"s{(i or 0) % 2}") for i, t in hard_texts()], "doc_id long, text string, lang string, source string")
    return df.repartition(3).withColumns({c: F.lit("clash") for c in CLASHING})


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
