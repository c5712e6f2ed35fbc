from __future__ import annotations

import functools
import random

from quorumspark.llm import bpe

_random = random.Random(5)
WORDS = ["".join(_random.choice("abcdefghijklmnop") for _ in range(_random.randint(2, 9))) for _ in range(4000)]
LONG = " ".join(_random.choice(WORDS) for _ in range(30_000))
PLAIN = " ".join(WORDS[:120])
#: doc_id, text, lang, source, n_chars
ODD = [
    (1, None, "en", "s", None),
    (2, "", None, "s", 0),
    (3, " \t\n\r\x0b\x0c ", "en", None, 7),
    (4, PLAIN, "en", "s", 1),
    (5, PLAIN, "de", "s", 1),
    (6, PLAIN, "xx", "s", 1),
    (6, PLAIN, "xx", "s", 1),
    (7, "one two", "en", "s", 7),
    (8, "x" * 50_000, "en", "s", 50_000),
    (9, LONG, "en", "s", len(LONG)),
    (10, "same same " * 3000, "fr", "s", 1),
    (None, "words without an id", "en", "s", 3),
    (None, PLAIN, "en", "s", 3),
    (12, "😀 ünïcödé  <|endoftext|> 'll\u0085 #*$%&|<>", "es", "s", 3),
]


def odd_docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumn("rep", F.lit("clash"))


@functools.cache
def definition() -> str:
    return bpe.read_definition(bpe.tokenizer_path())
