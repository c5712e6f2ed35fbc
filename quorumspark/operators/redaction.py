"""Hiding sensitive values in JSON documents of any depth.

A document is cut into tokens, one pass over them finds where sensitive values begin and end, and what lies between is put
together again. All of it stays in the row and in the JVM; its time is in proportion to the document's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payload import SENSITIVE

#: Texts in quotes, marks, and everything else (numbers, true, false, null).
TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'
REDACTED = '"[REDACTED]"'


def _is_sensitive(name: Column, pattern: str) -> Column:
    """Whether a name, as written in quotes, is sensitive; escapes in it are read first."""
    read = F.when(name.contains("\\"), F.get(F.from_json(F.concat(F.lit("["), name, F.lit("]")), "array<string>"), F.lit(0))).otherwise(name)
    return F.coalesce(read.rlike(pattern), F.lit(False))


def sensitive_spans(tokens: Column, pattern: str) -> Column:
    """The first and last token (from 0) of each outermost value whose name is sensitive."""
    integer = lambda n: F.lit(n).cast("int")
    no_spans = F.array().cast("array<struct<a: int, b: int>>")
    # place, depth, the depth of the hidden value around (-1: none), where it began, whether a hidden value comes next
    start = F.struct(integer(0).alias("i"), integer(0).alias("depth"), integer(-1).alias("hide"), integer(0).alias("began"), F.lit(False).alias("armed"), F.lit("").alias("before"), no_spans.alias("spans"))

    def step(s: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        hidden = s["hide"] >= 0
        ends = (s["armed"] & ~opens) | (hidden & closes & (depth == s["hide"]))
        began = F.when(s["armed"], s["i"]).otherwise(s["began"])
        return F.struct(
            (s["i"] + 1).alias("i"), depth.alias("depth"), F.when(ends, integer(-1)).when(s["armed"], s["depth"]).otherwise(s["hide"]).alias("hide"), began.alias("began"),
            F.when(hidden | s["armed"] | (token != ":"), F.lit(False)).otherwise(_is_sensitive(s["before"], pattern)).alias("armed"), token.alias("before"),
            F.when(ends, F.array_append(s["spans"], F.struct(began.alias("a"), s["i"].alias("b")))).otherwise(s["spans"]).alias("spans"),
        )

    return F.aggregate(tokens, start, step, lambda s: s["spans"])


def redacted_documents(df: DataFrame, column: str, also: tuple[str, ...] = ()) -> DataFrame:
    """df with the JSON of a column without the values of sensitive names, at any depth and whatever they are: a sensitive
    object or list is hidden as a whole. All else keeps its type, its order and its repeats; space between tokens goes.
    Null stays null; text that is no JSON becomes null, as nothing in it can be told apart; a bare value stays."""
    pattern = "(?i)" + "|".join([*SENSITIVE, *also])
    t, s = f"__{column}_tokens", f"__{column}_spans"
    cut = df.withColumn(t, F.when(F.try_parse_json(column).isNotNull(), F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))))
    found = cut.withColumn(s, sensitive_spans(F.col(t), pattern))
    n, k = F.size(t), F.size(s)

    def kept(j: Column) -> Column:
        """The tokens before the hidden value j, after the one before it."""
        begin = F.coalesce(F.get(s, j - 1)["b"] + 1, F.lit(0))
        end = F.coalesce(F.get(s, j)["a"], n)
        return F.array_join(F.slice(t, begin + 1, end - begin), "")

    joined = F.array_join(F.transform(F.sequence(F.lit(0), k), kept), REDACTED)
    return found.withColumn(column, F.when(F.col(t).isNotNull(), joined)).drop(t, s)
