"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items become sequences of tokens (runs of letters and digits, in lower case). At each place, the
tokens that a few fixed seeds look at are hashed; words that a seed skips may be changed. Items and texts are joined by
hash; every hit fixes an alignment of the item to the text, which is then verified position by position: somewhere along
it, OVERLAP consecutive tokens of the item (all of a shorter one) must agree with the text in at least AGREE percent,
so substituted words are tolerated. The seeds are lossless: however the substituted words of a passage that agrees so
far are placed, some seed falls on agreeing tokens only (a test tries every placement at every length), so this is the
same as verifying all alignments.

Only DataFrame functions are used. Items and texts of fewer than SPAN tokens, null and empty ones included, match
nothing. Repeated items each match; repeated rows of a text, and rows that share a doc_id, count as one document of
that id; rows with a null doc_id or item_id are left out, as a match could not name them. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SPAN = 10
#: Positions that each seed looks at. Both ends are looked at, so a hit lies within item and text.
SEEDS = ((0, 1, 2, 4, 5), (0, 2, 6, 7, 8), (0, 1, 2, 3, 6))
OVERLAP = 20
AGREE = 80
#: Item windows up to which they are sent to every executor.
BROADCAST_ROWS = 1_000_000

TOKEN = r"[\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def windows(words: Column) -> Column:
    """An array of (at, hash) of each seed at each place of an array of words."""

    def of(hashes: Column) -> Column:
        def under(m: int):
            return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(m), *(F.get(hashes, i + o) for o in SEEDS[m])).alias("hash"))

        return F.concat(*(F.transform(F.sequence(F.lit(0), F.size(hashes) - 1 - max(seed)), under(m)) for m, seed in enumerate(SEEDS)))

    enough = F.when(F.size(words) >= SPAN, words)
    return let(F.transform(enough, lambda w: F.xxhash64(w)), lambda hashes: F.when(hashes.isNotNull(), of(hashes)))


def best_overlap(item: Column, text: Column, shift: Column) -> Column:
    """The most agreeing tokens in OVERLAP consecutive ones of the item (all of a shorter one), where token i of the
    item lies at i + shift of the text; what lies outside the text doesn't agree."""
    first = F.greatest(F.lit(0), -shift)
    n = F.least(F.size(item), F.size(text) - shift) - first
    length = F.least(F.size(item), F.lit(OVERLAP))
    same = F.zip_with(F.slice(item, first + 1, n), F.slice(text, first + shift + 1, n), lambda a, b: (a == b).cast("int"))
    bound = F.struct(same.alias("same"), n.alias("n"), F.least(length, n).alias("size"))  # computed once, not for each window

    def counted(b: Column) -> Column:
        count = lambda i: F.aggregate(F.sequence(F.lit(0), b["size"] - 1), F.lit(0), lambda a, o: a + F.get(b["same"], i + o))
        return F.when(b["n"] > 0, F.array_max(F.transform(F.sequence(F.lit(0), b["n"] - b["size"]), count))).otherwise(0)

    return let(bound, counted)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, item_id, agreeing (tokens of the best overlap)
    and item_tokens, a row for each document and item of which the document holds a passage."""
    c = F.col
    # equal items share their windows
    items = benchmark.where("item_id is not null").select("item_id", tokens(c("text")).alias("item_words")).where(F.size("item_words") >= SPAN)
    items = items.groupBy("item_words").agg(F.min("item_id").alias("first"), F.collect_set("item_id").alias("ids"))
    seeds = items.select("first", F.inline(windows(c("item_words")))).select("first", c("at").alias("item_at"), "hash").distinct()
    if seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    texts = docs.where("doc_id is not null").select("doc_id", tokens(c("text")).alias("words"))
    found = texts.where(F.size("words") >= SPAN).select("doc_id", F.inline(windows(c("words"))))
    # written first: where hits are few, Spark then sends them to the texts instead of shuffling all texts
    hits = materialize(found.join(seeds, "hash").select("doc_id", "first", (c("at") - c("item_at")).alias("shift")).distinct(), "hits")
    aligned = hits.join(docs.select("doc_id", "text"), "doc_id").join(items, "first")
    judged = aligned.select("doc_id", "ids", F.size("item_words").alias("item_tokens"), let(tokens(c("text")), lambda words: best_overlap(c("item_words"), words, c("shift"))).alias("agreeing"))
    kept = judged.where(c("agreeing") * 100 >= F.least(c("item_tokens"), F.lit(OVERLAP)) * AGREE)
    return (
        kept.select("doc_id", F.explode("ids").alias("item_id"), "agreeing", "item_tokens")
        .groupBy("doc_id", "item_id")
        .agg(F.max("agreeing").cast("long").alias("agreeing"), F.max("item_tokens").cast("long").alias("item_tokens"))
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sql() -> str:
    """What op9_decontaminate computes, in the DuckDB dialect: all alignments, without seeds. One that passes agrees in
    that many tokens at least, so alignments come from equal tokens."""
    cut = lambda name, key: f"SELECT row_number() OVER () AS rid, {key} AS id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM {name} WHERE {key} IS NOT NULL"
    return f"""
WITH d AS MATERIALIZED (SELECT * FROM ({cut("documents", "doc_id")}) WHERE len(w) >= {SPAN}),
i AS MATERIALIZED (SELECT * FROM ({cut("benchmark", "item_id")}) WHERE len(w) >= {SPAN}),
dt AS (SELECT rid, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d),
it AS (SELECT rid, len(w) AS n, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM i),
shifts AS (
  SELECT dt.rid AS d_rid, it.rid AS i_rid, dt.p - it.p AS shift FROM dt JOIN it ON dt.t = it.t
  GROUP BY ALL HAVING count(*) * 100 >= any_value(least(it.n, {OVERLAP})) * {AGREE}),
aligned AS (
  SELECT d.id AS doc_id, i.id AS item_id, len(i.w) AS n, least(len(i.w), {OVERLAP}) AS l,
         list_transform(range(0, len(i.w)), lambda j: CASE WHEN j + shift >= 0 AND d.w[j + shift + 1] = i.w[j + 1] THEN 1 ELSE 0 END) AS same
  FROM shifts JOIN d ON d.rid = d_rid JOIN i ON i.rid = i_rid),
best AS (
  SELECT doc_id, item_id, n, l, list_max(list_transform(range(1, n - l + 2), lambda a: list_sum(same[a : a + l - 1]))) AS agreeing FROM aligned)
SELECT doc_id, item_id, CAST(max(agreeing) AS BIGINT) AS agreeing, CAST(max(n) AS BIGINT) AS item_tokens
FROM best WHERE agreeing * 100 >= l * {AGREE} GROUP BY doc_id, item_id
"""
