"""Importance resampling towards a target distribution, over hashed word n-grams.

Texts are cut into lines at line feeds, and each distinct line is worked on once: its features, runs of one and two of its
words, are counted where the line stands alone and multiplied by how often it occurs. Pairs of words across lines (the
last of one line and the first of the next with a word) are added separately, so all features of the whole text count.

1. Each document becomes the digests (MD5) of its lines that hold a word, and the buckets of its pairs across lines.
2. Lines are grouped with their number; each distinct line becomes the buckets of its features.
3. Counts of a bucket over all documents: those of distinct lines times their number, and those across lines.
4. A bucket's gain compares the target's share with the documents'. A distinct line's gains are summed once and joined
   with the documents by digest; lines that very many documents hold are sent to all executors instead (spread_join).
5. Ranks come from one sort by range: a document's rank is its place within its range, after all ranges before.

The driver sees counts by bucket (BUCKETS of them) and sizes of ranges. Words are runs of digits, letters of ASCII with
A-Z in lower case, and all beyond ASCII.

Null and empty texts, and texts without a word, have no features and weight 0. A null id draws by the text `7:` and comes
before all others among ties; repeated rows are documents of their own, each with a rank of its own (in any order among
themselves). Very long texts and lines are worked on whole. Columns besides id and text play no part. An empty table gives
no rows; an empty target gives gains from its added one per bucket.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

BUCKETS = 10_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A character of a word before A-Z are put in lower case.
WORD_CHARACTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucket(feature: Column) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(BUCKETS)).cast("int")


def neighbours(a: Column, b: Column) -> Column:
    """The buckets of pairs: each of a but the last with the one after it in b."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(2), n), lambda x, y: bucket(F.concat(x, F.lit(" "), y)))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CHARACTER))


def documents_of(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """row, id, keys (digests of the lines with a word, in order), across (buckets of pairs across lines)."""
    first = lambda line: F.translate(F.regexp_extract(line, WORD_CHARACTER + "+", 0), UPPER, LOWER)
    held = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), lines_of(F.coalesce(text, F.lit(""))).alias("lines"))
    ends = held.select(
        "row", "id", F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary")))).alias("keys"),
        F.transform("lines", first).alias("firsts"), F.transform("lines", lambda x: F.reverse(first(F.reverse(x)))).alias("lasts"),
    )
    return ends.select("row", "id", "keys", neighbours(F.col("lasts"), F.col("firsts")).alias("across"))


def segments_of(df: DataFrame, text: str) -> DataFrame:
    """key, n, n_words, buckets of each distinct line with a word."""
    lines = df.select(F.explode(lines_of(F.col(text))).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    worded = lines.select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"), "n", F.regexp_extract_all(F.translate("line", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    return worded.select("key", "n", F.size("words").alias("n_words"), F.concat(F.transform("words", bucket), neighbours(F.col("words"), F.col("words"))).alias("buckets"))


def counted(documents: DataFrame, segments: DataFrame) -> list[int]:
    """How many features each bucket has."""
    within = segments.select(F.explode("buckets").alias("bucket"), "n")
    across = documents.select(F.explode("across").alias("bucket"), F.lit(1).cast("long").alias("n"))
    counts = [0] * BUCKETS
    for r in within.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """Of each bucket the logarithm of its share in target over that in source, both with one added, in thousandths."""
    s_all, t_all = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(source, target, strict=True)]


def floored_mean(total: Column, n: Column) -> Column:
    """total over n towards minus infinity; 0 without any."""
    many = F.greatest(n, F.lit(1))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(((total - F.pmod(total, many)) / many.cast("decimal(20,0)")).cast("long"))


def weights(df: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_features and weight (the floored mean of its features' gains) of each row of df."""
    documents = materialize(documents_of(df, id_column, text), "resampling-documents")
    segments = materialize(segments_of(df, text), "resampling-lines")
    aims = materialize(documents_of(target, target.columns[0], text), "resampling-target"), materialize(segments_of(target, text), "resampling-target-lines")
    # a fixed number of longs, as one constant
    table_of_gains = F.from_json(F.lit(json.dumps(gains(counted(documents, segments), counted(*aims)))), "array<bigint>")
    summed = lambda buckets: F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.get(table_of_gains, b))
    by_line = materialize(segments.select("key", "n", F.col("n_words").cast("long").alias("n_words"), summed("buckets").alias("gain")), "resampling-gains")
    rows = by_line.agg(F.sum("n")).first()[0] or 0
    each = spread_join(documents.select("row", "id", F.explode("keys").alias("key")), by_line, ["key"], rows)
    within = each.select("row", "id", "n_words", (2 * F.col("n_words") - 1).alias("n"), "gain")
    across = documents.select("row", "id", F.lit(0).cast("long").alias("n_words"), F.size("across").cast("long").alias("n"), summed("across").alias("gain"))
    total = within.unionByName(across).groupBy("row", "id").agg(F.sum("n_words").alias("n_words"), F.sum("n").alias("n_features"), F.sum("gain").alias("gain"))
    return total.select("id", "n_words", "n_features", floored_mean(F.col("gain"), F.col("n_features")).alias("weight"))


def gumbel(id_column: Column, seed: str) -> Column:
    """A Gumbel draw in thousandths from the digest of seed:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored (id, n_words, score and others) with rank: 1 for the highest score, ties by id, of the documents with
    enough words; null beyond the given percentage of these."""
    spark = scored.sparkSession
    scored = materialize(scored, "resampling-scores")
    order = [F.desc("score"), F.asc("id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = scored.where(F.col("n_words") >= least_words).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the high bits are the number of the range, the low 33 the place in it
    placed = materialize(fit.withColumn("place", F.monotonically_increasing_id()), "resampling-ranges")
    sizes = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
    before, n = [], 0
    for r in sizes:
        before.append((r["range"], n))
        n += r["n"]
    offsets = spark.createDataFrame(before, "range long, before long")  # a row for each range
    ranked = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(offsets), "range")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranked.select(*scored.columns, F.when(rank <= percent * n // 100, rank).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), "7"))
    return drawn(scored, 25, 20).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
