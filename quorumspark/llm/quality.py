"""Quality rules by distribution divergence.

Each document is measured once: fixed counts (words, symbols, repeated lines and word windows), a histogram of its
character classes and one of its language's common words. A language's reference is the mean of the histograms of
all its documents that pass the base rules and the length guards. A document is rejected if the Jensen-Shannon
distance (base 2, so 0 to 1) of a histogram to the reference of its language exceeds a limit; histograms of too
little text are not judged (the length guards), nor are documents whose language has no list of common words
(their common words) or no reference.

Only DataFrame functions are used. Null and empty texts have all counts 0 and fail the base rules. A null language
is a language of its own without common words. Repeated rows are judged alike, very long texts are measured whole,
an empty table gives no rows and no references. Columns of the input stay, whatever their names, apart from one named
like the output, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, table

#: Base rules: fewer words, or more of the words (in percent) in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words in a window.
WINDOW = 3
#: Characters and words from which the histograms are judged.
JUDGED_CHARS, JUDGED_WORDS = 200, 100
#: Distances up to which documents are kept.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.3, 0.3

#: Common words by language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "en": "the of and to in a is that for it as was with be by on this are from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur pas au avec".split(),
}

SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, kind: str) -> Column:
    """How many characters of a class there are."""
    return F.length(F.regexp_replace(text, f"[^{kind[1:-1]}]+", ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs twice or more.

    Windows are sorted by a short hash and their place, in one long each; neighbours of one hash are candidates, and
    only their words are compared.
    """

    def candidates(windows: Column) -> Column:
        at = lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF))
        of = lambda x: F.shiftright(x, 31)
        beside = lambda i, x: (of(x) == of(F.get(windows, i - 1))) | (of(x) == of(F.get(windows, i + 1)))
        return F.transform(F.filter(windows, lambda x, i: F.coalesce(beside(i, x), F.lit(False))), lambda x: at(x).cast("int"))

    def same(found: Column) -> Column:
        """Places of the candidates whose words recur, sorted."""
        keyed = F.sort_array(F.transform(found, lambda p: F.struct(F.struct(*(F.get(words, p + o).alias(f"w{o}") for o in range(WINDOW))).alias("w"), p.alias("p"))))
        return let(keyed, lambda k: F.sort_array(F.transform(F.filter(k, lambda x, i: F.coalesce((x["w"] == F.get(k, i - 1)["w"]) | (x["w"] == F.get(k, i + 1)["w"]), F.lit(False))), lambda x: x["p"])))

    def covered(places: Column) -> Column:
        new = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    window_hash = lambda i: F.xxhash64(*(F.get(words, i + o) for o in range(WINDOW)))
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.shiftleft(window_hash(i).bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(i.cast("long")))
    found = let(F.sort_array(hashed), candidates)
    whole = let(found, lambda f: F.when(F.size(f) == 0, 0).otherwise(let(same(f), covered)))
    return F.when(F.size(words) > WINDOW, whole).otherwise(0)


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", out: str = "measured") -> DataFrame:
    """docs with the struct column out: the base counts and the two histograms."""
    c = F.col
    n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    body = F.coalesce(c(text), F.lit(""))
    words, rest = fresh("words"), fresh("rest")
    with_words = docs.withColumns({words: F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), rest: F.regexp_replace(body, "[a-z]+", "")})
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    word_chars = F.length(F.array_join(words, ""))
    upper, digits, symbols = (count_of(c(rest), k) for k in ("[A-Z]", "[0-9]", SYMBOLS))
    letters = count_of(c(rest), r"[\p{L}\p{M}]") - upper
    small = F.length(body) - F.length(rest)
    classes = [small, upper, letters, digits, symbols, word_chars - small - upper - letters - digits - symbols, F.length(body) - word_chars]

    def equal_to(word: str):
        return lambda x: x == word

    def common(listed: list[str]) -> Column:
        """Histogram of the common words, all others last."""
        found = F.filter(F.transform(words, F.lower), lambda w: w.isin(listed))
        return let(found, lambda f: F.concat(F.array(*(F.size(F.filter(f, equal_to(w))) for w in listed)), F.array(F.size(words) - F.size(f))))

    histogram = F.lit(None).cast("array<int>")
    for name, listed in COMMON.items():
        histogram = F.when(c(lang) == name, common(listed)).otherwise(histogram)
    measured = F.struct(
        n(F.size(words)).alias("n_words"), n(word_chars).alias("word_chars"), n(symbols).alias("n_symbols"),
        n(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"), n(repeated_words(c(words))).alias("n_repeat_words"),
        F.array(*(x.cast("int") for x in classes)).alias("classes"), histogram.alias("common"),
    )
    # a generator of one row: later steps take the finished struct instead of its expressions
    kept = [x for x in docs.columns if x != out]
    return with_words.select(*kept, F.explode(F.array(measured)).alias(out))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def shares(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(histogram, lambda x: x / t))


def guarded(m: Column) -> tuple[Column, Column]:
    """The histograms as shares, null below the length guards."""
    chars = F.aggregate(m["classes"], F.lit(0), lambda a, x: a + x)
    return F.when(chars >= JUDGED_CHARS, shares(m["classes"])), F.when(m["n_words"] >= JUDGED_WORDS, shares(m["common"]))


def references(measured: DataFrame, lang: str = "lang", column: str = "measured") -> DataFrame:
    """A row per language: lang, ref_classes, ref_common (mean shares over the documents that are judged and pass the
    base rules)."""
    m = F.col(column)
    classes, common = guarded(m)
    passing = measured.where(~base_failed(m)).select(F.col(lang).alias("lang"), classes.alias("a"), common.alias("b"))
    n_common = 1 + max(map(len, COMMON.values()))
    means = [F.round(F.avg(F.get("a", F.lit(i))), 12).alias(f"a{i}") for i in range(7)] + [F.round(F.avg(F.get("b", F.lit(i))), 12).alias(f"b{i}") for i in range(n_common)]
    listed = lambda k, n: F.array_compact(F.array(*(F.col(f"{k}{i}") for i in range(n))))
    refs = passing.groupBy("lang").agg(*means).select("lang", listed("a", 7).alias("ref_classes"), listed("b", n_common).alias("ref_common"))
    # written: Spark sees how small it is and sends it to the documents instead of dealing them out by language
    return materialize(refs, "references")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance with base 2 logarithms; null if either is."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def judge(measured: DataFrame, refs: DataFrame, lang: str = "lang", column: str = "measured", out: str = "verdict") -> DataFrame:
    """measured with the struct column out: base_failed, class_distance, word_distance and kept."""
    key, ref_classes, ref_common, rated = map(fresh, ("lang", "classes", "common", "rated"))
    refs = refs.select(F.col("lang").alias(key), F.col("ref_classes").alias(ref_classes), F.col("ref_common").alias(ref_common))
    m = F.col(column)
    classes, common = guarded(m)
    joined = measured.drop(out).join(refs, F.col(lang).eqNullSafe(F.col(key)), "left")
    found = F.struct(base_failed(m).alias("base_failed"), distance(classes, F.col(ref_classes)).alias("class_distance"), distance(common, F.col(ref_common)).alias("word_distance"))
    joined = joined.withColumn(rated, found)
    r = F.col(rated)
    far = F.coalesce(r["class_distance"] > MOST_CLASS_DISTANCE, F.lit(False)) | F.coalesce(r["word_distance"] > MOST_WORD_DISTANCE, F.lit(False))
    return joined.withColumn(out, r.withField("kept", ~r["base_failed"] & ~far)).drop(key, ref_classes, ref_common, rated)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(measure(table(spark, sf_dir, "documents")).select("doc_id", "lang", "measured"), "quality")
    m = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    return judge(measured, references(measured)).select("doc_id", *(F.col(f"measured.{x}").alias(x) for x in m), "verdict.base_failed", "verdict.kept")


def _listed(counts: list[str]) -> str:
    return "[" + ", ".join(counts) + "]"


def op6_sql() -> str:
    """What op6_quality computes, in the DuckDB dialect."""
    count = lambda kind: f"length(regexp_replace(rest, '[^{kind}]+', '', 'g'))"
    common = " ".join(
        f"WHEN lang = '{name}' THEN list_append({_listed([f'len(list_filter(lowered, lambda x: x = {w!r}))' for w in words])}, len(list_filter(lowered, lambda x: x NOT IN ({', '.join(map(repr, words))}))))"
        for name, words in COMMON.items()
    )
    n_common = 1 + max(map(len, COMMON.values()))
    means = ", ".join([f"round(avg(p_classes[{i + 1}]), 12) AS a{i}" for i in range(7)] + [f"round(avg(p_common[{i + 1}]), 12) AS b{i}" for i in range(n_common)])
    refs = ", ".join([f"{_listed([f'a{i}' for i in range(7)])} AS ref_classes", f"list_filter({_listed([f'b{i}' for i in range(n_common)])}, lambda x: x IS NOT NULL) AS ref_common"])
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
    distance_of = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(f'{p}[i]', f'{q}[i]')} + {half(f'{q}[i]', f'{p}[i]')})) / 2))"
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         regexp_replace(coalesce(text, ''), '[a-z]+', '', 'g') AS rest,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
placed AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM cut WHERE len(words) > {WINDOW}),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM placed),
repeated AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat FROM counted, (SELECT unnest(range(0, {WINDOW})) AS o) WHERE n > 1 GROUP BY rid),
sizes AS (
  SELECT c.rid, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         {count("#*$%&|<>")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words, length(body) AS n_chars, length(body) - length(rest) AS small,
         {count("A-Z")} AS upper_case, {count("0-9")} AS digits, {count("\\p{L}\\p{M}".replace(chr(92) * 2, chr(92)))} AS letters,
         list_transform(words, lambda x: lower(x)) AS lowered
  FROM cut c LEFT JOIN repeated r ON c.rid = r.rid),
measured AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         CASE WHEN n_chars >= {JUDGED_CHARS} THEN list_transform(
           [small, upper_case, letters - upper_case, digits, n_symbols, word_chars - small - letters - digits - n_symbols, n_chars - word_chars],
           lambda x: x / n_chars::DOUBLE) END AS p_classes,
         CASE WHEN n_words >= {JUDGED_WORDS} THEN list_transform(CASE {common} END, lambda x: x / n_words::DOUBLE) END AS p_common
  FROM sizes),
means AS (SELECT lang, {means} FROM measured WHERE NOT base_failed GROUP BY lang),
refs AS (SELECT lang, {refs} FROM means),
rated AS (
  SELECT m.*, {distance_of("p_classes", "ref_classes")} AS class_distance, {distance_of("p_common", "ref_common")} AS word_distance
  FROM measured m LEFT JOIN refs r ON m.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(class_distance > {MOST_CLASS_DISTANCE}, false) AND NOT coalesce(word_distance > {MOST_WORD_DISTANCE}, false) AS kept
FROM rated
"""
