"""Preference formatting of chat conversations.

A pair holds a chosen and a rejected conversation. The longest common prefix of turns (equal role and text, null
equal to null) is rendered once as the prompt; what follows is rendered as the two completions, each with the spans
of characters that a loss counts: what the assistant says, its closing mark included.

Turns are ordered by turn, then role, then text, nulls first; repeated turns all stay. Rows without a conversation
id belong to no conversation and are left out. A null role renders as "user", a null text as empty. Pairs of equal
conversations have two empty completions; a side without turns has an empty one. Such pairs, and those of which a
completion has nothing that a loss counts, are kept and marked as not trainable. Very long texts are rendered whole,
empty tables give no rows. Columns of pairs stay, whatever their names, apart from those that are replaced; extra
columns of turns play no part. One conversation is one training example and has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"


def turns_of(turns: DataFrame, key: str, out: str = "turns") -> DataFrame:
    """A row per key with the array out of (role, text) in order."""
    one = F.struct("turn", "role", "text")
    ordered = F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(ordered.alias(out))


def pair_up(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """key, chosen, rejected from two frames of turns (key, turn, role, text); keys of one side only are left out."""
    return turns_of(chosen, key, "chosen").join(turns_of(rejected, key, "rejected"), key)


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("user")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def all_rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learnt_spans(turns: Column) -> Column:
    """(start, end) in characters of the rendered turns."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, turn: Column) -> Column:
        role = F.coalesce(turn["role"], F.lit("user"))
        end = s["at"] + F.length(rendered(turn))
        start = s["at"] + len(OPEN) + F.length(role) + 1
        spans = F.when(role == LEARNT, F.array_append(s["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(s["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, state, add, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with the columns n_common, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask and trainable in
    place of the two arrays of (role, text)."""
    c = F.col
    a, b, n = fresh("chosen"), fresh("rejected"), fresh("common")
    same = F.zip_with(chosen, rejected, lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, F.lit(False))
    held = pairs.withColumns({n: F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")})
    rest = lambda side: F.slice(side, c(n) + 1, F.greatest(F.size(side) - c(n), F.lit(0)))
    held = held.withColumns({a: rest(chosen), b: rest(rejected)})
    made = {
        "n_common": c(n), "prompt": all_rendered(F.slice(chosen, F.lit(1), c(n))), "chosen_text": all_rendered(c(a)), "chosen_mask": learnt_spans(c(a)),
        "rejected_text": all_rendered(c(b)), "rejected_mask": learnt_spans(c(b)),
    }
    held = held.select(*(x for x in pairs.columns if x not in (chosen, rejected, *made, "trainable")), *(x.alias(name) for name, x in made.items()))
    return held.withColumn("trainable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstration data, as there is no table of rejected conversations: each conversation is preferred over itself
    with one answer cut half way, the first answer where conv_id is odd, else the last one."""
    whole = turns_of(table(spark, sf_dir, "conversations"), "conv_id", "chosen")
    places = F.filter(F.sequence(F.lit(1), F.size("chosen")), lambda i: F.get("chosen", i - 1)["role"].eqNullSafe(LEARNT))
    whole = whole.withColumn("__cut", F.when(F.col("conv_id") % 2 != 0, F.array_min(places)).otherwise(F.array_max(places)))
    half = lambda t: F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))
    cut = F.transform("chosen", lambda t, i: F.struct(t["role"].alias("role"), F.when((i + 1).eqNullSafe(F.col("__cut")), half(t["text"])).otherwise(t["text"]).alias("text")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    made = format_preferences(whole.select("conv_id", "chosen", cut.alias("rejected")))
    return made.select("conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_text", spans("chosen_mask").alias("chosen_mask"), "rejected_text", spans("rejected_mask").alias("rejected_mask"), "trainable")


OP4_SQL = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
cut AS (
  SELECT conv_id, CASE WHEN conv_id % 2 <> 0 THEN min(i) ELSE max(i) END AS at_turn
  FROM numbered WHERE role = 'assistant' GROUP BY conv_id),
both_sides AS (
  SELECT n.conv_id, i, role, text,
         CASE WHEN i = at_turn THEN substr(text, 1, length(text) // 2) ELSE text END AS other
  FROM numbered n LEFT JOIN cut c ON n.conv_id = c.conv_id),
prefix AS (
  SELECT conv_id, coalesce(min(CASE WHEN text <> other THEN i END) - 1, max(i)) AS n_common FROM both_sides GROUP BY conv_id),
rendered AS (
  SELECT b.conv_id, b.i, b.role, p.n_common,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS a,
         '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) AS b
  FROM both_sides b JOIN prefix p ON b.conv_id = p.conv_id),
placed AS (
  SELECT *, sum(CASE WHEN i > n_common THEN length(a) ELSE 0 END) OVER w AS end_a,
            sum(CASE WHEN i > n_common THEN length(b) ELSE 0 END) OVER w AS end_b
  FROM rendered WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, CAST(any_value(n_common) AS BIGINT) AS n_common,
  coalesce(string_agg(a, '' ORDER BY i) FILTER (WHERE i <= n_common), '') AS prompt,
  coalesce(string_agg(a, '' ORDER BY i) FILTER (WHERE i > n_common), '') AS chosen_text,
  coalesce(string_agg((end_a - length(a) + 12 + length(role) + 1)::BIGINT || ':' || end_a::BIGINT, ',' ORDER BY i) FILTER (WHERE i > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE i > n_common), '') AS rejected_text,
  coalesce(string_agg((end_b - length(b) + 12 + length(role) + 1)::BIGINT || ':' || end_b::BIGINT, ',' ORDER BY i) FILTER (WHERE i > n_common AND role = 'assistant'), '') AS rejected_mask,
  coalesce(bool_or(i > n_common AND role = 'assistant'), false) AS trainable
FROM placed GROUP BY conv_id
"""
