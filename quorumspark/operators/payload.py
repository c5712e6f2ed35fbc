"""Semi-structured payloads: normalising, validating, classifying.

Empty texts, zeros, false and null count as not given. A job feed is read by types, so the texts "0" and "false" are
given there; in evaluations they count as the values that they spell. A payload that is no JSON, or a feed that repeats
a name within an object, counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(value: Column, path: str) -> Column:
    """What a variant holds at a path, as JSON: texts keep their quotes."""
    return F.to_json(F.try_variant_get(value, path, "variant"))


def given(value: Column, path: str, text: Column | None = None) -> Column:
    """What a variant holds at a path, as text; null if it is an empty text, a zero, false or null. The texts "0",
    "false" and "null" are given. Only a text that may be a zero or false is looked up as JSON. text: what is at the path as
    text, if that is known."""
    text = F.try_variant_get(value, path, "string") if text is None else text
    json = written(value, path)
    return F.when(text.startswith("0") | text.startswith("-0") | (text == "false"), F.when((json != "false") & ~json.rlike(r"^-?0(\.0*)?([eE].*)?$"), text)).when(text != "", text)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def filled(x: Column) -> Column:
    return F.when(~x.isin("", "false", "null"), x)


def nonzero(x: Column) -> Column:
    n = filled(x).try_cast("double")
    return F.when(n != 0, n)


#: Output name, field of the nested layout, field of the flat one.
TEXT_FIELDS = [
    ("title", "job.jobName", "title"), ("description", "job.descriptionSnippet", "description"), ("url", "job.jobDetailUrl", "url"),
    ("job_type", "job.jobType", "jobType"), ("price", "job.price", "price"), ("country", "job.country", "country"),
    ("amount_spent", "job.amountSpent", "amountSpent"), ("posted_at", "job.postedAt", "postedAt"),
    ("experience_level", "job.experienceLevel", "experienceLevel"), ("score_reasoning", "score.reasoning", "scoreReasoning"),
]

#: All fields that either layout has, as texts.
EVALUATION = (
    "jobId string, title string, description string, url string, rating string, jobType string, price string, country string, paymentVerified string, clientRating string, amountSpent string, tags string, "
    "postedAt string, experienceLevel string, scoreValue string, scoreReasoning string, teamId string, teamName string, score struct<score: string, reasoning: string>, job struct<jobName: string, "
    "descriptionSnippet: string, jobDetailUrl: string, jobType: string, price: string, country: string, paymentVerified: string, clientRating: string, amountSpent: string, tags: string, postedAt: string, experienceLevel: string>"
)


def evaluation(payload: Column) -> Column:
    """One struct from an evaluation: nested (a score and a job object) or flat. The text is parsed once."""

    def made(p: Column) -> Column:
        nested = p["score"].isNotNull() & p["job"].isNotNull()

        def field(path: str) -> Column:
            x = p
            for name in path.split("."):
                x = x[name]
            return x

        pick = lambda f, a, *b: F.when(nested, f(field(a))).otherwise(F.coalesce(*(f(field(x)) for x in b)))
        return F.struct(
            filled(p["jobId"]).alias("job_id"),
            *(F.coalesce(pick(filled, a, b), F.lit("")).alias(name) for name, a, b in TEXT_FIELDS),
            pick(nonzero, "score.score", "rating").alias("rating"),
            pick(nonzero, "score.score", "scoreValue", "rating").alias("score_value"),
            pick(nonzero, "job.clientRating", "clientRating").alias("client_rating"),
            pick(filled, "job.paymentVerified", "paymentVerified").isNotNull().alias("payment_verified"),
            F.coalesce(pick(filled, "job.tags", "tags"), F.lit("[]")).alias("tags"),
            filled(p["teamId"]).alias("team_id"),
            filled(p["teamName"]).alias("team_name"),
        )

    return let(F.from_json(payload, EVALUATION), made)


def evaluation_findings(payload: Column) -> Column:
    """errors and warnings, as arrays of texts, of an evaluation."""
    listed = lambda *xs: F.array_compact(F.array(*xs))
    return let(
        evaluation(payload),
        lambda e: F.struct(
            listed(F.when(e["job_id"].isNull() & (e["title"] == ""), "neither jobId nor title")).alias("errors"),
            listed(
                F.when(e["title"] == "", "title is missing"), F.when(e["description"] == "", "description is missing"),
                F.when(e["team_id"].isNotNull() & e["team_name"].isNotNull(), "teamId goes before teamName"),
            ).alias("warnings"),
        ),
    )


def price(kind: Column, fixed: Column, low: Column, high: Column) -> Column:
    """A budget for reading: kind 1 is fixed, 2 by the hour; amounts are texts or null."""
    hourly = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("$"), low, F.lit("-$"), high, F.lit("/hr"))).when(low.isNotNull(), F.concat(F.lit("$"), low, F.lit("+/hr")))
    made = F.when((kind == "1") & fixed.isNotNull(), F.concat(F.lit("$"), fixed, F.lit(" Fixed"))).when(kind == "2", hourly)
    return F.coalesce(made, F.lit(""))


#: Output name and place below the job of a feed, for texts ('' if not given) and numbers.
FEED_TEXTS = [
    ("title", "title"), ("description", "description"), ("ciphertext", "ciphertext"), ("duration", "duration"), ("engagement", "engagement"),
    ("experience_level", "experienceLevel"), ("category_name", "categoryName"), ("sub_category_name", "subCategoryName"), ("talent_preference", "talentPreference"),
    ("country", "client.location.country"), ("city", "client.location.city"), ("timezone", "client.location.timezone"),
    ("company_industry", "client.company.industry"), ("company_size", "client.company.size"), ("created_on", "createdOn"),
]
#: Null if not given, and 0 if not given.
FEED_NUMBERS = [("connects_price", "connectsPrice"), ("client_rating", "client.stats.feedbackScore"), ("hire_rate", "client.stats.hireRate")]
FEED_AMOUNTS = [("total_spent", "client.stats.totalSpent"), ("total_hires", "client.stats.totalHires"), ("jobs_posted", "client.stats.jobsPostedCount")]
FEED_FLAGS = [("payment_verified", "client.paymentVerified"), ("is_enterprise", "client.company.isEnterprise")]
#: Places beside the job, for texts.
FEED_SOURCE = [("team_name", "teamName"), ("team_id", "teamId"), ("scanner_name", "scannerName"), ("scanner_id", "scannerId")]


#: Other places below the job that are read as texts.
FEED_OTHER = ["budget.fixed", "budget.hourlyMin", "budget.hourlyMax", "questions"]


def _layout(paths: list[str]) -> str:
    """The type of an object that has texts at these places."""
    inner: dict[str, list[str]] = {}
    for path in dict.fromkeys(paths):
        head, _, rest = path.partition(".")
        inner.setdefault(head, []).extend([rest] if rest else [])
    return f"struct<{', '.join(f'{k}: {_layout(v) if v else "string"}' for k, v in inner.items())}>"


def feed_jobs(df: DataFrame, payload: str, apply_url: str) -> DataFrame:
    """df with job, a struct from a job feed's payload (null without a job), and error, the first thing that the payload
    cannot do without, or null. A job's address is apply_url and its cipher text; skills (objects with a name, or plain texts)
    and questions are JSON lists. The text is parsed once, and all its places are read as texts at once. Columns of df that
    are called job or error, or start with __, are not kept."""
    below = [p for _, p in (*FEED_TEXTS, *FEED_NUMBERS, *FEED_AMOUNTS, *FEED_FLAGS)] + FEED_OTHER
    kept = [F.col(f"`{x}`") for x in df.columns if x not in ("job", "error") and not x.startswith("__")]
    parsed = df.select(*kept, F.col(payload).alias("__raw"), F.try_parse_json(F.col(payload)).alias("__v"))
    parsed = parsed.withColumn("__data", F.try_variant_get("__v", "$.data", _layout([p for _, p in FEED_SOURCE] + [f"job.{p}" for p in below])))
    v, data = F.col("__v"), F.col("__data")

    def text(path: str) -> Column:
        x = data
        for name in path.split("."):
            x = x[name]
        return given(v, f"$.data.{path}", x)

    at = lambda p: text(f"job.{p}")
    or_blank = lambda x: F.coalesce(x, F.lit(""))
    number = lambda p: at(p).try_cast("double")
    # what is an object is given; only of others is there more to ask
    has_data = data.isNotNull() | given(v, "$.data").isNotNull()
    has_job = data["job"].isNotNull() | given(v, "$.data.job").isNotNull()
    kind = written(v, "$.data.job.budget.type")
    skills = F.transform(F.try_variant_get(v, "$.data.job.skills", "array<variant>"), lambda s: F.coalesce(given(s, "$.name"), F.try_variant_get(s, "$", "string")))
    row = F.struct(
        *(or_blank(at(p)).alias(name) for name, p in FEED_TEXTS),
        or_blank(F.concat(F.lit(apply_url), at("ciphertext"))).alias("url"),
        F.when(kind == "1", "Fixed").otherwise("Hourly").alias("job_type"),
        price(kind, *(at(f"budget.{x}") for x in ("fixed", "hourlyMin", "hourlyMax"))).alias("price"),
        *(number(p).alias(name) for name, p in FEED_NUMBERS),
        *(F.coalesce(number(p), F.lit(0.0)).alias(name) for name, p in FEED_AMOUNTS),
        *(at(p).isNotNull().alias(name) for name, p in FEED_FLAGS),
        F.coalesce(F.to_json(skills), F.lit("[]")).alias("skills"),
        F.coalesce(at("questions"), F.lit("[]")).alias("questions"),
        *(or_blank(text(p)).alias(name) for name, p in FEED_SOURCE),
        F.col("__raw").alias("raw"),
    )
    error = F.when(~has_data, "data is missing").when(~has_job, "job is missing").when(at("ciphertext").isNull(), "ciphertext is missing")
    return parsed.select(*kept, F.when(has_job, row).alias("job"), error.alias("error"))


# The categories of errors by name and by code.
CATEGORY_OF_NAME = {
    "MongoError": "database", "MongoServerError": "database", "MongooseError": "database", "CastError": "validation",
    "JsonWebTokenError": "authentication", "TokenExpiredError": "authentication",
}
CATEGORY_OF_CODE = {"ENOENT": "file_operation", "EACCES": "file_operation", "ECONNREFUSED": "external_service", "ETIMEDOUT": "external_service"}
# The severity of each category; others are medium.
SEVERITY = {"database": "high", "authentication": "medium", "authorization": "medium", "validation": "low", "file_operation": "high", "external_service": "high", "internal": "critical"}


def _mapped(x: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in values.items() for v in pair)), x)


def error_category(name: Column, code: Column, has_details: Column) -> Column:
    """The category by name, else by code; a ValidationError counts only with details."""
    return F.coalesce(_mapped(name, CATEGORY_OF_NAME), F.when((name == "ValidationError") & has_details, "validation"), _mapped(code, CATEGORY_OF_CODE), F.lit("unknown"))


def error_severity(category: Column) -> Column:
    return F.coalesce(_mapped(category, SEVERITY), F.lit("medium"))


#: Parts of field names that hide a field's value.
SENSITIVE = ["password", "token", "secret", "credential", "authorization"]


def redacted(fields: Column, also: tuple[str, ...] = ()) -> Column:
    """A map of texts with sensitive values hidden, whatever the case of their names."""
    pattern = "(?i)" + "|".join([*SENSITIVE, *also])
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(pattern), F.lit("[REDACTED]")).otherwise(v))
