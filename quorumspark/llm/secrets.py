"""Secret scans: fixed patterns, and zstandard novelty of strings in sensitive contexts.

Three fixed kinds of secret (assign, access, hex) are found by pattern. Besides, every long string without spaces that
stands in a sensitive context is measured: a sensitive word begins or ends within REACH code points of it, on either
side, or another reported string ends so close before it (the lines of a private key). Its marginal size is what it adds
to a zstandard frame whose dictionary holds common identifiers, the most frequent words of all documents (vocabulary) and
the text around it. That is compared with what random strings of the same classes (digits for digits, small letters for
small letters) add to the same frame, so no class is dearer than another: names, sequences and repeats cost a part of it,
keys as much. Strings that cost more than NOVELTY of their random likes are reported as kind novel, if they can hold a key
at all: LEAST_BITS of information by their classes, LEAST_DIGIT_BITS if they have digits only, so account numbers, dates and
telephone numbers are none, and neither are UUIDs. Spans of the fixed kinds stay whatever they would cost, and are not
measured; strings that overlap them are not reported again.

Null and empty texts have no span. Offsets count code points, ends are exclusive. Repeated rows are scanned like any
other, very long texts as a whole and in time in proportion to their length. An empty table gives no rows. Columns
of the input stay apart from one named like the output, which is replaced.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

#: The patterns of the fixed kinds and the least lengths of what they catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

KINDS = ["assign", "access", "hex", "novel"]

#: Words whose neighbourhood is sensitive.
WORDS = "api_?key|key|secret|token|password|passwd|passphrase|pwd|auth|authorization|authentication|credential|private|bearer|signature|session|cookie|hmac|salt|cert|certificate"
#: On their own, or as a part of a name: apiKey, session_id, TOKENS, but not monkey, author or certain.
SENSITIVE = re.compile(rf"(?:(?<![A-Za-z])(?i:{WORDS})|(?<=[a-z])(?:{'|'.join(w.capitalize() for w in WORDS.split('|'))}))(?i:s|id)?(?![a-z])(?!(?<=[A-Z])[A-Z])", re.ASCII)
#: Code points between a candidate and a sensitive word, or the end of the reported string before it, at most.
REACH = 48
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST_CANDIDATE},}}")
#: Marginal compressed bytes, as a share of those of random strings of the same classes, at least; the mean over LEVELS of the
#: compressor and LIKES random strings.
NOVELTY, LEVELS, LIKES = 0.88, (3, 19), 6
#: What a candidate's classes of characters can tell, at least: 64 bits for any, 72 for digits alone.
LEAST_BITS, LEAST_DIGIT_BITS = 64, 72
#: Fixed value: the form of a UUID.
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
#: Longer candidates are measured in pieces of so many code points, lest the compressor learn their letters by and by.
PIECE = 64
#: What each frame begins with, so that common letters are cheap and rare ones dear; its own size is taken off.
PROSE = (
    "Please store the private key for the server in a safe place, never in the text of a page, and rotate it when somebody leaves. "
    "The value was sent last week: "
)
#: Code points of text on either side that the dictionary holds.
SURROUNDINGS = 2_000
#: Words of the vocabulary of all documents, the most frequent first, and the least and most letters of one.
VOCABULARY_WORDS, VOCABULARY_LETTERS = 3_000, (4, 20)

#: What code around secrets is made of: the start of each zstandard dictionary.
IDENTIFIERS = (
    "access_key_id secret_access_key client_secret client_id api_key apikey auth_token bearer Authorization: Bearer session_id "
    "password passwd username user_name private_key public_key ssh-rsa BEGIN RSA PRIVATE KEY END certificate signature sha256 sha1 md5 "
    "encryption config settings environment export const var let string return function import require process.env os.environ getenv "
    "usr local lib bin etc var log opt home share python site-packages node_modules src main resources application localhost 127.0.0.1 http:// https:// www. .com .org .net example.com version 1.0.0 build release test sample changeme placeholder "
    "your_token_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
#: Common parts of names; the dictionary has them as they are, with a capital and in capitals.
NAME_PARTS = (
    "account action address array batch begin block body buffer cache call category channel child class client code column command comment "
    "common company config content context control count create current custom customer data date default delete description device display "
    "document element email entry error event field file filter first format from group handler header height here image index info input "
    "item label last length level list load local location manager member message method model module name network next node notification "
    "number object order output owner page parameter parent path payment permission phone product profile project provider query queue "
    "record reference region register remote request resource response result role schema search select send server service setting size "
    "source start state status stop storage store string system table target task template text this time timestamp title type update "
    "user value version view width with write"
).split()

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("novelty", T.DoubleType())])


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Dictionary:
    """Measures candidates against identifiers, a vocabulary and the text around them."""

    def __init__(self, vocabulary: str = ""):
        parts = " ".join(NAME_PARTS)
        self.common = f"{vocabulary}\n{parts.upper()}\n{parts.title()}\n{parts}\n{IDENTIFIERS}\n"

    def sizes(self, before: str, after: str) -> list[Callable[[str], int]]:
        """Of each level a function that tells what a string adds to a frame."""
        prime = zstandard.ZstdCompressionDict(f"{self.common}{after}\n{before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = []
        for level in LEVELS:
            compressor = zstandard.ZstdCompressor(level=level, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
            alone = len(compressor.compress(PROSE.encode()))
            made.append(lambda x, c=compressor, n=alone: len(c.compress((PROSE + x).encode())) - n)
        return made

    def novelty(self, text: str, a: int, b: int) -> float:
        """Marginal bytes of text[a:b] over those of its random likes. Copies of it close by don't make it cheaper."""
        value = text[a:b]
        pieces = [value[at : at + PIECE] for at in range(0, len(value), PIECE)]
        around = (text[max(0, a - SURROUNDINGS) : a].replace(value, " "), text[b : b + SURROUNDINGS].replace(value, " "))
        shares = [sum(map(size, pieces)) * LIKES / max(1, sum(size(random_like(p, i)) for p in pieces for i in range(LIKES))) for size in self.sizes(*around)]
        return sum(shares) / len(shares)


DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def class_of(value: str) -> dict[str, str]:
    """The letters and digits that could stand for each letter and digit of a string: hexadecimal ones for one of these."""
    if re.fullmatch("[0-9a-f]*[a-f][0-9a-f]*", value):
        return dict.fromkeys(DIGITS + "abcdef", DIGITS + "abcdef")
    if re.fullmatch("[0-9A-F]*[A-F][0-9A-F]*", value):
        return dict.fromkeys(DIGITS + "ABCDEF", DIGITS + "ABCDEF")
    return dict.fromkeys(DIGITS, DIGITS) | dict.fromkeys(SMALL, SMALL) | dict.fromkeys(CAPITAL, CAPITAL)


def random_like(value: str, seed: int) -> str:
    """A random string of the same classes, the same each time."""
    likes, dice = class_of(value), random.Random(f"{seed}:{value}")
    return "".join(dice.choice(likes[c]) if c in likes else c for c in value)


def may_hold_a_key(value: str) -> bool:
    likes = class_of(value)
    bits = sum(math.log2(len(likes[c])) for c in value if c in likes)
    alone = not any(c.isalpha() for c in value)
    return bits >= (LEAST_DIGIT_BITS if alone else LEAST_BITS) and not UUID.search(value)


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def novel_spans(text: str, taken: list[tuple[int, int, int]], dictionary: Dictionary) -> list[tuple[int, int, int, float]]:
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    first = [a for a, _ in words]
    starts, ends = merged(taken)
    found, last = [], -REACH - 1
    for m in CANDIDATE.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip("."))
        if b - a < LEAST_CANDIDATE:
            continue
        near = bisect_right(ends, a)
        if near < len(starts) and starts[near] < b:
            last = b
            continue
        if not may_hold_a_key(text[a:b]):
            continue
        word = bisect_right(first, b + REACH) - 1  # the last that begins early enough
        if (word >= 0 and words[word][1] >= a - REACH) or a - last <= REACH:
            novelty = dictionary.novelty(text, a, b)
            if novelty > NOVELTY:
                found.append((a, 3, b, novelty))
                last = b
    return found


def spans_of(text: str | None, dictionary: Dictionary) -> list[dict]:
    if not text:
        return []
    fixed = fixed_spans(text)
    found = [(a, k, b, None) for a, k, b in fixed] + novel_spans(text, fixed, dictionary)
    return [{"kind": KINDS[k], "start": a, "end": b, "novelty": x} for a, k, b, x in sorted(found, key=lambda s: s[:3])]


def vocabulary(docs: DataFrame, text: str = "text") -> str:
    """The most frequent words of letters of all documents, by spaces, the most frequent last, where references to them
    are shortest. Words are counted in each task before they are dealt out."""
    least, most = VOCABULARY_LETTERS
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"(?<![A-Za-z])[A-Za-z]{{{least},{most}}}(?![A-Za-z])"), F.lit(0))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(VOCABULARY_WORDS)
    return " ".join(r["word"] for r in reversed(top.collect()))


def scan(docs: DataFrame, text: str = "text", out: str = "spans", known: str = "") -> DataFrame:
    """docs with the array column out of (kind, start, end, novelty), by start and then kind in the order of KINDS.
    known: words that names are made of (see vocabulary)."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary(known)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                found = [spans_of(t.as_py(), dictionary) for t in batch.column(text)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], names=[*names, out])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", known: str = "") -> DataFrame:
    """docs with each stretch of the text that spans cover replaced by mark; other columns stay."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        dictionary = Dictionary(known)

        def one(t):
            if not t or not (spans := spans_of(t, dictionary)):
                return t
            parts, end = [], 0
            for s in spans:
                if s["start"] >= end:
                    parts += [t[end : s["start"]], mark]
                end = max(end, s["end"])
            return "".join([*parts, t[end:]])

        return texts.map(one)

    return docs.withColumn(text, clean(F.col(text)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, known=vocabulary(docs)).select("doc_id", "spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
