"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A proposal is the exact result if every pair of
neighbours is compatible, that is, if merging the joined bytes of the two by rank gives just these two tokens again
(then no merge ever crosses a boundary, and the word falls into the same tokens). All pairs of a batch are tested at
once against a sorted table of verdicts; only words with a failing pair undergo the exact merging by rank.

Null texts count as empty and give an empty list; a null list of ids decodes to the empty text. Columns besides the
named ones are kept, apart from one called like the output, which is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, trim_memory

#: Fixed value: the pattern that cuts a text into words before merging (of the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words in each of the two generations that one Python worker remembers; words that no text of a whole
#: generation had are forgotten (results don't change).
REMEMBERED_WORDS = 200_000
#: Words of up to so many bytes are merged by looking at all pairs again after each merge.
SHORT_WORD = 24
#: Longer words are not remembered.
LONG_WORD = 64
#: Characters of text for each batch that goes back to Spark.
BATCH_CHARS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(definition: str) -> list[bytes]:
    """What each id stands for."""
    spec, alphabet = json.loads(definition), byte_alphabet()
    known = {i: bytes(alphabet[c] for c in tok) for tok, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [known.get(i, b"") for i in range(1 + max(known))]


class Codec:
    """Encoder and decoder of one tokenizer file; one for each Python worker and file."""

    def __init__(self, definition: str):
        self.definition = definition
        spec = json.loads(definition)
        alphabet = byte_alphabet()
        raw = {bytes(alphabet[c] for c in tok): i for tok, i in spec["model"]["vocab"].items()}
        self.vocab = raw
        self.bytes_of = token_bytes(definition)
        self.size = len(self.bytes_of)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = bytes(alphabet[c] for c in left), bytes(alphabet[c] for c in right)
            self.merges[raw[a], raw[b]] = (rank, raw[a + b])
        self.letters = [raw[bytes([b])] for b in range(256)]
        self.longest = max(map(len, raw))
        self.split = regex.compile(PATTERN).findall
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.newer = unassigned()
        self.pre = None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = np.empty(0, np.int64)  # sorted codes left * size + right ...
        self.compatible = np.empty(0, bool)  # ... and their verdicts
        self.whole: dict[int, bool] = {}  # whether a token's bytes merge into that token

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, lowest first and leftmost among equals."""
        ids: list[int] = [self.letters[b] for b in word]
        n = len(ids)
        if n <= SHORT_WORD:
            get = self.merges.get
            while True:
                best, at = None, 0
                for i, pair in enumerate(zip(ids, ids[1:])):  # noqa: B905
                    if (m := get(pair)) and (best is None or m < best):
                        best, at = m, i
                if best is None:
                    return ids
                ids[at : at + 2] = [best[1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        found, i, n, get, longest = [], 0, len(word), self.vocab.get, self.longest
        while i < n:
            j = min(n, i + longest)
            while (t := get(word[i:j])) is None:
                j -= 1
            found.append(t)
            i = j
        return found

    def verdicts(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) is compatible."""
        distinct = np.unique(codes)
        new = np.setdiff1d(distinct, self.pairs, assume_unique=True)
        if len(new):
            ok = np.fromiter(((self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]) for a, b in zip((new // self.size).tolist(), (new % self.size).tolist(), strict=True)), bool, len(new))
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.compatible = np.insert(self.pairs, at, new), np.insert(self.compatible, at, ok)
        return self.compatible[np.searchsorted(self.pairs, codes)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as int32 in bytes."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ids = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        bad = np.zeros(len(words), bool)
        if len(ids) > 1:
            inside = np.ones(len(ids) - 1, bool)
            inside[ends[:-1] - 1] = False  # the last token of a word and the first of the next are no pair
            at = np.flatnonzero(inside)
            failing = at[~self.verdicts(ids[at] * self.size + ids[at + 1])]
            bad[np.searchsorted(ends, failing, side="right")] = True
        for k in np.flatnonzero(sizes == 1).tolist():
            t = proposed[k][0]
            if t not in self.whole:
                self.whole[t] = self.exact(self.bytes_of[t]) == [t]
            bad[k] |= not self.whole[t]
        out, starts, small = {}, (ends - sizes).tolist(), ids.astype(np.int32)
        for k, w in enumerate(words):
            out[w] = np.array(self.exact(raw[k]), np.int32).tobytes() if bad[k] else small[starts[k] : starts[k] + len(proposed[k])].tobytes()
        return out

    def words(self, text: str) -> list[str]:
        if not text.isascii() and self.newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():  # code points newer than the tables at hand: the library's own classes decide
            if self.pre is None:
                from tokenizers import Tokenizer

                self.pre = Tokenizer.from_str(self.definition).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)] if self.pre else self.split(text)
        return self.split(text)

    def encode_batch(self, texts: list[str | None]) -> tuple[bytes, np.ndarray]:
        """All ids one after the other, as int32 in bytes, and how many each text has."""
        cut: list[list[str]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.cut_added and any(a in text for a in self.added):
                cut.append([w for part in self.cut_added.split(text) if part for w in ([part] if part in self.added else self.words(part))])
            else:
                cut.append(self.words(text))
        known = self.known
        words = {w for words in cut for w in words if w not in known}
        got = {w: self.older[w] for w in words if w in self.older}
        got |= {w: np.int32(self.added[w]).tobytes() for w in words if w in self.added}
        got |= self.learn([w for w in words if w not in got])
        if len(known) + len(got) > REMEMBERED_WORDS:
            self.older, self.known = known, {w: ids for w, ids in got.items() if len(w) <= LONG_WORD}
        else:
            known.update((w, ids) for w, ids in got.items() if len(w) <= LONG_WORD)
        local = _Over(known, got)
        look = local.__getitem__
        parts = [b"".join(map(look, words)) for words in cut]
        return b"".join(parts), np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))


class _Over(dict):
    """The words of this batch over what is remembered."""

    def __init__(self, below: dict, own: dict):
        super().__init__(own)
        self.below = below

    def __missing__(self, key):
        return self.below[key]


def unassigned() -> np.ndarray:
    """For each code point whether this Python's tables have no category for it."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


_codecs: dict[int, Codec] = {}


def codec(definition: str) -> Codec:
    key = hash(definition)
    if key not in _codecs:
        _codecs[key] = Codec(definition)
    return _codecs[key]


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices with about BATCH_CHARS bytes of text each."""
    sizes = np.nan_to_num(np.array(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64))
    group = (np.cumsum(sizes) // BATCH_CHARS).astype(np.int64)
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, definition: str, text: str = "text", ids: str = "ids", remember: bool = True) -> DataFrame:
    """docs with the array column ids: the tokens of the whole text, as the tokenizers library gives them with
    add_special_tokens=False. definition is the tokenizer's JSON (see read_definition). Without remember, Python
    workers forget tokenizer and words after each task: slower, but they leave the memory to other work."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(definition)
    rest = docs.drop(ids) if ids in docs.columns and ids != text else docs
    names = [c for c in rest.columns if c != ids]
    schema = T.StructType([*(rest.schema[c] for c in names), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value)
        for whole in batches:
            for batch in _pieces(whole, text):
                flat, sizes = c.encode_batch(batch.column(text).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(offsets, values)], names=[*names, ids])
        c.older = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches)
        if not remember:
            _codecs.clear()
        trim_memory()

    return rest.mapInArrow(run, schema)


def decode(docs: DataFrame, definition: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the column text: what the ids stand for, special tokens included; bytes that are no UTF-8 become
    U+FFFD."""
    shipped = docs.sparkSession.sparkContext.broadcast(token_bytes(definition))
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shipped.value.__getitem__
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                column = batch.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.nan_to_num(np.array(pc.list_value_length(column).to_numpy(zero_copy_only=False), dtype=np.float64))).astype(np.int64)
                out, start = [], 0
                for end in ends.tolist():
                    out.append(b"".join(map(look, flat[start:end].tolist())).decode("utf-8", "replace"))
                    start = end
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, text])
        trim_memory()

    return docs.mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = read_definition(tokenizer_path())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, definition).select("doc_id", "ids")
    return decode(encoded, definition).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
