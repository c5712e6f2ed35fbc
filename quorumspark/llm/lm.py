"""Language-model scores by deleted interpolation.

A word's probability mixes maximum-likelihood estimates, count(n-gram) / count(context), of orders 1 to ORDER and a
uniform one over the vocabulary and one unknown word. The weight of each order depends on how often its context occurs
(a bucket for each power of two). The weights are learnt, order by order from the lowest, by expectation-maximisation
on a part of the training documents (the deleted part) while the estimates come from the rest; then the estimates take
in the deleted part, too. A context is counted as often as a token follows it, so each estimate sums to 1 over the
words seen after it, and so does the mixture over the vocabulary and the unknown word.

Every n-gram of every training document counts, however rare. Counts never sit in one place:

1. Documents are packed into blocks of about BLOCK_BYTES of text, each within one part of the input, so no key decides
   where a document goes; a longer document is a block of its own. Deleted documents have blocks of their own.
2. Each block counts its n-grams, and sends their sorted 64-bit hashes with the counts, cut by ranges of the hash
   (buckets). An n-gram has one entry from each block at most, so none is hot.
3. Each bucket adds up, and answers every block with the counts of what it asked for, in the order asked.
4. Blocks of the deleted part turn their answers into histograms of (context bucket, ratio of the two estimates), which
   are all that the driver sees; then each block is scored with its own answers.

N-grams are told apart by 62 bits of hash: of 10^9 distinct ones about 0.1 pairs are expected to be taken for one.

A text's tokens are its words with A-Z in lower case, then one end token; before the first word lies a beginning that
is a context as often as there are texts. Null and empty texts have the end token only. A null doc_id counts as the
empty text when documents are dealt. Repeated rows are separate documents, very long texts are scored whole, columns
besides doc_id and text play no part, and an empty table gives no rows. Without training documents every probability
is uniform; without deleted ones the weight of single words is 0.5 and that of longer n-grams 0.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, doc_bucket, materialize, mixed, small_batches, table, tidily, trim_memory

#: Words of the longest n-grams.
ORDER = 3
#: UTF-8 bytes of the texts of a block, about.
BLOCK_BYTES = 9_000_000
#: Entries that a bucket adds up, about.
BUCKET_ENTRIES = 3_000_000
#: Held by no word, as it is white space.
END = b"\n"
#: Steps of the histogram of ratios for each power of two.
STEPS, UNSEEN = 64, -(10**6)
CONTEXT_BUCKETS = 65

_U = np.uint64
_BEGIN, _FACTOR = _U(0x5851F42D4C957F2D), _U(0x9E3779B97F4A7C17)


def tokens(text: bytes) -> list[bytes]:
    """The words of UTF-8 and the end token; bytes.split() cuts at just the white space that ends a word."""
    words = text.translate(LOWER_BYTES).split()
    words.append(END)
    return words


def log_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts that never occur, then one for each power of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def context_weights(bucket: np.ndarray, ratio: np.ndarray, deleted: np.ndarray, untold: float) -> np.ndarray:
    """EM for a weight per bucket of contexts; ratio: of the estimate to what is mixed in below it. Buckets without a
    deleted token get the weight untold."""
    total = np.bincount(bucket, deleted, CONTEXT_BUCKETS)
    weights = np.full(CONTEXT_BUCKETS, 0.5)
    for _ in range(200):
        p = weights[bucket] * ratio
        share = p / (p + 1 - weights[bucket])
        new = np.clip(np.bincount(bucket, share * deleted, CONTEXT_BUCKETS) / np.maximum(total, 1), 0.0, 1 - 1e-9)
        if np.abs(new - weights).max() < 1e-10:
            break
        weights = new
    weights = np.where(total > 0, weights, untold)
    weights[0] = 0.0  # a context that never occurs says nothing
    return weights


# --- sorted hashes and counts as bytes: differences by byte planes, of which the high ones are nearly all 0


def packed_keys(keys: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each; counts from 255 on follow in full."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return zstandard.compress(small.tobytes() + counts[small == 255].astype(np.int64).tobytes(), 1)


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(data)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, offset=n)
    return counts


class Block:
    """The n-grams of a block of texts. For each order: which distinct n-gram ends at each token, and of each distinct
    one its last word, its context (a distinct n-gram one shorter, or the beginning of a text, which is numbered after
    them), the n-gram without its first word, and its hash."""

    def __init__(self, texts: Iterable[bytes], orders: int = ORDER):
        place: dict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        place[END]  # at 0
        lists = [np.fromiter(map(place.__getitem__, tokens(t)), np.int32) for t in texts]
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        word = np.concatenate(lists) if lists else np.empty(0, np.int32)
        lists.clear()
        spelt = np.empty(len(place), object)
        spelt[:] = list(place)
        place.clear()
        hashes = pd.util.hash_array(spelt, categorize=False)
        del spelt
        self.at, self.context, self.suffix, self.hashes = [word], [None], [None], [hashes]
        for n in range(2, orders + 1):
            below = self.at[-1]
            context = np.empty(len(word), np.int64)
            context[1:] = below[:-1]
            context[self.starts] = len(self.hashes[-1])
            codes, first, at = np.unique(context * len(hashes) + word, return_index=True, return_inverse=True)
            del context
            ctx, last = np.divmod(codes, len(hashes))
            self.at.append(at.astype(np.int32))
            self.context.append(ctx)
            self.suffix.append(below[first])
            self.hashes.append(mixed(np.append(self.hashes[-1], _BEGIN)[ctx] * _FACTOR + hashes[last] + _U(n)))
        # the order in the two lowest bits
        keys = np.concatenate([(h & ~_U(3)) | _U(n) for n, h in enumerate(self.hashes, 1)])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counted(self, counts: bool | np.ndarray) -> np.ndarray:
        """How many of the tokens marked by counts each key has, by key."""
        return np.concatenate([np.bincount(at[counts] if counts is not True else at, minlength=len(h)) for at, h in zip(self.at, self.hashes, strict=True)])[self.order]

    def by_order(self, counts: np.ndarray) -> list[np.ndarray]:
        """Counts by key, as an array for each order."""
        placed = np.empty_like(counts)
        placed[self.order] = counts
        return np.split(placed, np.cumsum([len(h) for h in self.hashes])[:-1])

    def estimates(self, counts: list[np.ndarray], n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct n-gram of order n the count of its context and the maximum-likelihood estimate."""
        if n == 1:
            context = np.full(len(counts[0]), total)
        else:
            context = np.append(counts[n - 2], counts[0][0])[self.context[n - 1]]  # texts begin as often as they end
        return context, counts[n - 1] / np.maximum(context, 1)

    def mixture(self, counts: list[np.ndarray], weights: list[np.ndarray], total: int, types: int) -> np.ndarray:
        """The probability of each distinct n-gram's last word, of the order that weights reach."""
        p = np.full(len(counts[0]), 1 / (types + 1))
        for n, weight in enumerate(weights, 1):
            context, ml = self.estimates(counts, n, total)
            w = weight[log_bucket(context)]
            p = w * ml + (1 - w) * (p if n == 1 else p[self.suffix[n - 1]])
        return p


def packed(docs: DataFrame, part: Column, block_bytes: int) -> DataFrame:
    """docs in blocks: block, deletes, and as bytes ids, has_id, part, sizes and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, made = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list[tuple]] = {False: [], True: []}
        weight = {False: 0, True: 0}

        def flushed(deletes: bool) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, has, parts, sizes, texts = map(list, zip(*held[deletes], strict=True))
            held[deletes], weight[deletes] = [], 0
            row = {"block": here + made, "deletes": deletes}
            row |= {name: np.concatenate(x).tobytes() for name, x in (("ids", ids), ("has_id", has), ("part", parts), ("sizes", sizes))}
            return pa.RecordBatch.from_pylist([row | {"texts": zstandard.compress(b"".join(texts), 6)}])

        for whole in batches:
            for at in range(0, len(whole), 200):
                some = whole.slice(at, 200)
                deleted = pc.equal(some.column("part"), 2)
                for deletes in (False, True):
                    rows = some.filter(deleted if deletes else pc.invert(deleted))
                    if not len(rows):
                        continue
                    ids, texts = rows.column("doc_id"), rows.column("text").cast(pa.binary())
                    data = [t or b"" for t in texts.to_pylist()]
                    sizes = np.array([len(t) for t in data], np.int64)
                    held[deletes].append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), rows.column("part").to_numpy(zero_copy_only=False).astype(np.int8), sizes, b"".join(data)))
                    weight[deletes] += int(sizes.sum()) + 100 * len(sizes)
                    if weight[deletes] >= block_bytes:
                        yield flushed(deletes)
        for deletes in (False, True):
            if held[deletes]:
                yield flushed(deletes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part.alias("part"))
    return rows.mapInArrow(tidily(run), "block long, deletes boolean, ids binary, has_id binary, part binary, sizes binary, texts binary")


def texts_of(row: pd.Series) -> Iterator[bytes]:
    data, at = zstandard.decompress(row["texts"]), 0
    for size in np.frombuffer(row["sizes"], np.int64).tolist():
        yield data[at : at + size]
        at += size


def score(docs: DataFrame, train: Column, deleted: Column, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """docs: doc_id, text; train and deleted: over doc_id. Returns doc_id, n_tokens, n_known, train_tokens,
    base_score (add 0.1) and score (the mixture), both log10 probabilities of the text."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    blocks = materialize(packed(docs, F.when(~train, 0).when(deleted, 2).otherwise(1), block_bytes), "lm-blocks")
    size = blocks.agg(F.sum(F.octet_length("texts")), F.count("*")).first()[0] or 0
    buckets = 1 + int(size // bucket_entries)  # a compressed byte of text has about one n-gram

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = -(-(np.arange(1, buckets, dtype=object) << 64) // buckets)
        edges = np.array(edges.tolist(), dtype=_U)
        for part in parts:
            for _, row in part.iterrows():
                block = Block(texts_of(row))
                deletes = bool(row["deletes"])
                counts = block.counted(True if deletes else np.repeat(np.frombuffer(row["part"], np.int8) == 1, block.lengths))
                keys, cuts = block.keys, [0, *np.searchsorted(block.keys, edges).tolist(), len(block.keys)]
                del block
                trim_memory()
                rows = [(b, row["block"], deletes, y - x, packed_keys(keys[x:y]), packed_counts(counts[x:y])) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]  # noqa: B905
                yield pd.DataFrame(rows, columns=["bucket", "block", "deletes", "n", "keys", "counts"])

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(parts))
        n = asked["n"].to_numpy()
        keys, place = np.unique(np.concatenate([unpacked_keys(k) for k in asked["keys"]]), return_inverse=True)
        counts = np.concatenate([unpacked_counts(c, k) for c, k in zip(asked["counts"], n.tolist(), strict=True)])
        deletes = np.repeat(asked["deletes"].to_numpy(bool), n)
        total = np.bincount(place, counts, len(keys)).astype(np.int64)
        kept = np.bincount(place, counts * ~deletes, len(keys)).astype(np.int64)
        word = (keys & _U(3)) == 1
        bucket, blank = asked["bucket"].iat[0], [None] * len(asked)
        yield pd.DataFrame({"block": [None], "bucket": bucket, "n": 0, "kept": None, "total": None, "types": [int((total[word] > 0).sum())], "kept_tokens": [int(kept[word].sum())], "tokens": [int(total[word].sum())]}).astype({"block": "Int64"})
        ends = np.cumsum(n)
        spans = [place[b - k : b] for k, b in zip(n.tolist(), ends.tolist(), strict=True)]
        answers = {"kept": [packed_counts(kept[s]) if d else None for s, d in zip(spans, asked["deletes"], strict=True)], "total": [packed_counts(total[s]) for s in spans]}
        yield pd.DataFrame({"block": asked["block"].to_numpy(), "bucket": bucket, "n": n, **answers, "types": blank, "kept_tokens": blank, "tokens": blank}).astype({"block": "Int64", "types": "Int64", "kept_tokens": "Int64", "tokens": "Int64"})
        del keys, place, counts, total, kept, spans
        trim_memory()

    asked = blocks.mapInPandas(tidily(count), "bucket int, block long, deletes boolean, n int, keys binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInPandas(add_up, "block long, bucket int, n int, kept binary, total binary, types long, kept_tokens long, tokens long"), "lm-answers")
    types, kept_total, total = (int(x or 0) for x in answers.where("block is null").agg(F.sum("types"), F.sum("kept_tokens"), F.sum("tokens")).first())

    def answered(block: Block, known: pd.DataFrame, column: str) -> list[np.ndarray]:
        known = known.sort_values("bucket")
        return block.by_order(np.concatenate([unpacked_counts(c, n) for c, n in zip(known[column], known["n"].tolist(), strict=True)]))

    weights: list[np.ndarray] = []
    given = answers.where("block is not null")

    def ratios_over(below: list[np.ndarray]):
        """The ratio of the next order's estimate to the mixture of the orders below it, at each deleted token."""
        n = len(below) + 1

        def ratios(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            block = Block(texts_of(part.iloc[0]))
            counts = answered(block, known, "kept")
            lower = block.mixture(counts, below, kept_total, types)
            context, ml = block.estimates(counts, n, kept_total)
            deleted = np.bincount(block.at[n - 1], minlength=len(ml))
            seen = ml > 0
            logs = np.where(seen, np.log2(np.where(seen, ml, 1.0) / (lower if n == 1 else lower[block.suffix[n - 1]])), 0.0)
            step = np.where(seen, np.floor(logs * STEPS), UNSEEN).astype(np.int64)
            found = pd.DataFrame({"bucket": log_bucket(context), "step": step, "deleted": deleted, "logs": logs * deleted})
            del block, counts, lower, context, ml, deleted, logs, step
            found = found.groupby(["bucket", "step"], as_index=False).sum()
            trim_memory()
            return found

        return ratios

    deleting = given.where("kept is not null").select("block", "bucket", "n", "kept")
    for n in range(1, ORDER + 1):
        cells = blocks.where("deletes").groupBy("block").cogroup(deleting.groupBy("block")).applyInPandas(ratios_over(list(weights)), "bucket long, step long, deleted long, logs double")
        cells = cells.groupBy("bucket", "step").agg(F.sum("deleted").alias("deleted"), F.sum("logs").alias("logs")).orderBy("bucket", "step").toPandas()
        deleted_tokens = cells["deleted"].to_numpy(float)
        ratio = np.where(cells["step"] > UNSEEN, np.exp2(cells["logs"].to_numpy(float) / np.maximum(deleted_tokens, 1)), 0.0)
        learnt = context_weights(cells["bucket"].to_numpy(np.int64), ratio, deleted_tokens, 0.5 if n == 1 else 0.0)
        if n == 1:  # one context, as often as there are tokens, of which the deleted ones change the bucket
            learnt[1:] = learnt[log_bucket(np.array([kept_total]))[0]] if kept_total else 0.5
        weights.append(learnt)

    def score_block(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        block = Block(texts_of(row))
        counts = answered(block, known, "total")
        logs = np.log10(block.mixture(counts, weights, total, types))[block.at[-1]]
        word = block.at[0]
        base = np.log10((counts[0] + 0.1) / (total + 0.1 * (types + 1)))[word]
        known_words = (counts[0] > 0)[word].astype(np.int64)
        summed = lambda x: np.add.reduceat(x, block.starts)
        ids = pd.array(np.frombuffer(row["ids"], np.int64).copy(), "Int64")
        ids[~np.frombuffer(row["has_id"], bool)] = pd.NA
        out = pd.DataFrame({"doc_id": ids, "n_tokens": block.lengths, "n_known": summed(known_words), "train_tokens": total, "base_score": summed(base), "score": summed(logs)})
        del block, counts, logs, base, known_words
        trim_memory()
        return out

    return blocks.groupBy("block").cogroup(given.select("block", "bucket", "n", "total").groupBy("block")).applyInPandas(score_block, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = doc_bucket(F.col("doc_id"), 10)
    scored = score(table(spark, sf_dir, "documents"), bucket != 0, bucket == 1)
    return scored.select("doc_id", (bucket == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
