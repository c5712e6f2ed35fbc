"""Removal of repeated passages by compacting a De Bruijn graph of words.

An edge is a window of WINDOW words; two windows that follow each other in a text share all but one word, the node between
them. A word goes if a window over it has the same words as one that starts earlier: in a document of smaller doc_id, or
before it in the same document. Which windows repeat is found without a row for each of them:

1. Each window is named after its anchor, the ANCHOR-word sequence in it of the least hash (the first of equal ones). Equal
   windows have equal anchors. Neighbouring windows with one anchor form a piece, a path of at most
   WINDOW - ANCHOR + 1 edges. Anchors that occur once are dropped, and with them all windows that cannot repeat.
2. Pieces are grouped by their words (anchor and a 64-bit hash of all windows): how often, where first, which piece follows.
3. Pieces whose anchor has other pieces, too, are where paths branch or end. Their windows are compared one by one, but
   only at the first place of each such piece, as all its later places repeat that one as a whole.
4. A piece is joined with the piece that follows it everywhere and occurs as often, at the coordinates that continue it; runs
   of such links, a nonbranching path, become one long span with one head.
5. Later places of heads are looked up, and stand for all pieces of their path. Before words go, the words between the
   span's coordinates are compared with those of its first place by a digest of their own.

Keys that very many rows have (anchors, pieces and windows of common passages) are counted before they are joined, and sent
to all executors instead of meeting in one task (spread_join). What a document gets is bounded by its own length.

Words are runs of anything but ASCII white space, compared byte by byte. Null and empty texts have no words; texts of fewer
than WINDOW words lose none. Rows of one doc_id count as one document whose places overlap: a window at the same place of
two rows is not earlier in either, so repeated rows all keep it. Null ids come before all others, and count as one such
document. Very long texts are worked on whole. Columns besides doc_id and text play no part, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mixed, small_batches, spread_join, table, tidily
from .hashing import numbers, pieces, word_hashes

WINDOW, ANCHOR = 20, 8
_U = np.uint64


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each n words in a row: a polynomial of the words' hashes, by runs of 1, 2, 4 and so on, then mixed."""
    factor = numbers(seed, 1) | _U(1)  # arrays of one, as scalars warn of overflow
    out, done = np.zeros(max(0, len(words) - n + 1), _U), 0
    power, shift, run, size = factor, np.ones(1, _U), words, 1
    while size <= n:
        if n & size:
            out += run[done : done + len(out)] * shift
            done, shift = done + size, shift * power
        if 2 * size <= n:
            run = run[:-size] + run[size:] * power
        power, size = power * power, 2 * size
    return mixed(out)


def least_places(keys: np.ndarray, span: int) -> np.ndarray:
    """Of each run of span keys the place of the least, by the upper 32 bits; the first of equal ones."""
    packed = (keys & _U(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=_U)
    size = 1
    while 2 * size <= span:
        packed, size = np.minimum(packed[:-size], packed[size:]), 2 * size
    if size < span:
        packed = np.minimum(packed[: len(packed) - (span - size)], packed[span - size :])
    return (packed & _U(0xFFFFFFFF)).astype(np.int64)


class Texts:
    """The words of some texts, and which of their windows lie within one text."""

    def __init__(self, texts: list[bytes], window: int):
        self.words, self.sizes = word_hashes(texts, lower=False)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.window = window
        of = np.repeat(np.arange(len(texts)), self.sizes)
        n = max(0, len(self.words) - window + 1)
        self.at = np.flatnonzero(of[:n] == of[window - 1 :]) if n else np.empty(0, np.int64)
        self.text = of[self.at]

    def edges(self, seed: int) -> np.ndarray:
        return grams(self.words, self.window, seed)


def runs(texts: list[bytes], window: int, anchor: int) -> dict[str, np.ndarray]:
    """The pieces of all texts: text, pos (of the first window), size (windows), m (anchor), c (words), next (the c of the
    piece after it, 0 at a text's end)."""
    t = Texts(texts, window)
    if not len(t.at):
        return {k: np.empty(0, np.int64) for k in ("text", "pos", "size", "m", "c", "next")}
    anchors = grams(t.words, anchor, 11)
    span = window - anchor + 1
    least = least_places(anchors, span)[t.at]
    new = np.ones(len(t.at), bool)
    new[1:] = (least[1:] != least[:-1]) | (t.text[1:] != t.text[:-1])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(t.at)))
    offset = np.arange(len(t.at)) - np.repeat(starts, size)
    weights = numbers(12, span) | _U(1)
    c = mixed(np.add.reduceat(t.edges(13)[t.at] * weights[offset], starts) + size.astype(_U))
    c[c == 0] = 1
    text = t.text[starts]
    after = np.zeros(len(c), _U)
    after[:-1] = np.where(text[1:] == text[:-1], c[1:], _U(0))
    return {"text": text, "pos": t.at[starts] - t.first[text], "size": size, "m": anchors[least[starts]].view(np.int64), "c": c.view(np.int64), "next": after.view(np.int64)}


def keyed(docs: DataFrame) -> DataFrame:
    """doc, t, text: t tells apart rows of one doc_id with different texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.hash(F.col("text")).alias("t"), "text")


def pieces_of(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc, t, pos, size, m, c, next of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in pieces(batch.column("text").to_pylist()):
                found = runs(some, window, anchor)
                here = batch.slice(at, len(some))
                at += len(some)
                if not len(found["text"]):
                    continue
                of = pa.array(found["text"])
                yield pa.RecordBatch.from_pydict({"doc": here.column("doc").take(of), "t": here.column("t").take(of), "pos": pa.array(found["pos"].astype(np.int32)), "size": pa.array(found["size"].astype(np.int32)), **{k: pa.array(found[k]) for k in ("m", "c", "next")}})

    return keyed(docs).mapInArrow(tidily(run), "doc long, t int, pos int, size int, m long, c long, next long")


def digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "big", signed=True)


def looked_at(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """places: doc, t, xs (pos, size, windows). For those of windows a row for each window with a hash of 128 bits in e and
    f; for the others one row with the digest of their words in e. doc, t, pos, windows, e, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in pieces(batch.column("text").to_pylist()):
                here = batch.slice(begin, len(texts))
                begin += len(texts)
                lists = here.column("xs")
                places, of = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                pos, size, compared = (places.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "size", "windows"))
                t = Texts(texts, window)
                each = np.repeat(np.flatnonzero(compared), size[compared])
                step = np.arange(len(each)) - np.repeat(np.cumsum(size[compared]) - size[compared], size[compared])
                at = t.first[of[each]] + pos[each] + step
                found = []
                for i in np.flatnonzero(~compared).tolist():
                    if not found or found[-1][0] != of[i]:
                        split = texts[of[i]].split()
                    found.append((of[i], pos[i], digest(split[pos[i] : pos[i] + size[i]])))
                spans = np.array(found, np.int64).reshape(-1, 3)
                text = pa.array(np.concatenate([of[each], spans[:, 0]]))
                none = np.zeros(len(spans), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc": here.column("doc").take(text), "t": here.column("t").take(text), "pos": pa.array(np.concatenate([pos[each] + step, spans[:, 1]]).astype(np.int32)),
                    "windows": pa.array(np.arange(len(text)) < len(each)), "e": pa.array(np.concatenate([t.edges(13)[at].view(np.int64), spans[:, 2]])),
                    "f": pa.array(np.concatenate([t.edges(14)[at].view(np.int64), none])),
                })

    joined = with_lists(docs, places, "inner")
    return joined.mapInArrow(tidily(run), "doc long, t int, pos int, windows boolean, e long, f long")


def with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs with the list xs of their places."""
    right = lists.select(F.col("doc").alias("__doc"), F.col("t").alias("__t"), "xs")
    left = keyed(docs)
    return left.join(right.hint("shuffle_hash"), left["doc"].eqNullSafe(F.col("__doc")) & (left["t"] == F.col("__t")), how).select("doc", "t", "text", "xs")


def listed(places: DataFrame, *columns: str) -> DataFrame:
    return places.groupBy("doc", "t").agg(F.collect_set(F.struct(*columns)).alias("xs"))


def paths_of(contents: DataFrame) -> DataFrame:
    """Of contents (distinct pieces that occur k >= 2 times) the nonbranching paths: m, c and n of the head, doc, t, pos of
    its first place, and size, the windows of the path."""
    a = contents.select(F.col("succ").alias("a_succ"), F.col("k").alias("a_k"), F.col("doc").alias("a_doc"), F.col("t").alias("a_t"), (F.col("pos") + F.col("size")).alias("a_end")).where("a_succ is not null")
    same = (F.col("a_succ") == F.col("c")) & (F.col("a_k") == F.col("k")) & F.col("a_doc").eqNullSafe(F.col("doc")) & (F.col("a_t") == F.col("t")) & (F.col("a_end") == F.col("pos"))
    linked = contents.join(a, same, "left").withColumn("head", F.col("a_end").isNull()).select("m", "c", "k", "doc", "t", "pos", "size", "head").distinct()
    # pieces of a path lie one after the other at its first place
    along = linked.withColumn("path", F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc", "t").orderBy("pos")))
    first = lambda c: F.min_by(c, "pos").alias(c)
    return along.groupBy("doc", "t", "path").agg(F.min("pos").alias("pos"), first("m"), first("c"), F.min("k").alias("n"), F.sum("size").cast("int").alias("size")).drop("path")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, t, xs: of each row with repeated windows the spans (pos, words, e) whose words go; e is the digest that the words
    of a span must have, null where windows were compared one by one."""
    small_batches(docs.sparkSession)
    c = F.col
    place = F.struct("doc", "pos")
    found = pieces_of(docs, window, anchor)
    shared = materialize(found.groupBy("m").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    rows = shared.agg(F.sum("n")).first()[0] or 0
    repeated = materialize(spread_join(found, shared, ["m"], rows), "pieces")
    first = F.min(F.struct("doc", "pos", "t"))
    contents = repeated.groupBy("m", "c").agg(
        F.count("*").alias("k"), F.max("size").alias("size"), first.alias("first"),
        F.when((F.min("next") == F.max("next")) & (F.min("next") != 0), F.min("next")).alias("succ"),
    )
    contents = materialize(contents.select("m", "c", "k", "size", "succ", "first.*"), "contents")
    kinds = contents.groupBy("m").agg(F.count("*").alias("n"), F.lit(True).alias("branching")).where("n > 1")
    branches = spread_join(contents, kinds, ["m"], contents.count())
    paths = materialize(paths_of(contents.where("k > 1")), "paths")
    # what is looked at in the texts: windows of branching pieces, and the words of paths, at their first places
    words = (c("size") + window - 1).alias("size")
    wanted = branches.select("doc", "t", "pos", "size", F.lit(True).alias("windows")).unionByName(paths.select("doc", "t", "pos", words, F.lit(False).alias("windows")))
    seen = materialize(looked_at(docs, listed(wanted, "pos", "size", "windows"), window), "edges")
    edges = seen.where("windows")
    firsts = edges.groupBy("e", "f").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    late = spread_join(edges.select("doc", "t", "pos", "e", "f"), firsts, ["e", "f"], edges.count()).where(place > c("first"))
    late = late.select("doc", "t", "pos", F.lit(window).alias("words"), F.lit(None).cast("long").alias("e"))
    digests = seen.where("not windows").select(c("doc").alias("d"), c("t").alias("u"), c("pos").alias("p"), "e").distinct()
    known = paths.join(digests, c("doc").eqNullSafe(c("d")) & (c("t") == c("u")) & (c("pos") == c("p")))
    heads = materialize(known.select("m", "c", "n", F.struct("doc", "pos").alias("first"), (c("size") + window - 1).alias("words"), "e"), "heads")
    copies = spread_join(repeated.select("m", "c", "doc", "t", "pos"), heads, ["m", "c"], rows).where(place > c("first"))
    return materialize(listed(copies.select("doc", "t", "pos", "words", "e").unionByName(late), "pos", "words", "e"), "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("xs").to_pylist(), strict=True):
                words = (text or "").encode().split()
                keep = np.ones(len(words), bool)
                for x in spans or ():
                    a, b = x["pos"], x["pos"] + x["words"]
                    if x["e"] is None or digest(words[a:b]) == x["e"]:
                        keep[a:b] = False
                if spans:
                    kept = list(compress(words, keep.tolist()))
                else:
                    kept = words
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string())})

    return with_lists(docs, repeated_spans(docs, window, anchor), "left").mapInArrow(tidily(run), "doc_id long, n_words long, n_removed long, kept string")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))
