"""Near-duplicates by a chosen-path set similarity join.

Every document becomes the set of its word shingles and a signature of minwise tokens. Copies (equal sets) are
joined at once and one of each group goes on. In each of several independent trees a document follows the path of
its minwise tokens: a node is the documents that agree on the tokens chosen so far. Nodes of up to NODE documents
are leaves; larger ones branch on further tokens, which the node itself chooses (a quarter of the nodes choose two,
so a similar pair stays together somewhere at each level about as surely as on the one before), but for families of
near copies, which no token divides and which are leaves of any size. Leaves compare all
their signatures; what may reach the threshold (within six standard errors) goes on to an exact comparison of whole
shingle sets, once for each group of connected candidates, or leaf by leaf where a group is beyond a bound. The
confirmed links' connected components are the classes.

A group too large for one task is a family of near copies, or ends up as such when no branch divides it. It is dealt
into blocks, each compared within itself and with a few pivots of the whole group. Mostly all are then connected; what
is not connected with the group's largest part is compared with all of the group, in chunks. So links that would only
repeat a connection are not looked for, and none between different components is missed.

Two documents at the threshold of 0.8 share a tree's first token with probability 0.8, so 12 trees miss them with
probability 0.2 ** 12 at a depth of one; signatures drop one in 10^8 pairs at the threshold.

Results: a row for each row of the input. Null and empty texts, and texts without a word, have 0 shingles, link
with nothing and stand for themselves. Rows of one doc_id are separate documents of that name. A row with a null
doc_id gives way to an exact copy with an id; other links cannot name it, so it stays. Very long texts are compared
whole, an empty table gives no rows, extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, materialize, mixed, small_batches, spread_join, table, tidily
from .graph import components
from .hashing import numbers, pieces, word_hashes

#: Minwise tokens in a signature, of 32 bits each.
TOKENS = 64
TREES = 12
#: Levels that branch by tokens before what is still too large is compared in blocks.
DEPTH = 3
#: Documents in a leaf, or in a block, at most.
NODE = 1500
#: Share of a node's documents that have to be like one of them for it to be a family, which does not branch.
FAMILY = 31 / 32
#: Documents of a larger group, about, that all its blocks are compared with.
PIVOTS = 32
#: Shingles in a group that one task compares, about.
GROUP_SHINGLES = 1_500_000

_U = np.uint64


_PERMUTE, _SHIFT = numbers(2, TOKENS) | _U(1), numbers(3, TOKENS)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of the whole sequence if it is shorter."""
    factors = numbers(5, k) | _U(1)
    for piece in pieces(texts):
        words, per_text = word_hashes(piece)
        if len(words) >= k:
            n = len(words) - k + 1
            joined = words[:n] * factors[0]
            for i in range(1, k):
                joined = joined + words[i : n + i] * factors[i]
            joined = mixed(joined)
        at = 0
        for n in per_text.tolist():
            if n >= k:
                yield np.unique(joined[at : at + n - k + 1])
            elif n:
                yield mixed((words[at : at + n] * factors[:n]).sum(keepdims=True, dtype=_U) + _U(n))
            else:
                yield np.empty(0, _U)
            at += n


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(TOKENS, ~_U(0))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, (_PERMUTE[:, None] * part[None, :] + _SHIFT[:, None]).min(axis=1), out=least)
    return (least >> _U(32)).astype(np.uint32)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that tell sets apart, and the signature (null without shingles)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 1000):
                piece = part.iloc[at : at + 1000]
                rows = []
                for s in shingle_sets(piece["text"].tolist(), k):
                    sums = s.sum(dtype=_U), mixed(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)
                    rows.append((len(s), *(int(x.astype(np.int64)) for x in sums), signature(s).tobytes() if len(s) else None))
                out = pd.DataFrame(rows, columns=["n_shingles", "sum1", "sum2", "sig"])
                out.insert(0, "doc_id", piece["doc_id"].to_numpy())
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidily(run), "doc_id long, n_shingles long, sum1 long, sum2 long, sig binary")


def grouped(parts: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of one key after another, from batches that are sorted by it."""
    rest: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        keys = part[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if rest and rest[-1][key].iat[0] != keys[a]:
                yield rest[0] if len(rest) == 1 else pd.concat(rest)
                rest = []
            rest.append(part.iloc[a:b])
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest)


def stars(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id of its component) for each component of two or more; linked: which rows are linked."""
    unseen, found = np.ones(len(ids), bool), []
    for i in np.flatnonzero(linked.sum(axis=1) > 1).tolist():
        if unseen[i]:
            members, frontier = np.zeros(len(ids), bool), np.array([i])
            while len(frontier):
                members[frontier] = True
                frontier = np.flatnonzero(linked[frontier].any(axis=0) & ~members)
            unseen &= ~members
            own = ids[members]
            root = int(own.min())
            found += [(x, root) for x in own.tolist() if x != root]
    return found


def candidates(parts: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """From rows node, rep, sig sorted by node: stars of representatives whose signatures agree in least of the tokens."""
    found: list[tuple[int, int]] = []
    for group in grouped(parts, "node"):
        ids = group["rep"].to_numpy()
        if len(ids) < 2:
            continue
        sigs = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(ids), TOKENS)
        if len(ids) == 2:
            if (sigs[0] == sigs[1]).mean() >= least and ids[0] != ids[1]:
                found.append((int(ids.max()), int(ids.min())))
        else:
            agree = np.zeros((len(ids), len(ids)), np.uint8)
            for t in range(TOKENS):
                agree += sigs[:, t, None] == sigs[None, :, t]
            found += stars(agree >= least * TOKENS, ids)
        if len(found) > 20_000:
            yield pd.DataFrame(found, columns=["a", "b"])
            found = []
    yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The exact sizes of all pairwise intersections."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    df = np.diff(np.concatenate([starts, [len(values)]]))
    common = np.zeros((m, m), np.float32)
    few = 8 if m > 64 else 1
    for size in range(2, few + 1):  # shingles of few documents: count their pairs
        at = starts[df == size]
        if len(at):
            own = owner[at[:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            common += np.bincount((own[:, i] * m + own[:, j]).ravel(), minlength=m * m).reshape(m, m)
    many = np.flatnonzero(df > few) if few > 1 else np.flatnonzero(df > 1)
    step = max(1, 8_000_000 // m)
    upper = np.zeros((m, m), np.float32)
    for at in range(0, len(many), step):
        chosen = many[at : at + step]
        sizes = df[chosen]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = owner[np.arange(int(sizes.sum())) - np.repeat(first, sizes) + np.repeat(starts[chosen], sizes)]
        x = np.zeros((m, len(chosen)), np.float32)
        x[rows, np.repeat(np.arange(len(chosen)), sizes)] = 1
        upper += x @ x.T
    return np.maximum(common, common.T) + upper if few == 1 else common + common.T + upper


def confirmed(parts: Iterator[pd.DataFrame], k: int, percent: int) -> Iterator[pd.DataFrame]:
    """From rows grp, rep, text sorted by grp: stars of documents with 100 * intersection >= percent * union."""
    for group in grouped(parts, "grp"):
        ids = group["rep"].to_numpy()
        if len(ids) < 2:
            continue
        sets = list(shingle_sets(group["text"].tolist(), k))
        sizes = np.array([len(s) for s in sets], np.float64)
        common = intersections(sets).astype(np.float64)
        linked = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
        np.fill_diagonal(linked, True)
        if found := stars(linked, ids):
            yield pd.DataFrame(found, columns=["a", "b"])


def token(at) -> F.Column:
    return F.substring("sig", at * 4 + 1, 4)


def with_family(large: DataFrame, rows: int) -> DataFrame:
    """large: rep, node, n, sig. Adds family: whether nearly all documents of the node are like one of them, so that
    further tokens would not divide it."""
    c = F.col
    one = large.groupBy("node").agg(F.min(F.struct("rep", "sig"))["sig"].alias("one"), F.max("n").alias("size"))
    met = spread_join(large, one, ["node"], rows, n="size", fewest=NODE + 1)
    alike = sum((F.substring("sig", at, 4) == F.substring("one", at, 4)).cast("int") for at in range(1, 4 * TOKENS, 16))
    share = met.groupBy("node").agg(F.avg((alike >= TOKENS // 8).cast("int")).alias("share"), F.max("n").alias("size"))
    flags = share.select("node", (c("share") >= FAMILY).alias("family"), "size")
    return spread_join(large, flags, ["node"], rows, n="size", fewest=NODE + 1)


def tree_leaves(reps: DataFrame, n_reps: int) -> tuple[DataFrame, list[DataFrame]]:
    """reps: rep, sig. The leaves (node, rep, n) with n documents, two or more, of all trees, and tables to drop later.
    Families and leaves of the last level may be larger than NODE."""
    c = F.col
    first = [F.xxhash64(F.lit(t), token(F.lit(5 * t % TOKENS))) for t in range(TREES)]
    level = reps.select("rep", F.explode(F.array(*first)).alias("node"))
    leaves, tables = [], []
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", c("n"))
        held = materialize(spread_join(level, sizes, ["node"], 2 * TREES * n_reps).select("node", "rep", c("size").alias("n")), "nodes")
        tables.append(held)
        large = held.where(c("n") > NODE)
        if depth == DEPTH or large.isEmpty():
            leaves.append(held)
            break
        # documents of one id meet the signatures of all of them: once each
        plain = materialize(large.join(reps, "rep").distinct(), "signed")
        signed = materialize(with_family(plain, 2 * TREES * n_reps), "large")
        drop_tables(plain)
        tables.append(signed)
        leaves += [held.where(c("n") <= NODE), signed.where("family").select("node", "rep", "n")]
        large = signed.where(~c("family"))
        if large.isEmpty():
            break
        coordinate = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(TOKENS)).cast("int")
        child = lambda salt: F.xxhash64("node", F.lit(salt), token(coordinate(salt)))
        twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4)) == 0
        level = large.select("rep", F.explode(F.when(twice, F.array(child(1), child(2))).otherwise(F.array(child(1)))).alias("node"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, tables


def group_links(groups: DataFrame, compare: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links (a, b) that connect each group as all links of its documents would. groups: grp, rep, n (documents), parts
    (blocks that it has to be dealt into); compare: from grp, rep to all links within each group."""
    c = F.col
    groups = keep(groups, "groups")
    single = groups.where("parts = 1").select("grp", "rep")
    if groups.where("parts > 1").isEmpty():
        return compare(single)
    many = groups.where("parts > 1").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(11)), c("parts")).cast("int"))
    all_parts = F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("own")
    pivots = many.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 30)) * c("n") < (1 << 30) * PIVOTS).select("grp", "rep", all_parts)
    blocks = many.select("grp", "rep", "own").unionByName(pivots).distinct().select(F.xxhash64("grp", "own").alias("grp"), "rep")
    links = keep(compare(single.unionByName(blocks)), "links")

    connected = components(links)
    settled = keep(many.join(connected.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "settled")
    shares = settled.groupBy("grp", "root").agg(F.count("*").alias("held")).groupBy("grp").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.sum("held").alias("n"), F.max("held").alias("most"))
    apart = shares.where("n > most").withColumn("size", c("n"))
    chunks = F.ceil((c("size") - c("most")) * c("parts") / c("size")).cast("int")
    placed = spread_join(settled.drop("n"), apart, ["grp"], settled.count()).select("grp", "rep", "own", "parts", (c("root") != c("main")).alias("rest"), chunks.alias("chunks"))
    placed = keep(placed, "placed")
    if placed.isEmpty():
        return links
    # every document of a block meets every chunk of what is left over
    everyone = placed.select("grp", "rep", "own", F.explode(F.sequence(F.lit(0), c("chunks") - 1)).alias("chunk"))
    rest = placed.where("rest").select("grp", "rep", all_parts, F.pmod(F.xxhash64("rep", F.lit(23)), c("chunks")).cast("int").alias("chunk"))
    again = everyone.unionByName(rest).distinct().select(F.xxhash64("grp", "own", "chunk").alias("grp"), "rep")
    return links.unionByName(compare(again))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id (the least linked doc_id), kept."""
    c = F.col
    small_batches(docs.sparkSession)
    tables: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        tables.append(materialize(df, name))
        return tables[-1]

    docs = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
    same = ["sum1", "sum2", "n_shingles"]
    sketched = keep(sketch(docs, k), "sketches")
    n_docs = sketched.count()
    copies = keep(sketched.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    members = spread_join(sketched, copies.withColumns({"copies": c("n"), "copied": F.lit(True)}), same, n_docs, how="left")
    members = members.withColumn("rep", F.when(c("copied"), c("rep")).otherwise(c("doc_id"))).select("doc_id", "n_shingles", "rep", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(c("doc_id") == c("rep"), c("sig")).alias("sig"))
    members = materialize(members, "members")
    reps = members.where("sig is not null").select("rep", "sig")

    leaves, held = tree_leaves(reps, n_docs)
    tables += held
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / TOKENS) ** 0.5

    def similar(groups: DataFrame) -> DataFrame:
        signed = groups.select(c("grp").alias("node"), "rep").join(reps, "rep")
        return signed.repartition("node").sortWithinPartitions("node").mapInPandas(tidily(lambda parts: candidates(parts, least)), "a long, b long")

    def exact(groups: DataFrame) -> DataFrame:
        # written first: where candidates are few, Spark then sends them to the texts instead of shuffling all texts
        compared = keep(groups, "compared")
        texts = docs.join(compared, docs["doc_id"] == compared["rep"]).select("grp", "rep", "text")
        return texts.repartition("grp").sortWithinPartitions("grp").mapInPandas(tidily(lambda parts: confirmed(parts, k, percent)), "a long, b long")

    found = group_links(leaves.select(c("node").alias("grp"), "rep", "n", F.ceil(c("n") / NODE).cast("int").alias("parts")), similar, keep)
    weighed = keep(components(found).join(members.where("sig is not null").select(c("rep").alias("id"), "n_shingles").dropDuplicates(["id"]), "id"), "candidates")
    sums = weighed.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).withColumn("size", c("n"))
    rooted = keep(spread_join(weighed, sums, ["root"], n_docs), "rooted")
    groups = rooted.where(c("size") <= NODE).select(c("root").alias("grp"), c("id").alias("rep"), c("size").alias("n"), "weight")
    beyond = rooted.where(c("size") > NODE).select(c("id").alias("rep"), "root", "n_shingles")
    if not beyond.isEmpty():
        within = keep(leaves.select("node", "rep").join(beyond, "rep").select(F.xxhash64("node", "root").alias("grp"), "rep", "n_shingles").distinct(), "within")
        heavy = within.groupBy("grp").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("n")).where("n > 1").withColumn("size", c("n"))
        groups = groups.unionByName(spread_join(within, heavy, ["grp"], 2 * TREES * n_docs).select("grp", "rep", c("size").alias("n"), "weight"))
    links = group_links(groups.select("grp", "rep", "n", F.ceil(c("weight") / GROUP_SHINGLES).cast("int").alias("parts")), exact, keep)
    classes = components(links)

    drop_tables(*tables)
    classes = classes.withColumnRenamed("id", "rep").join(members.where("sig is not null").groupBy("rep").agg(F.max("copies").alias("n")), "rep")
    component = F.coalesce("root", "rep")
    return spread_join(members, classes, ["rep"], n_docs, how="left").select("doc_id", "n_shingles", component.alias("component_id"), c("doc_id").eqNullSafe(component).alias("kept"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
