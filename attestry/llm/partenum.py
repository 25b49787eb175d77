"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Sets are put into bands of near-equal size;
within a band, Jaccard similarity of at least 0.8 means that two sets differ in at most k
features. The feature domain is cut by a hash into first-level parts and those into n2 second-level
parts, and a signature is the content of n2 - k2 second-level parts of one first-level part. As k
differences can't touch all of them, two similar sets share a signature.

Two empty contents agree too, which would make one signature common to all. They aren't emitted,
and nothing is lost by that: to spoil all non-empty signatures of a set, differences must hit
min(non-empty second-level parts, k2 + 1) of them in each first-level part, and if that sums to
more than k, one is left. The same holds for the set without very frequent features, since that
has no more differences, so these are left out first. A set with too few parts emits signatures of
all its features as well, and if those too are few, each feature; two such sets then meet there.

Equal sets are one node from the start. Nodes that share a signature are candidates, verified on
their features; a signature's bucket is worked off from its first members on, and left as soon as
all its nodes are in one component, so that a large group of near copies costs one pair a node.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.common import staged
from attestry.llm.components import components

WORDS = 5
FREQUENT_LEAST = 8
FREQUENT_MOST = 131_072
SPREAD = 1.3
SMALL = 16
STEP = 8
BLOCKED = 64
BLOCK = 256
CHUNK = 16_384

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-spread bits of each number."""
    x = (x + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1))) * MIX_A
    x = (x ^ (x >> np.uint64(31))) * MIX_B
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``WORDS``-word shingles of the whole text.

    A-Z are lowered and words end at ASCII white space only. Fewer words are one shingle, no
    word is the empty set.
    """
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(w))
    count = len(w) - width + 1
    h = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(32))) * MIX_A + w[k : k + count]
    return np.unique(mixed(h, 1))


def node_of(features: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(features.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands() -> list[int]:
    """Least sizes of the bands; each is at least 1.25 times, at most about 1.5 times, the last."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


BANDS = bands()


def bands_of(size: int) -> list[int]:
    """The set's own band, and the next if a similar set may be in it."""
    t = bisect.bisect_right(BANDS, size) - 1
    return [t, t + 1] if 5 * size >= 4 * BANDS[t + 1] else [t]


def layout(t: int) -> tuple[int, int, int, int]:
    """k, n1, n2 and k2 of band ``t``: two sets of sizes below the next band differ in k at most."""
    k = 2 * (BANDS[t + 1] - 1) // 9
    n2 = 3 if k <= SMALL else 2
    return k, max(1, int(np.ceil(SPREAD * (k + 1) / 2))), n2, 1


def part_signatures(features: np.ndarray, t: int, level: int) -> tuple[np.ndarray, int]:
    """Signatures of the non-empty contents, and how many differences it takes to spoil them all."""
    k, n1, n2, k2 = layout(t)
    if not len(features):
        return np.empty(0, dtype=np.uint64), 0
    part = (mixed(features, 100 + t) % np.uint64(n1 * n2)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at, first = np.unique(part[order], return_index=True)
    sums = np.zeros(n1 * n2, dtype=np.uint64)
    sums[at] = np.add.reduceat(mixed(features, 7)[order], first)
    filled = np.zeros(n1 * n2, dtype=bool)
    filled[at] = True
    sums, filled = sums.reshape(n1, n2), filled.reshape(n1, n2)
    strength = int(np.minimum(filled.sum(axis=1), k2 + 1).sum())
    out = []
    for number, subset in enumerate(combinations(range(n2), n2 - k2)):
        own = list(subset)
        some = np.flatnonzero(filled[:, own].any(axis=1))
        content = np.zeros(len(some), dtype=np.uint64)
        for column in own:
            content = mixed(content + sums[some, column], column + 1)
        place = some.astype(np.uint64) * np.uint64(n2 * 4) + np.uint64(number * 4 + level)
        out.append(mixed(content ^ mixed(place, 500 + t), 9))
    return np.concatenate(out), strength


def signatures(features: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """All signatures of a set; ``frequent`` is a sorted list of features to be left out at first."""
    found = []
    for t in bands_of(len(features)):
        k = layout(t)[0]
        if k == 0:
            continue  # only equal sets are similar here
        rare = features
        if len(frequent):
            spot = np.minimum(np.searchsorted(frequent, features), len(frequent) - 1)
            rare = features[frequent[spot] != features]
        own, strength = part_signatures(rare, t, 0)
        found.append(own)
        if strength <= k:
            own, strength = part_signatures(features, t, 1)
            found.append(own)
            if strength <= k:
                found.append(mixed(features ^ mixed(np.array([t], dtype=np.uint64), 3), 11))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, n, node, feature, df): a row per document, then one per frequent feature."""
    for batch in batches:
        sizes, nodes, own = [], [], {}
        for text in batch.column(1):
            features = shingles(text.as_py())
            sizes.append(len(features))
            nodes.append(node_of(features) if len(features) else None)
            if len(features):
                own[nodes[-1]] = features
        n = batch.num_rows
        if not n:
            continue
        blank = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), blank, blank],
            names=["doc_id", "text_hash", "n", "node", "feature", "df"],
        )
        if own:
            feature, df = np.unique(np.concatenate(list(own.values())), return_counts=True)
            often = df >= 2
            m = int(often.sum())
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(feature[often].view(np.int64)), pa.array(df[often].astype(np.int64))],
                names=["doc_id", "text_hash", "n", "node", "feature", "df"],
            )


def _signer(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            sig, node, held = [], [], 0
            for text in batch.column(0):
                features = shingles(text.as_py())
                if not len(features) or (own := node_of(features)) in done:
                    continue
                done.add(own)
                found = signatures(features, frequent)
                sig.append(found)
                node.append(np.full(len(found), own, dtype=np.int64))
                held += len(found)
                if held >= 1 << 19:
                    yield _packed(sig, node)
                    sig, node, held = [], [], 0
            if held:
                yield _packed(sig, node)

    return run


def _packed(sig: list[np.ndarray], node: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node))], names=["sig", "node"]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["node", "f"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) whose feature sets have 100 * intersection >= 80 * union."""
    left = sets.select(F.col("node").alias("a"), F.col("f").alias("fa"))
    right = sets.select(F.col("node").alias("b"), F.col("f").alias("fb"))
    fa, fb = F.size("fa"), F.size("fb")
    both = pairs.join(left, "a").join(right, "b").filter(F.least(fa, fb) * 5 >= F.greatest(fa, fb) * 4)
    same = F.size(F.array_intersect("fa", "fb"))
    return both.select("a", "b", same.alias("s"), fa.alias("na"), fb.alias("nb")).filter(
        "100 * s >= 80 * (na + nb - s)"
    ).select("a", "b")


def _unsettled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that aren't in one component."""
    bucket = W.partitionBy("sig")
    rooted = members.drop("root").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = rooted.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket))
    return staged(ends.filter("low < high").drop("low", "high"))


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join what large buckets hold, up to links that others of them imply.

    Buckets that overlap are one group, so that the same nodes in a hundred of them are compared
    once. A group's nodes are dealt over blocks of about ``BLOCK`` sets, and a task compares two
    blocks by products of their feature matrices. No pairs are written but a spanning forest.
    """
    leads = members.groupBy("sig").agg(F.min("node").alias("lead"))
    edges = members.select("sig", "node").join(leads, "sig").select("node", "lead").distinct()
    groups = components(edges, "node", "lead").withColumnRenamed("root", "g")
    sizes = groups.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    roots = members.select("node", "root").distinct()
    placed = (
        groups.join(sizes, "g").join(roots, "node").join(sets, "node")
        .select("g", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "root", "f")
    )

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[["g", "block"]].iloc[:1].reset_index(drop=True)
        return head.assign(
            nodes=[frame["node"].to_numpy("<i8").tobytes()], roots=[frame["root"].to_numpy("<i8").tobytes()],
            sizes=[frame["f"].map(len).to_numpy("<i8").tobytes()],
            features=[np.concatenate(frame["f"].to_list()).astype("<i8").tobytes()],
        )

    columns = ["nodes", "roots", "sizes", "features"]
    packed = staged(placed.groupBy("g", "block").applyInPandas(
        pack, "g long, block int, nodes binary, roots binary, sizes binary, features binary"
    ))
    other = packed.select("g", F.col("block").alias("block_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    pairs = packed.join(other, "g").filter("block <= block_b")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        a = [np.frombuffer(r[c], "<i8") for c in columns]
        b = [np.frombuffer(r[f"{c}_b"], "<i8") for c in columns]
        i, j = np.nonzero(similar_rows(a[2], a[3], b[2], b[3]) & (a[1][:, None] != b[1][None, :]))
        names, at = np.unique(np.r_[a[1][i], b[1][j]], return_inverse=True)
        keep = forest_edges(at[: len(i)], at[len(i) :], len(names))
        return pd.DataFrame({"a": a[0][i[keep]], "b": b[0][j[keep]]})

    return pairs.groupBy("g", "block", "block_b").applyInPandas(compare, "a long, b long")


def similar_rows(sizes_a: np.ndarray, flat_a: np.ndarray, sizes_b: np.ndarray, flat_b: np.ndarray) -> np.ndarray:
    """Boolean matrix of the sets, given one after the other, that have 100 * s >= 80 * union."""
    common = np.intersect1d(flat_a, flat_b)
    owners = [np.repeat(np.arange(len(s)), s) for s in (sizes_a, sizes_b)]
    shared = np.zeros((len(sizes_a), len(sizes_b)))
    for start in range(0, len(common), CHUNK):
        part, sides = common[start : start + CHUNK], []
        for flat, owner, n in ((flat_a, owners[0], len(sizes_a)), (flat_b, owners[1], len(sizes_b))):
            spot = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[spot] == flat
            side = np.zeros((n, len(part)), dtype=np.float32)
            side[owner[hit], spot[hit]] = 1
            sides.append(side)
        shared += sides[0] @ sides[1].T
    return 100 * shared >= 80 * (sizes_a[:, None] + sizes_b[None, :] - shared)


def forest_edges(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of edges that make a spanning forest of the graph on 0..n-1."""
    up, kept = list(range(n)), []
    for place, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(place)
    return np.array(kept, dtype=np.int64)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row of ``docs``.

    component_id is the smallest id that links reach, the row's own included; null ids are passed
    over unless there is no other. A null or empty text has no shingles and is alone. Rows with
    equal sets, repeated rows too, are always in one component. An empty table gives no rows;
    other columns aren't read. text_hash tells rows with the same id apart.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", "text_hash", "n_shingles", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``near_groups``, and root: one number for each component, null for rows alone by lack of text."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    described = staged(slim.mapInArrow(
        _describe, "doc_id long, text_hash long, n long, node long, feature long, df long"
    ))
    rows = described.filter("feature IS NULL").select("doc_id", "text_hash", "n", "node")
    often = (
        described.filter("feature IS NOT NULL").groupBy("feature").agg(F.sum("df").alias("df"))
        .filter(F.col("df") >= FREQUENT_LEAST).orderBy(F.desc("df"), "feature").limit(FREQUENT_MOST).select("feature").toArrow()
    )  # leaving some out, or too many in, changes the cost and not the result
    frequent = np.sort(np.asarray(often["feature"], dtype=np.int64).view(np.uint64))

    signed = slim.select("text").mapInArrow(_signer(frequent), "sig long, node long")
    bucket = W.partitionBy("sig")
    buckets = staged(
        signed.withColumn("low", F.min("node").over(bucket)).withColumn("high", F.max("node").over(bucket))
        .filter("low < high").select("sig", "node").distinct()
    )
    # A set that shares most with others, such as the text that copies were made from, goes first.
    counted = buckets.withColumn("m", F.count(F.lit(1)).over(bucket))
    scores = counted.groupBy("node").agg(F.sum(F.col("m") - 1).alias("score"))
    order = bucket.orderBy(F.desc("score"), "node")
    open_ = staged(
        counted.join(scores, "node").withColumn("k", F.row_number().over(order))
        .withColumn("first", F.first(F.struct("score", "node")).over(order))
    )

    wanted = open_.select("node").distinct()
    chosen = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    chosen = chosen.join(wanted, "node", "left_semi").select("node", F.col("r.doc_id").alias("rd"), F.col("r.text_hash").alias("rh"))
    texts = slim.join(chosen, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("text_hash") == F.col("rh")))
    sets = staged(texts.select("node", "text").mapInArrow(_features, "node long, f array<long>").dropDuplicates(["node"]))

    # First every node meets the best of all its buckets' first members.
    best = open_.filter("k > 1").groupBy("node").agg(F.max("first").alias("best"))
    tested = staged(best.select(F.col("best.node").alias("a"), F.col("node").alias("b")))
    links = staged(_verified(tested, sets))
    linked = components(links, "a", "b")
    open_ = _unsettled(open_.drop("first"), linked)

    # Then each bucket that isn't in one component tests its first member, then STEP times as many
    # and so on, against those after them. After the first, large buckets are compared in blocks.
    first, last = 1, 1
    while not open_.isEmpty():
        low = open_.filter(F.col("k").between(first, last)).select(
            "sig", F.col("node").alias("a"), F.col("k").alias("ka"), F.col("root").alias("ra")
        )
        high = open_.select("sig", F.col("node").alias("b"), F.col("k").alias("kb"), F.col("root").alias("rb"))
        pairs = low.join(high, "sig").filter("ka < kb AND ra <> rb").select("a", "b").distinct()
        pairs = staged(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        found = staged(_verified(pairs, sets))
        if not found.isEmpty():
            links = links.union(found)
            linked = components(links, "a", "b")
        if first == 1:
            large = _unsettled(open_.filter(F.col("m") > BLOCKED), linked)
            if not large.isEmpty():
                links = links.union(staged(_block_links(large, sets)))
                linked = components(links, "a", "b")
            open_ = open_.filter(F.col("m") <= BLOCKED)
        first, last = last + 1, last + STEP * (last - first + 1)
        open_ = _unsettled(open_.filter(F.col("m") >= first + 1), linked)

    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("own"))
    nodes = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.groupBy("root").agg(F.min("own").alias("component_id"))
    named = nodes.select("node", "root").join(smallest, "root").select("node", "root", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "root",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every component, with the same columns: that of the least id, then text hash; null ids come last."""
    groups = _grouped(docs, id_col, text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r")
    first = groups.filter("root IS NOT NULL").groupBy("root").agg(least).select("r.doc_id", "r.text_hash")
    alone = groups.filter("root IS NULL").select("doc_id", "text_hash").distinct()
    keep = first.unionByName(alone).select(F.col("doc_id").alias("__keep_id"), F.col("text_hash").alias("__keep_hash"))
    own = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(
        keep, docs[id_col].cast("long").eqNullSafe(F.col("__keep_id")) & (own == F.col("__keep_hash")), "left_semi"
    )
