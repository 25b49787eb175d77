"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Vectors of one label are dealt over shards of bounded size and each shard gets a graph. Every
vector then asks every shard of its label: a task holds the graphs of two shards and asks each
with the vectors of the other, widening the beam until a brute-force audit of some of them finds
nothing missing. What is found is verified by cosine in double precision; a task hands on link
counts and a spanning forest, never its pairs, and the forests are joined to components.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import staged
from attestry.llm.components import components

SHARD = 8_192
AUDITED = 256
MARGIN = 0.01


class Graph:
    """The layers of one shard; ``unit`` are its vectors at length 1."""

    def __init__(self, unit: np.ndarray, links: int = 12, beam: int = 40, seed: int = 5):
        self.unit, self.links, self.beam = np.ascontiguousarray(unit, dtype=np.float32), links, beam
        n = len(unit)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(links)).astype(int), 12)
        self.near = np.full((n, 2 * links), -1, dtype=np.int32)
        self.degree = np.zeros(n, dtype=np.int32)
        self.upper: list[dict[int, list[int]]] = []
        self.entry = -1
        self.seen = np.zeros(n, dtype=np.int64)
        self.stamp = 0
        for i in range(n):
            self._insert(i)

    def _neighbours(self, node: int, layer: int) -> np.ndarray:
        if layer == 0:
            return self.near[node, : self.degree[node]]
        return np.array(self.upper[layer - 1].get(node, ()), dtype=np.int32)

    def _beam(self, q: np.ndarray, starts: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` most similar nodes that a best-first walk from ``starts`` meets, best first."""
        self.stamp += 1
        seen, stamp, unit = self.seen, self.stamp, self.unit
        first = list(dict.fromkeys(starts))
        seen[first] = stamp
        sims = (unit[first] @ q).tolist()
        todo = [(-s, c) for s, c in zip(sims, first)]
        heapq.heapify(todo)
        best = [(s, c) for s, c in zip(sims, first)]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            around = self._neighbours(node, layer)
            around = around[seen[around] != stamp]
            if not len(around):
                continue
            seen[around] = stamp
            found = unit[around] @ q
            if len(best) >= width:
                better = found > best[0][0]
                around, found = around[better], found[better]
            for sim, c in zip(found.tolist(), around.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (sim, c))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, c))
                else:
                    continue
                heapq.heappush(todo, (-sim, c))
        return sorted(best, reverse=True)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to ``most`` neighbours, each nearer to the node than to a neighbour kept before it."""
        if len(found) <= 1:
            return [c for _, c in found]
        nodes = [c for _, c in found]
        between = (self.unit[nodes] @ self.unit[nodes].T).tolist()
        kept: list[int] = []
        for i, (sim, _) in enumerate(found):
            row = between[i]
            if all(row[k] < sim for k in kept):
                kept.append(i)
                if len(kept) == most:
                    break
        if len(kept) < most:
            taken = set(kept)
            kept += [i for i in range(len(found)) if i not in taken][: most - len(kept)]
        return [nodes[i] for i in kept]

    def _connect(self, node: int, other: int, layer: int) -> None:
        most = 2 * self.links if layer == 0 else self.links
        if layer == 0:
            d = self.degree[node]
            if d < most:
                self.near[node, d] = other
                self.degree[node] = d + 1
                return
            around = [*self.near[node].tolist(), other]
        else:
            around = [*self.upper[layer - 1].setdefault(node, []), other]
            if len(around) <= most:
                self.upper[layer - 1][node] = around
                return
        sims = (self.unit[around] @ self.unit[node]).tolist()
        kept = self._spread(sorted(zip(sims, around), reverse=True), most)
        if layer == 0:
            self.near[node, : len(kept)] = kept
            self.degree[node] = len(kept)
        else:
            self.upper[layer - 1][node] = kept

    def _insert(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.upper = [{} for _ in range(top)]
            self.entry = i
            return
        q, high = self.unit[i], len(self.upper)
        starts = [self.entry]
        for layer in range(high, top, -1):
            starts = [self._beam(q, starts, 1, layer)[0][1]]
        for layer in range(min(top, high), -1, -1):
            found = self._beam(q, starts, self.beam, layer)
            for other in (kept := self._spread(found, self.links)):
                self._connect(other, i, layer)
            if layer == 0:
                self.near[i, : len(kept)] = kept
                self.degree[i] = len(kept)
            else:
                self.upper[layer - 1][i] = kept
            starts = [c for _, c in found]
        if top > high:
            self.upper += [{} for _ in range(top - high)]
            self.entry = i

    def within(self, q: np.ndarray, least: float, width: int, own: int | None = None) -> np.ndarray:
        """Nodes with similarity of at least ``least``: a beam, then all that is linked to its finds."""
        starts = [self.entry]
        for layer in range(len(self.upper), 0, -1):
            starts = [self._beam(q, starts, 1, layer)[0][1]]
        found = self._beam(q, starts + ([own] if own is not None else []), width, 0)
        edge = np.array([c for s, c in found if s >= least], dtype=np.int64)
        got = [edge]
        self.stamp += 1
        self.seen[edge] = self.stamp
        while len(edge):
            around = np.unique(self.near[edge])
            around = around[around >= 0]
            around = around[self.seen[around] != self.stamp]
            self.seen[around] = self.stamp
            edge = around[self.unit[around] @ q >= least]
            got.append(edge)
        return np.concatenate(got)

    def pack(self) -> bytes:
        upper = {f"u{k}": np.array([(a, b) for a, bs in layer.items() for b in bs], dtype=np.int32).reshape(-1, 2)
                 for k, layer in enumerate(self.upper)}
        import io

        np.savez(out := io.BytesIO(), near=self.near, degree=self.degree, entry=self.entry, **upper)
        return out.getvalue()

    @classmethod
    def unpack(cls, unit: np.ndarray, data: bytes) -> Graph:
        import io

        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as stored:
            self.near, self.degree, self.entry = stored["near"], stored["degree"], int(stored["entry"])
            self.upper = []
            while f"u{len(self.upper)}" in stored:
                layer: dict[int, list[int]] = {}
                for a, b in stored[f"u{len(self.upper)}"].tolist():
                    layer.setdefault(a, []).append(b)
                self.upper.append(layer)
        self.unit = np.ascontiguousarray(unit, dtype=np.float32)
        self.seen, self.stamp = np.zeros(len(unit), dtype=np.int64), 0
        return self


def ask(graph: Graph, there: np.ndarray, here: np.ndarray, least: float, width: int, same: bool) -> np.ndarray:
    """Boolean (here x there) of pairs found whose cosine is at least ``least``; unit vectors in double."""
    asked = here.astype(np.float32)
    links = np.zeros((len(here), len(there)), dtype=bool)
    for i in range(len(here)):
        near = graph.within(asked[i], least - MARGIN, width, i if same else None)
        links[i, near[there[near] @ here[i] >= least]] = True
    return links


def audited(links: np.ndarray, here: np.ndarray, there: np.ndarray, least: float, same: bool) -> tuple[int, int]:
    """Of ``AUDITED`` rows' links by brute force: how many were found, how many there are."""
    rows = np.unique(np.linspace(0, len(here) - 1, min(AUDITED, len(here))).astype(int))
    truth = here[rows] @ there.T >= least
    if same:
        truth[np.arange(len(rows)), rows] = False
    return int((links[rows] & truth).sum()), int(truth.sum())


def link_shards(a: tuple[Graph, np.ndarray], b: tuple[Graph, np.ndarray] | None, least: float, wanted_recall: float) -> np.ndarray:
    """Links between two shards, or within one: each asks the other, and a pair found either way counts.

    The beam widens four times each time that the audit of either side finds fewer than
    ``wanted_recall`` of the links, until it is as wide as the shards.
    """
    width, same = 8, b is None
    other = a if same else b
    while True:
        links = ask(a[0], a[1], other[1], least, width, same).T
        links = links | (links.T if same else ask(other[0], other[1], a[1], least, width, False))
        if same:
            np.fill_diagonal(links, False)
        found, true = audited(links, a[1], other[1], least, same)
        if not same:
            more = audited(links.T, other[1], a[1], least, False)
            found, true = found + more[0], true + more[1]
        if found >= wanted_recall * true or width >= max(len(a[1]), len(other[1])):
            return links
        width *= 4


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """The smallest number in the component of each of 0..n-1, from linked (a, b) rows."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _unit(data: bytes, dim: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype="<f8").reshape(-1, dim)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def link_vectors(vectors: DataFrame, least: float = 0.98, shard_rows: int = SHARD, wanted_recall: float = 1.0,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Only vectors with the same label, which isn't null, and as many components are compared. A
    vector that is null, empty, zero, or holds null or non-finite components links with nothing
    and is its own component. component_id is the smallest id that links reach; rows that repeat
    an id are vectors of their own; a null id is larger than any other. ``kept`` is whether a row's id
    is its component's. Other columns aren't read.
    """
    rows = staged(vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"),
    ))
    plain = F.lit(float("inf"))
    sound = (
        F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < plain)) & F.exists("v", lambda x: x != 0)
    )
    usable = rows.filter(sound).withColumn("dim", F.size("v"))
    sizes = usable.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = usable.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    key = ["label", "dim", "shard"]
    label_type = rows.schema["label"].dataType.simpleString()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        raw = np.stack(frame["v"].to_numpy()).astype("<f8")
        graph = Graph(_unit(raw.tobytes(), raw.shape[1]))
        head = frame[key].iloc[:1].reset_index(drop=True)
        return head.assign(ids=[frame["row"].to_numpy("<i8").tobytes()], raw=[raw.tobytes()], graph=[graph.pack()])

    graphs = staged(dealt.select(*key, "row", "v").groupBy(*key).applyInPandas(
        build, f"label {label_type}, dim int, shard int, ids binary, raw binary, graph binary"
    ))
    other = graphs.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("shard", "ids", "raw", "graph")])
    pairs = graphs.join(other, ["label", "dim"]).filter(F.col("shard") <= F.col("shard_b"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        dim, same = int(r["dim"]), r["shard"] == r["shard_b"]
        ids, unit = np.frombuffer(r["ids"], "<i8"), _unit(r["raw"], dim)
        mine = (Graph.unpack(unit, r["graph"]), unit)
        if same:
            links = link_shards(mine, None, least, wanted_recall)
            counts = links.sum(axis=1)
            at = np.argwhere(links)
        else:
            ids_b, unit_b = np.frombuffer(r["ids_b"], "<i8"), _unit(r["raw_b"], dim)
            links = link_shards(mine, (Graph.unpack(unit_b, r["graph_b"]), unit_b), least, wanted_recall)
            counts = np.r_[links.sum(axis=1), links.sum(axis=0)]
            at = np.argwhere(links) + [0, len(ids)]
            ids = np.r_[ids, ids_b]
        root = forest(at, len(ids))
        some = np.flatnonzero(counts)
        return pd.DataFrame({"row": ids[some], "n": counts[some].astype(np.int64), "to": ids[root[some]]})

    found = staged(pairs.groupBy("label", "dim", "shard", "shard_b").applyInPandas(compare, "row long, n long, to long"))
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    linked = components(found, "row", "to").withColumnRenamed("node", "row")
    named = rows.select("row", "vec_id").join(counts, "row", "left").join(linked, "row", "left").withColumn(
        "root", F.coalesce("root", "row")
    )
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return named.join(smallest, "root").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
