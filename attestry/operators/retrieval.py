"""Top-k retrieval over whole query tables.

Every function takes a queries table and returns ``query_id, chunk_id, score, rank`` rows. Top-k is
``row_number() <= k``, which Spark cuts to k rows per query before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.functions.vectors import distance_to_score
from attestry.session import cut_lineage, salted_join, shuffle_partitions, shuffles_dropped

TIE_DIGITS = 9


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank"):
    """First k rows per key, ranked from 1."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


# --- R3 --------------------------------------------------------------------------------------------
def apply_filters(
    df: DataFrame,
    doc_ids: list | None = None,
    sources: list[str] | None = None,
    metadata: dict[str, object] | None = None,
    doc: str = "doc_id",
) -> DataFrame:
    """AND of id list, source list and metadata keys compared as text; pushed to the scan."""
    if doc_ids:
        df = df.where(F.col(doc).isin(doc_ids))
    if sources:
        df = df.where(F.col("source").isin(sources))
    for key, value in (metadata or {}).items():
        field = F.col(key) if key in df.columns else F.try_element_at("metadata", F.lit(key))
        df = df.where(field.cast("string") == F.lit(str(value)))
    return df


def searchable(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """Vectors of ``model`` whose chunk belongs to a document with status COMPLETED.

    Both predicates reach the scans, before vectors are packed; ``chunks`` has chunk_id and
    doc_id, ``documents`` doc_id, status and what filters need.
    """
    done = documents.where(F.col("status") == "COMPLETED").drop("status")
    own = vectors.where(F.col("model") == model).drop("model")
    return own.join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(done, "doc_id")


def allowed_chunks(lists: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each query's list of documents (query_id, doc_id) as a list of chunks (query_id, chunk_id)."""
    return lists.select("query_id", doc).distinct().join(
        chunks.select("chunk_id", doc), doc
    ).select("query_id", "chunk_id")


# --- R1: exact search ------------------------------------------------------------------------------
def _tiles(df: DataFrame, id_col: str, vec_col: str, rows: int, prefix: str) -> DataFrame:
    """Pack the rows of each partition into matrices of at most ``rows`` vectors. No shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(
                    pa.array([0, part.num_rows], pa.int32()), part.column(0)
                )
                data = pa.array([flat.astype("<f8").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, data], [f"{prefix}_ids", f"{prefix}_mat"])

    return df.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(
        pack, f"{prefix}_ids array<{id_type}>, {prefix}_mat binary"
    )


def _distances(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    dots = q @ x.T
    if kind == "ip":
        return -dots
    if kind == "l2":
        square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * dots
        return np.sqrt(np.maximum(square, 0))
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return 1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)


def _tile_top_k(pairs: DataFrame, k: int, kind: str, q_type: str, c_type: str) -> DataFrame:
    """Best k of each tile for each query of a block: k rows leave, not all pairs."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids = batch.column(0)[row].values
                c_ids = batch.column(2)[row].values
                q = np.frombuffer(batch.column(1)[row].as_py(), "<f8").reshape(len(q_ids), -1)
                x = np.frombuffer(batch.column(3)[row].as_py(), "<f8").reshape(len(c_ids), -1)
                dist = np.round(_distances(q, x, kind), TIE_DIGITS)
                names = c_ids.to_numpy(zero_copy_only=False)
                take_q, take_c = [], []
                for i in range(len(q_ids)):
                    near = np.arange(len(names))
                    if len(names) > k:
                        near = np.flatnonzero(dist[i] <= np.partition(dist[i], k - 1)[k - 1])
                    best = near[np.lexsort((names[near], dist[i][near]))[:k]]
                    take_q += [i] * len(best)
                    take_c += best.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        q_ids.take(pa.array(take_q, pa.int64())),
                        c_ids.take(pa.array(take_c, pa.int64())),
                        pa.array(dist[take_q, take_c] if take_q else [], pa.float64()),
                    ],
                    ["query_id", "chunk_id", "distance"],
                )

    schema = f"query_id {q_type}, chunk_id {c_type}, distance double"
    return pairs.select("q_ids", "q_mat", "c_ids", "c_mat").mapInArrow(search, schema)


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 20,
    kind: str = "cosine",
    query_id: str = "query_id",
    query_vec: str = "qv",
    chunk_id: str = "chunk_id",
    vec: str = "embedding",
    tile: int = 4096,
    block: int = 256,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Exact nearest chunks; R3: with ``allowed``, those of the query's own list (query_id, chunk_id).

    Vectors are packed into tiles where they lie and query blocks are sent to them through an
    equi-join on a slot number. A small query side is broadcast by the engine after measuring it,
    so the vectors do not move at all; a large one is spread over the slots.
    """
    slots = shuffle_partitions(queries.sparkSession)
    q_type = queries.schema[query_id].dataType.simpleString()
    c_type = vectors.schema[chunk_id].dataType.simpleString()
    if allowed is not None:
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qv"))
        return _listed_top_k(asked, vectors.select(chunk_id, vec), allowed, k, kind, tile, block)
    blocks = _tiles(queries, query_id, query_vec, block, "q").withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    )
    tiles = _tiles(vectors, chunk_id, vec, tile, "c").withColumn(
        "slot", F.pmod(F.xxhash64("c_ids"), F.lit(slots)).cast("int")
    )
    near = _tile_top_k(tiles.join(blocks, "slot"), k, kind, q_type, c_type)
    return _ranked(near, k, kind)


def _listed_top_k(
    queries: DataFrame, vectors: DataFrame, allowed: DataFrame, k: int, kind: str, tile: int, block: int
) -> DataFrame:
    """Lists are intersected with the tiles before the nearest are taken, so none come short.

    The list of a query becomes one bit map of positions for each tile that holds any of its chunks.
    Only those tiles meet the query, in blocks of queries. A query without a list finds nothing.
    """
    chunk_id, vec = vectors.columns
    q_type = queries.schema["query_id"].dataType.simpleString()
    c_type = vectors.schema[chunk_id].dataType.simpleString()
    tiles = cut_lineage(
        _tiles(vectors, chunk_id, vec, tile, "c").withColumn("tile", F.monotonically_increasing_id())
    )
    members = tiles.select("tile", F.posexplode("c_ids").alias("pos", "chunk_id"))
    marks = (
        allowed.select("query_id", "chunk_id").join(members, "chunk_id")
        .groupBy("tile", "query_id")
        .agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("mark"))
    )
    blocks = max(1, -(-queries.count() // block))
    packed = (
        marks.join(queries.select("query_id", F.col("qv").cast("array<double>").alias("qv")), "query_id")
        .groupBy("tile", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b"))
        .agg(F.sort_array(F.collect_list(F.struct("query_id", "qv", "mark"))).alias("q"))
        .select("tile", F.col("q.query_id").alias("q_ids"), F.col("q.qv").alias("qv"), F.col("q.mark").alias("marks"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, c_ids = batch.column(0)[row].values, batch.column(3)[row].values
                q = batch.column(1)[row].values.flatten().to_numpy().reshape(len(q_ids), -1)
                x = np.frombuffer(batch.column(4)[row].as_py(), "<f8").reshape(len(c_ids), -1)
                bits = [np.frombuffer(m.as_py(), np.uint8) for m in batch.column(2)[row].values]
                own = np.unpackbits(np.stack(bits), axis=1, bitorder="little")[:, : len(c_ids)].astype(bool)
                dist = np.round(_distances(q, x, kind), TIE_DIGITS)
                names = c_ids.to_numpy(zero_copy_only=False)
                take_q, take_c = [], []
                for i in range(len(q_ids)):
                    near = np.flatnonzero(own[i])
                    best = near[np.lexsort((names[near], dist[i][near]))[:k]]
                    take_q += [i] * len(best)
                    take_c += best.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        q_ids.take(pa.array(take_q, pa.int64())), c_ids.take(pa.array(take_c, pa.int64())),
                        pa.array(dist[take_q, take_c] if take_q else [], pa.float64()),
                    ],
                    ["query_id", "chunk_id", "distance"],
                )

    near = packed.join(tiles, "tile").select("q_ids", "qv", "marks", "c_ids", "c_mat").mapInArrow(
        search, f"query_id {q_type}, chunk_id {c_type}, distance double"
    )
    return _ranked(near, k, kind)


def _ranked(near: DataFrame, k: int, kind: str) -> DataFrame:
    best = top_k(near, ["query_id"], [F.col("distance"), F.col("chunk_id")], k)
    return best.withColumn("score", distance_to_score("distance", kind))


# --- R2: approximate search ----------------------------------------------------------------------------
TILE_ROWS = 4096


CENTER_ROWS = 256


@dataclass
class CellIndex:
    """k-means cells: ``tiles`` (cell, slot, c_ids, c_mat), the slots of each cell, and the centres."""

    tiles: DataFrame
    sizes: DataFrame  # cell, slots
    centers: DataFrame  # cell, center


def _placing(vec: Column, kind: str) -> Column:
    """What cells are made of: for cosine the directions, otherwise the vectors."""
    own = vec.cast("array<double>")
    if kind != "cosine":
        return own
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(own, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def fit_centers(
    vectors: DataFrame, cells: int | None, kind: str = "cosine", seed: int = 7, vec: str = "embedding"
) -> DataFrame:
    """(cell, center) by k-means on a sample of about ``CENTER_ROWS`` vectors a cell, drawn by hash.

    By default there are as many cells as the root of the number of vectors. The sample decides only where
    the centres lie; every vector is placed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    cells = cells or max(1, math.isqrt(n))
    share = min(1.0, CENTER_ROWS * cells / max(n, 1))
    drawn = vectors if share == 1 else vectors.where(
        F.pmod(F.xxhash64(vec, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    )
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(
        drawn.select(array_to_vector(_placing(F.col(vec), kind)).alias("features"))
    )
    return vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cell int, center array<double>",
    )


def nearest_cells(rows: DataFrame, centers: DataFrame, probe: int, kind: str) -> DataFrame:
    """(id, cell): the ``probe`` nearest cells of every row (id, v), by distance to nine decimals.

    The centres, about the root of the vectors' number, go to the rows where they lie; no row moves or is copied.
    """
    known = centers.orderBy("cell").collect()
    cells = np.array([c["cell"] for c in known], np.int32)
    middle = np.array([c["center"] for c in known])
    placed = rows.select("id", _placing(F.col("v"), kind).alias("v"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                order = np.argsort(np.round(_distances(own, middle, "l2"), TIE_DIGITS), axis=1, kind="stable")[:, :probe]
                whose = np.repeat(np.arange(part.num_rows), order.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(whose)), pa.array(cells[order.ravel()])], ["id", "cell"]
                )

    return placed.mapInArrow(nearest, f"id {rows.schema['id'].dataType.simpleString()}, cell int")


def place_vectors(
    vectors: DataFrame, centers: DataFrame, kind: str = "cosine", taken: DataFrame | None = None,
    chunk_id: str = "chunk_id", vec: str = "embedding",
) -> CellIndex:
    """Tiles of the vectors' cells. A cell has as many slots as it takes for its own rows.

    ``taken`` (cell, slots) shifts the slot numbers behind those of an index that is appended to.
    """
    x = vectors.select(F.col(chunk_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    x = x.join(nearest_cells(x, centers, 1, kind), "id")
    sizes = x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("slots"))
    first = F.lit(0).alias("_first")
    if taken is None:
        dealt = x.join(sizes.select("*", first), "cell")
    else:
        old = taken.select("cell", F.col("slots").alias("_first"))
        dealt = x.join(sizes.join(old, "cell", "left").fillna(0, ["_first"]), "cell")
    dealt = dealt.withColumn("slot", (F.pmod(F.xxhash64("id"), F.col("slots")) + F.col("_first")).cast("int"))
    c_type = vectors.schema[chunk_id].dataType.simpleString()
    return CellIndex(_cell_tiles(dealt, "id", "v", c_type, "c"), sizes, centers)


def search_cells(
    queries: DataFrame, index: CellIndex, k: int = 20, kind: str = "cosine", probe: int | None = None,
    query_id: str = "query_id", query_vec: str = "qv",
) -> DataFrame:
    """R2: each query looks into its ``probe`` nearest cells; with None, as many as ``tuned_probe`` finds."""
    probe = probe or tuned_probe(queries, index, k, kind, query_id, query_vec)
    q_type = queries.schema[query_id].dataType.simpleString()
    c_type = index.tiles.schema["c_ids"].dataType.elementType.simpleString()
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vec).cast("array<double>").alias("v"))
    q = asked.join(nearest_cells(asked, index.centers, probe, kind), "id")
    blocks = _cell_tiles(q.withColumn("slot", F.lit(0)), "id", "v", q_type, "q").drop("slot")
    blocks = blocks.join(index.sizes, "cell").withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    ).drop("slots")
    near = _tile_top_k(index.tiles.join(blocks, ["cell", "slot"]), k, kind, q_type, c_type)
    return _ranked(near, k, kind)


def tuned_probe(
    queries: DataFrame, index: CellIndex, k: int = 20, kind: str = "cosine",
    query_id: str = "query_id", query_vec: str = "qv", recall: float = 0.95, audited: int = 32,
) -> int:
    """The number of cells to probe for a mean recall of ``recall``, widened until an audit passes.

    The audit takes the ``audited`` queries with the smallest hashes and compares with all cells.
    """
    some = cut_lineage(queries.orderBy(F.xxhash64(query_id), query_id).limit(audited))
    cells = index.centers.count()
    exact = cut_lineage(search_cells(some, index, k, kind, cells, query_id, query_vec))
    probe = -(-cells // 8)
    while probe < cells:
        found = search_cells(some, index, k, kind, probe, query_id, query_vec)
        if (recall_against(exact, found).agg(F.avg("recall")).first()[0] or 1.0) >= recall:
            break
        probe = min(cells, -(-probe * 3 // 2))
    return probe


def write_cell_index(
    vectors: DataFrame, path: str, kind: str = "cosine", cells: int | None = None, seed: int = 7,
    chunk_id: str = "chunk_id", vec: str = "embedding",
) -> None:
    """R2: the index as tables: centres, and tiles partitioned by cell, so that a search reads its cells only."""
    fit_centers(vectors, cells, kind, seed, vec).write.parquet(f"{path}/centers")
    centers = vectors.sparkSession.read.parquet(f"{path}/centers")
    _add_tiles(place_vectors(vectors, centers, kind, None, chunk_id, vec), path)


def append_to_cell_index(
    vectors: DataFrame, path: str, kind: str = "cosine", chunk_id: str = "chunk_id", vec: str = "embedding"
) -> None:
    """R2: further vectors, placed by the stored centres in new slots; nothing stored is rewritten."""
    stored = read_cell_index(vectors.sparkSession, path)
    taken = cut_lineage(stored.sizes)
    _add_tiles(place_vectors(vectors, stored.centers, kind, taken, chunk_id, vec), path)


def _add_tiles(index: CellIndex, path: str) -> None:
    index.tiles.write.mode("append").partitionBy("cell").parquet(f"{path}/tiles")


def read_cell_index(spark: SparkSession, path: str) -> CellIndex:
    tiles = spark.read.parquet(f"{path}/tiles")
    sizes = tiles.groupBy("cell").agg((F.max("slot") + 1).alias("slots"))
    return CellIndex(tiles, sizes, spark.read.parquet(f"{path}/centers"))


def vector_topk_ann(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 20,
    kind: str = "cosine",
    cells: int | None = None,
    probe: int | None = None,
    seed: int = 7,
    query_id: str = "query_id",
    query_vec: str = "qv",
    chunk_id: str = "chunk_id",
    vec: str = "embedding",
) -> DataFrame:
    """R2 without a stored index: cells are made for this search.

    ``cells`` and ``probe`` trade recall for work, as graph-index knobs do; without ``probe``, an audit
    sets it. A cell may hold a third of the vectors: its rows are dealt over its slots, so one
    cell is many tasks.
    """
    centers = fit_centers(vectors, cells, kind, seed, vec)
    index = place_vectors(vectors, centers, kind, None, chunk_id, vec)
    index = CellIndex(cut_lineage(index.tiles), cut_lineage(index.sizes), centers)
    return search_cells(queries, index, k, kind, probe, query_id, query_vec)


def _cell_tiles(
    df: DataFrame, id_col: str, vec_col: str, id_type: str, prefix: str, rows: int = TILE_ROWS
) -> DataFrame:
    """Tiles that hold one (cell, slot) each; tiles stay bounded however large a cell is."""
    placed = df.repartition("cell", "slot").sortWithinPartitions("cell", "slot")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            slot = batch.column(3).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(slot) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                for at in range(lo, hi, rows):
                    part = batch.slice(at, min(rows, hi - at))
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    ids = pa.ListArray.from_arrays(
                        pa.array([0, part.num_rows], pa.int32()), part.column(0)
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(2).slice(0, 1),
                            part.column(3).slice(0, 1),
                            ids,
                            pa.array([flat.astype("<f8").tobytes()], pa.binary()),
                        ],
                        ["cell", "slot", f"{prefix}_ids", f"{prefix}_mat"],
                    )

    return placed.select(id_col, vec_col, "cell", "slot").mapInArrow(
        pack, f"cell int, slot int, {prefix}_ids array<{id_type}>, {prefix}_mat binary"
    )


def recall_against(exact: DataFrame, found: DataFrame) -> DataFrame:
    """R2: share of the exact hits that the approximate search returned, per query."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return (
        exact.join(hit, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )


# --- R4-R6: keyword search --------------------------------------------------------------------------------
def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """R4 in long form: one row per distinct search term; a query without letters has none."""
    return queries.select(
        query_id, F.explode(T.keyword_terms(T.nfc(text))).alias("term")
    )


def build_postings(
    chunks: DataFrame,
    chunk_id: str = "chunk_id",
    text: str = "content",
    only: DataFrame | None = None,
    doc: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``chunk_id, term, tf``. ``only`` (a term column) keeps just the terms asked for.

    A term's positions all lie in its chunk's row, so counts are complete before the shuffle. For a stored
    table, ``doc`` carries the chunk's document along as ``doc_id``, and with ``buckets`` counts
    are made in the row and dealt by term once, as the table is.
    """
    composed = T.nfc(text)
    compounds = F.regexp_extract_all(
        # the look-behind keeps the scan from trying again inside every plain word
        T.simple_lower(composed),
        F.lit(r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++(?:[/\-.][\p{L}\p{N}]++)+"),
        F.lit(0),
    )
    ids = [F.col(chunk_id).alias("chunk_id"), *([] if doc is None else [F.col(doc).alias("doc_id")])]
    keys = ["chunk_id", "term", *([] if doc is None else ["doc_id"])]
    terms = F.concat(T.words(composed), compounds)
    if buckets is not None:
        rows = chunks.select(*ids, F.explode(_counts(terms)).alias("c")).select(*keys[::2], "c.term", "c.tf")
        rows = rows if only is None else _of_terms(rows, only)
        return rows.repartition(buckets, "term").groupBy(*keys).agg(F.sum("tf").alias("tf"))
    rows = chunks.select(*ids, F.explode(terms).alias("term"))
    if only is not None:
        rows = _of_terms(rows, only)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))


def _counts(terms: Column) -> Column:
    """Distinct terms of an array and how often each occurs: a term's run in the sorted array."""
    def runs(s: Column) -> Column:
        places = F.transform(s, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
        return T.let(F.filter(places, lambda p, i: (i == 0) | (F.get(s, i - 1) != p["term"])), lambda f: F.transform(
            f, lambda p, k: F.struct(
                p["term"].alias("term"), (F.coalesce(F.get(f, k + 1)["at"], F.size(s)) - p["at"]).cast("long").alias("tf")
            )
        ))

    return T.let(F.sort_array(terms), runs)


def of_keys(rows: DataFrame, keys: DataFrame, on: str, few: int = 200_000) -> DataFrame:
    """Rows whose ``on`` is in ``keys``. Up to ``few`` keys, counted, are sent to the rows where they lie."""
    wanted = cut_lineage(keys.select(on).distinct())
    return rows.join(F.broadcast(wanted) if wanted.count() <= few else wanted, on, "left_semi")


def _of_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    return of_keys(rows, terms, "term")


def write_postings(
    postings: DataFrame, name: str, owners: DataFrame, buckets: int = 64
) -> None:
    """A table bucketed by term, and an empty one of replaced documents beside it.

    ``owners`` gives the document of each chunk (chunk_id, doc_id); only its types are read where ``postings``
    have their doc_id.
    """
    _store_postings(_owned(postings, owners), name, 0, buckets, "overwrite")
    spark = postings.sparkSession
    doc_type = owners.schema["doc_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"doc_id {doc_type}, before long")
    empty.write.mode("overwrite").saveAsTable(f"{name}_replaced")


def _owned(postings: DataFrame, owners: DataFrame) -> DataFrame:
    """Postings with the document of their chunk; a chunk without one isn't stored."""
    if "doc_id" in postings.columns:
        return postings.where("chunk_id is not null and doc_id is not null")
    return postings.join(owners, "chunk_id")


def _store_postings(rows: DataFrame, name: str, version: int, buckets: int, mode: str) -> None:
    own = rows.select("term", "chunk_id", "doc_id", "tf", F.lit(version).cast("long").alias("version"))
    # one task a bucket, so that each adds one file
    with shuffles_dropped(rows.sparkSession):
        own.repartition(buckets, "term").write.mode(mode).bucketBy(buckets, "term").sortBy("term").option(
            "compression", "zstd"
        ).saveAsTable(name)


def replace_postings(
    postings: DataFrame, name: str, owners: DataFrame, gone: DataFrame, buckets: int = 64
) -> None:
    """The documents ``gone`` (doc_id) lose what is stored for them; ``postings`` are added.

    New rows are appended under the next version first and the older versions of the documents are
    marked afterwards, so a job that dies in between leaves both old and new rows, and running it again
    repairs that. Stored rows aren't rewritten until ``compact_postings``.
    """
    spark = postings.sparkSession
    marked = spark.table(f"{name}_replaced")
    stored = spark.table(name).agg(F.max("version")).first()[0] or 0
    version = max(stored, marked.agg(F.max("before")).first()[0] or 0) + 1
    _store_postings(_owned(postings, owners), name, version, buckets, "append")
    gone.select("doc_id", F.lit(version).cast("long").alias("before")).distinct().write.mode("append").saveAsTable(
        f"{name}_replaced"
    )


def live_postings(matched: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Rows of the stored table whose document wasn't replaced after they were written."""
    dead = spark.table(f"{name}_replaced").groupBy("doc_id").agg(F.max("before").alias("_before"))
    return matched.join(dead, "doc_id", "left").where(
        F.col("_before").isNull() | (F.col("version") >= F.col("_before"))
    ).drop("_before")


def compact_postings(spark: SparkSession, name: str, new: str, buckets: int = 64) -> None:
    """The live rows as a table of their own, without marks."""
    _store_postings(live_postings(spark.table(name), spark, name), new, 0, buckets, "overwrite")
    spark.table(f"{name}_replaced").limit(0).write.mode("overwrite").saveAsTable(f"{new}_replaced")


def search_postings(
    terms: DataFrame, spark: SparkSession, name: str, k: int = 20, allowed: DataFrame | None = None
) -> DataFrame:
    """R6 on stored postings: only those of the terms asked for leave the table."""
    matched = live_postings(_of_terms(spark.table(name), terms), spark, name)
    return _keyword_best(terms, matched, k, occurrence_weight, allowed)


def occurrence_weight(tf: Column) -> Column:
    """Sum of 1/j^2 over all of a term's occurrences, the part of the rank that differs between chunks.

    The first ``SUMMED`` terms are added up; the sum of the others is the difference of two tails
    whose series is exact to double precision there, so that any frequency costs the same.
    """
    few = F.aggregate(
        F.sequence(F.lit(1), F.least(tf.cast("int"), F.lit(SUMMED))),
        F.lit(0.0),
        lambda acc, j: acc + F.lit(1.0) / (j * j),
    )
    return F.when(tf <= SUMMED, few).otherwise(few + _tail(F.lit(float(SUMMED))) - _tail(tf.cast("double")))


SUMMED = 32


def _tail(n: Column) -> Column:
    """Sum of 1/j^2 over all j > n, by the Euler-Maclaurin series."""
    return 1 / n - 1 / (2 * n * n) + 1 / (6 * n * n * n) - 1 / (30 * n * n * n * n * n)


def keyword_topk(
    terms: DataFrame,
    postings: DataFrame,
    k: int = 20,
    weight: Callable[[Column], Column] = occurrence_weight,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Any-term match; score is the rank divided by the best rank of the query.

    With ``allowed`` (query_id, chunk_id), R3: only chunks of the query's own list are ranked.
    """
    return _keyword_best(terms, _of_terms(postings, terms), k, weight, allowed)


#: Chunks of a tile of postings, queries of a block, and pairs of postings and queries added up at once.
KEYWORD_TILE, KEYWORD_BLOCK, PAIRS_AT_ONCE = 1024, 256, 1 << 21


def _posting_tiles(rows: DataFrame) -> DataFrame:
    """(c_ids, words, cells): the postings (chunk_id, term, w) of up to ``KEYWORD_TILE`` whole chunks a row.

    A tile's chunks are in order; its cells are (chunk, word, w) by position.
    """
    id_type = rows.schema["chunk_id"].dataType.simpleString()

    def tiles(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        """Tiles of the table's chunks; without ``last`` the last chunk may go on and is given back."""
        coded = pc.dictionary_encode(table.column(0).combine_chunks(), null_encoding="encode")
        chunk = coded.indices.to_numpy()
        ends = len(chunk) if last else int(np.searchsorted(chunk, chunk[-1]))
        for at in range(0, int(chunk[ends - 1]) + 1 if ends else 0, KEYWORD_TILE):
            lo, hi = np.searchsorted(chunk[:ends], [at, at + KEYWORD_TILE])
            words = pc.dictionary_encode(table.column(1).slice(lo, hi - lo).combine_chunks())
            cells = np.empty(hi - lo, _CELL)
            cells["chunk"], cells["word"] = chunk[lo:hi] - at, words.indices.to_numpy()
            cells["w"] = table.column(2).slice(lo, hi - lo).to_numpy()
            ids = coded.dictionary.slice(at, int(chunk[hi - 1]) + 1 - at)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [one(ids), one(words.dictionary), pa.array([cells.tobytes()], pa.binary())], ["c_ids", "words", "cells"]
            )
        if not last:
            yield table.slice(ends)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 1 << 18:
                *made, rest = tiles(pa.Table.from_batches(held), False)
                yield from made
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield from tiles(pa.Table.from_batches(held), True)

    parts = rows.select("chunk_id", "term", "w").repartition(shuffle_partitions(rows.sparkSession), "chunk_id")
    return parts.sortWithinPartitions("chunk_id").mapInArrow(
        pack, f"c_ids array<{id_type}>, words array<string>, cells binary"
    )


_CELL = np.dtype([("chunk", "<i4"), ("word", "<i4"), ("w", "<f8")])


def _added_up(cells: np.ndarray, words: pa.Array, q_codes: np.ndarray, q_terms: pa.Array, queries: int, chunks: int):
    """Sums of the matching cells' weights for every (chunk, query), and where any matched."""
    place = pc.fill_null(pc.index_in(q_terms, value_set=words), -1).to_numpy()
    asked = np.flatnonzero(place >= 0)
    asked = asked[np.argsort(place[asked], kind="stable")]
    by_word, degree = q_codes[asked].astype(np.int64), np.bincount(place[asked], minlength=len(words))
    first = np.cumsum(degree) - degree
    sums, hits = np.zeros(chunks * queries), np.zeros(chunks * queries, bool)
    cells = cells[degree[cells["word"]] > 0]
    total = np.cumsum(degree[cells["word"]])
    lo = 0
    while lo < len(cells):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        part = cells[lo:hi]
        n = degree[part["word"]]
        at = np.arange(n.sum()) + np.repeat(first[part["word"]] - (np.cumsum(n) - n), n)
        pair = np.repeat(part["chunk"].astype(np.int64) * queries, n) + by_word[at]
        sums += np.bincount(pair, np.repeat(part["w"], n), minlength=len(sums))
        hits[pair] = True
        lo = hi
    return sums.reshape(chunks, queries), hits.reshape(chunks, queries)


def _keyword_best(
    terms: DataFrame, matched: DataFrame, k: int, weight: Callable[[Column], Column], allowed: DataFrame | None
) -> DataFrame:
    """Tiles of postings meet blocks of queries; only k rows per tile and query leave, not all pairs.

    The list of a query becomes one bit map of positions for each tile that holds any of its chunks.
    """
    spark = terms.sparkSession
    q_type = terms.schema["query_id"].dataType.simpleString()
    c_type = matched.schema["chunk_id"].dataType.simpleString()
    asked = cut_lineage(terms.select("query_id", "term"))
    number = max(1, -(-asked.select("query_id").distinct().count() // KEYWORD_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(number)).alias("block")
    blocks = (
        asked.groupBy(block).agg(F.collect_list(F.struct("query_id", "term")).alias("q"))
        .select("block", F.col("q.query_id").alias("q_ids"), F.col("q.term").alias("q_terms"))
    )
    tiles = _posting_tiles(matched.select("chunk_id", "term", weight(F.col("tf")).cast("double").alias("w")))
    if allowed is None:
        slots = shuffle_partitions(spark)
        slot = F.pmod(F.xxhash64("c_ids"), F.lit(slots)).cast("int")
        dealt = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        pairs = tiles.withColumn("slot", slot).join(dealt, "slot")
        pairs = pairs.withColumns({"m_ids": F.lit(None).cast(f"array<{q_type}>"), "marks": F.lit(None).cast("array<binary>")})
    else:
        tiles = cut_lineage(tiles.withColumn("tile", F.monotonically_increasing_id()))
        members = tiles.select("tile", F.posexplode("c_ids").alias("pos", "chunk_id"))
        marks = (
            allowed.select("query_id", "chunk_id").join(members, "chunk_id").groupBy("tile", "query_id")
            .agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("mark"))
            .groupBy("tile", block).agg(F.collect_list(F.struct("query_id", "mark")).alias("m"))
            .select("tile", "block", F.col("m.query_id").alias("m_ids"), F.col("m.mark").alias("marks"))
        )
        pairs = marks.join(blocks, "block").join(tiles, "tile")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_terms, c_ids, words, cells, m_ids, marks = (batch.column(i)[row] for i in range(7))
                coded = pc.dictionary_encode(q_ids.values, null_encoding="encode")
                q, c = coded.dictionary, c_ids.values
                sums, hits = _added_up(
                    np.frombuffer(cells.as_py(), _CELL), words.values, coded.indices.to_numpy(), q_terms.values, len(q), len(c)
                )
                if m_ids.values is not None:
                    own = np.zeros((len(q), len(c)), bool)
                    bits = np.stack([np.frombuffer(m.as_py(), np.uint8) for m in marks.values])
                    of = pc.fill_null(pc.index_in(m_ids.values, value_set=q), -1).to_numpy()
                    bits = np.unpackbits(bits, axis=1, bitorder="little")[:, : len(c)].astype(bool)
                    own[of[of >= 0]] = bits[of >= 0]
                    hits &= own.T
                order = np.round(sums, TIE_DIGITS)
                take_q, take_c = [], []
                for i in range(len(q)):
                    near = np.flatnonzero(hits[:, i])
                    if len(near) > k:
                        near = near[order[near, i] >= np.partition(order[near, i], -k)[-k]]
                    best = near[np.argsort(-order[near, i], kind="stable")[:k]]
                    take_q += [i] * len(best)
                    take_c += best.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        q.take(pa.array(take_q, pa.int64())), c.take(pa.array(take_c, pa.int64())),
                        pa.array(sums[take_c, take_q] if take_q else [], pa.float64()),
                    ],
                    ["query_id", "chunk_id", "_raw"],
                )

    raw = pairs.select("q_ids", "q_terms", "c_ids", "words", "cells", "m_ids", "marks").mapInArrow(
        search, f"query_id {q_type}, chunk_id {c_type}, _raw double"
    )
    raw = raw.withColumn("_raw", F.round("_raw", TIE_DIGITS))
    best = top_k(raw, ["query_id"], [F.desc("_raw"), F.col("chunk_id")], k)
    most = F.greatest(F.max("_raw").over(W.partitionBy("query_id")), F.lit(1e-9))
    score = F.when(F.col("_raw") <= 0, F.lit(0.0)).otherwise(
        T.clamp(T.js_round(F.col("_raw") / most, 6))
    )
    return best.select("query_id", "chunk_id", "rank", score.alias("score"))


# --- R7 ---------------------------------------------------------------------------------------------------
STRATEGY_SOURCES = {
    "vector": ["vector"],
    "keyword": ["keyword"],
    "graph": ["graph"],
    "hybrid": ["vector", "keyword", "graph"],
}
RETRIEVERS: dict[str, Callable[..., DataFrame]] = {}


def register_retriever(name: str, fn: Callable[..., DataFrame]) -> None:
    """Plug point: ``fn(queries, k) -> query_id, chunk_id, score``."""
    RETRIEVERS[name] = fn


def retrieve(
    runs: dict[str, Callable[[], DataFrame]], strategy: str = "hybrid", k: int = 20,
    queries: DataFrame | None = None, **fusion
) -> DataFrame:
    """Run the strategy's sources and fuse them.

    A source is one of ``runs``, or else a registered retriever asked with ``queries``; one that
    is in neither is not part of this search. A source that fails, fails the search by name: a
    fused answer without it would look whole.
    """
    from attestry.operators.fusion import fuse

    parts = []
    sources = STRATEGY_SOURCES.get(strategy, [strategy])
    for source in sources:
        if source not in runs and (queries is None or source not in RETRIEVERS):
            continue
        try:
            run = runs[source]() if source in runs else RETRIEVERS[source](queries, k)
        except Exception as err:
            raise RuntimeError(f"retrieval source {source} failed") from err
        parts.append(run.select("query_id", "chunk_id", "score", F.lit(source).alias("source")))
    if not parts:
        raise RuntimeError(f"no retrieval source for {strategy}")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    if len(sources) == 1:
        return top_k(union, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)
    return fuse(union, top=k, **fusion)


# --- R17-R20 -------------------------------------------------------------------------------------------------
def resolve_documents_by_title(
    queries: DataFrame, documents: DataFrame, query: str = "query", doc: str = "doc_id"
) -> DataFrame:
    """Documents whose title holds every word of the query, by counting shared words.

    Distinct titles are matched, then expanded, so many documents of one title cost one match.
    """
    wanted = queries.select("query_id", T.title_tokens(query).alias("_w")).where("size(_w) > 0")
    need = wanted.select("query_id", F.size("_w").alias("need"), F.explode("_w").alias("token"))
    titles = documents.select("title").distinct()
    have = titles.select("title", F.explode(T.title_tokens("title")).alias("token"))
    shared = (
        salted_join(have, need, ["token"], ["title"])
        .groupBy("query_id", "need", "title")
        .agg(F.count(F.lit(1)).alias("got"))
        .where("got = need")
    )
    return salted_join(documents.select(doc, "title"), shared, ["title"], [doc]).select(
        "query_id", doc, "title"
    )


def retrieval_log(hits: DataFrame) -> DataFrame:
    """One row per query with its ordered hits."""
    item = F.struct("rank", "chunk_id", "score", "source")
    return hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(item)).alias("results"),
        F.count(F.lit(1)).alias("candidates"),
        F.max("score").alias("top_score"),
    )


def attach_titles(
    hits: DataFrame, documents: DataFrame, doc: str = "doc_id", preview: int = 1200
) -> DataFrame:
    """Title per hit, shortened content, score to four decimals."""
    titles = documents.select(doc, "title")
    cut = F.concat(F.substring("content", 1, preview), F.lit("…"))
    return hits.join(titles, doc, "left").select(
        *[c for c in hits.columns if c not in ("content", "score")],
        "title",
        T.js_round(F.col("score"), 4).alias("score"),
        F.when(F.length("content") > preview, cut).otherwise(F.col("content")).alias("content"),
    )


def context_sources(packed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Packed chunk ids grouped by document."""
    ids = F.sort_array(F.collect_list(F.struct("pos", "chunk_id")))
    return packed.groupBy("query_id", doc).agg(
        F.transform(ids, lambda s: s["chunk_id"]).alias("chunk_ids")
    )
