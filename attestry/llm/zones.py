"""Centroid clustering over zone maps of a space-filling curve.

Vectors are turned into integers, ordered along a Hilbert curve through all their components (each
scaled by its mean and spread, the widest first) and packed into blocks of ``BLOCK`` neighbours. A
block is one row: its ids, its vectors, the least and greatest value of every component (its box), and
the sum of its vectors. The order is a range shuffle by (key, hash of the id), so that a third
of all rows being one vector spreads over many tasks like any other rows.

In every round the box bounds how much nearer one centroid can be than another to any vector in it;
what remains are the block's candidates. A block with one candidate counts by its stored sum;
others compare their vectors with the candidates alone, in integers (products of components up to
2**21 are exact in doubles, larger ones are taken in longs). Tasks give partial sums
for each centroid and component, so centroids and sums, ``k`` times the dimensions, are all that
passes the driver. A wider block or a lost executor changes no result.

Results for odd rows: vectors that are null, hold a null or non-finite component or have another
number of components are left out; repeated rows count each; a null id is the empty text in the hash
that draws the first centroids, whose ties go to the least vector; fewer vectors than centroids
make fewer centroids; an empty table gives no rows; extra columns aren't used. A component that
leaves the range of +-2**27 once it is an integer is an error, as distances would leave the longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import staged
from attestry.session import shuffle_partitions

BLOCK = 256
BITS = 4
FARTHEST = 1 << 27
IN_DOUBLES = 1 << 21


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of doubles as longs."""
    out = np.floor(vectors * scale)
    if out.size and not np.abs(out).max() <= FARTHEST:
        raise ValueError("a component is too large: distances would leave the range of a long")
    return out.astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The curve's position of each row of cell numbers (below 2**bits), as rows of packed bytes.

    The numbers are turned, from the highest bit down, into the bits of the Hilbert index, which is
    read across the components: first the highest bit of each, then the next.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    high = np.uint32(1 << (bits - 1))
    q = high
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(dims):
            turned = (x[i] & q) != 0
            swapped = np.where(turned, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swapped)
            x[i] ^= swapped
        q = np.uint32(q >> 1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = high
    while q > 1:
        flips = np.where((x[-1] & q) != 0, flips ^ np.uint32(q - 1), flips)
        q = np.uint32(q >> 1)
    x ^= flips
    planes = [((x >> np.uint32(b)) & np.uint32(1)).T for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(df: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """(vec_id, x): the vectors with ``dims`` components, each a finite number, as doubles."""
    x = F.col(vector).cast("array<double>")
    wrong = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(vec_id).alias("vec_id"), x.alias("x")).filter((F.size("x") == dims) & ~wrong)


def spread_of(rows: DataFrame, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every component; the vectors' sums come as partial sums of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = integers(matrix(batch.column(0), dims), scale).astype(float)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(one), pa.array(two)],
                names=["dim", "n", "one", "two"],
            )

    parts = rows.select("x").mapInArrow(run, "dim int, n long, one double, two double")
    got = sorted(parts.groupBy("dim").agg(F.sum("n"), F.sum("one"), F.sum("two")).collect())
    if not got:
        return np.zeros(dims), np.ones(dims)
    n, one, two = (np.array([r[i] for r in got], float) for i in (1, 2, 3))
    return one / n, np.sqrt(np.maximum(two / n - (one / n) ** 2, 0.0))


def packed(rows: DataFrame, dims: int, scale: float, block: int = BLOCK) -> DataFrame:
    """Blocks of neighbours on the curve: ids, vectors (longs as bytes), box and sum."""
    spark = rows.sparkSession
    mean, spread = spread_of(rows, dims, scale)
    order = np.argsort(-spread, kind="stable")
    width = np.maximum(spread, 1e-9)[order]
    id_type = rows.schema["vec_id"].dataType

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = integers(matrix(batch.column(1), dims), scale)
                cells = (x[:, order] - mean[order]) / width * (1 << (BITS - 3)) + (1 << (BITS - 1))
                keys = hilbert_keys(np.clip(np.floor(cells), 0, (1 << BITS) - 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()),
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                    ],
                    names=["vec_id", "q", "key"],
                )

    flat = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("q", T.BinaryType()), T.StructField("key", T.BinaryType()),
    ])
    keys = staged(rows.mapInArrow(keyed, flat).withColumn("salt", F.xxhash64("vec_id", "q")))
    sliced = keys.repartitionByRange(shuffle_partitions(spark), "key", "salt").sortWithinPartitions("key", "salt")
    out = T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("q", T.BinaryType()),
        T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("total", T.BinaryType()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for last, batch in marked_last(batches):
            now = pa.Table.from_batches([batch.select(["vec_id", "q"])])
            held = now if held is None else pa.concat_tables([held, now])
            full = held.num_rows if last else held.num_rows // block * block
            if full:
                yield blocks_of(held.slice(0, full).combine_chunks(), dims, block)
                held = held.slice(full)

    return staged(sliced.select("vec_id", "q").mapInArrow(pack, out))


def marked_last(items: Iterator) -> Iterator[tuple[bool, object]]:
    """Each item with whether it is the last one."""
    before = next(items, None)
    while before is not None:
        after = next(items, None)
        yield after is None, before
        before = after


def blocks_of(rows: pa.Table, dims: int, block: int) -> pa.RecordBatch:
    n = rows.num_rows
    x = np.frombuffer(b"".join(rows["q"].to_pylist()), np.int64).reshape(n, dims)
    cuts = list(range(0, n, block))
    parts = [x[c : c + block] for c in cuts]
    ids = rows["vec_id"].combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.chunk(0)
    offsets = pa.array([*cuts, n], pa.int32())

    def raw(arrays: list[np.ndarray]) -> pa.Array:
        return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())

    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(offsets, ids), raw(parts), raw([p.min(axis=0) for p in parts]),
            raw([p.max(axis=0) for p in parts]), raw([p.sum(axis=0) for p in parts]),
        ],
        names=["ids", "q", "low", "high", "total"],
    )


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be the nearest one of a vector in the box, in ascending order.

    The centroid that is nearest to the middle of the box is the rival: how far its squared distance
    can exceed another's is linear in the vector, so its greatest value over the box is at a corner and is
    the sum of the components' own greatest values. Where even that is below 0 (or 0, and the rival's
    number is smaller), the other centroid can't be chosen in this block.
    """
    # the middle is doubled to stay an integer; any choice of rival is right
    rival = int(np.argmin(((low + high - 2 * centroids) ** 2).sum(axis=1)))
    gap = centroids[rival] - centroids
    norms = (centroids * centroids).sum(axis=1)
    excess = norms[rival] - norms + 2 * np.maximum(-low * gap, -high * gap).sum(axis=1)
    number = np.arange(len(centroids))
    keep = (excess > 0) | ((excess == 0) & (number < rival))
    keep[rival] = True
    return number[keep]


def nearest(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of the centroids ``numbers``; ties to the smaller number."""
    some = centroids[numbers]
    if max(np.abs(x).max(), np.abs(some).max()) <= IN_DOUBLES:
        products = (x.astype(float) @ some.T.astype(float)).astype(np.int64)
    else:
        products = x @ some.T
    far = (x * x).sum(axis=1)[:, None] - 2 * products + (some * some).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return numbers[best], far[np.arange(len(x)), best]


def opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    """(position, vectors, low, high, sum) of every block of a batch."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("q", "low", "high", "total")]
    for i in range(batch.num_rows):
        q, low, high, total = (np.frombuffer(c[i].as_buffer(), np.int64) for c in columns)
        yield i, q.reshape(-1, dims), low, high, total


def moved(blocks: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The next centroids: exact floors of the means of what is nearest to each; empty ones stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, x, low, high, total in opened(batch, dims):
                numbers = candidates(low, high, centroids)
                if len(numbers) == 1:
                    n[numbers[0]] += len(x)
                    sums[numbers[0]] += total
                    continue
                own, _ = nearest(x, centroids, numbers)
                for c in np.unique(own):
                    n[c] += (own == c).sum()
                    sums[c] += x[own == c].sum(axis=0)
        used = np.flatnonzero(n)
        if len(used):
            columns = np.concatenate([n[used][:, None], sums[used]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(used)), pa.int32()),
                    pa.array(columns.ravel(), pa.int64()),
                ],
                names=["cluster", "part", "value"],
            )

    parts = blocks.mapInArrow(run, "cluster int, part int, value long")
    sums = {(r[0], r[1]): r[2] for r in parts.groupBy("cluster", "part").agg(F.sum("value")).collect()}
    out = centroids.copy()
    for c in range(k):
        if (c, 0) in sums:
            out[c] = [sums[c, d + 1] // sums[c, 0] for d in range(dims)]
    return out


def placed(blocks: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    schema = T.StructType([
        T.StructField("vec_id", blocks.schema["ids"].dataType.elementType),
        T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [
                    nearest(x, centroids, candidates(low, high, centroids))
                    for _, x, low, high, _ in opened(batch, dims)
                ]
                ids = batch.column(batch.schema.get_field_index("ids")).flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.concatenate([f[0] for f in found]), pa.int32()),
                        pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )

    return blocks.mapInArrow(run, schema)


def first_centroids(rows: DataFrame, k: int, seed: int, dims: int, scale: float) -> np.ndarray:
    """The vectors whose ids have the ``k`` smallest hashes, in the order of the hashes."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    drawn = rows.select(F.sha2(F.encode(text, "UTF-8"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return integers(np.array([r["x"] for r in drawn], float).reshape(-1, dims), scale)


def cluster(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3,
    seed: int = 1, scale: float = 64.0, block: int = BLOCK,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Only the table of clusters, at most ``k`` rows, is broadcast.
    """
    import hashlib

    rows = usable(df, vec_id, vector, dims)
    centroids = first_centroids(rows, k, seed, dims, scale)
    blocks = packed(rows, dims, scale, block)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(blocks, centroids, dims)
    own = staged(placed(blocks, centroids, dims))
    sums = {r[0]: r[1] for r in own.groupBy("cluster").agg(F.sum("distance")).collect()}
    total = sum(sums.values())
    hashes = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    about = df.sparkSession.createDataFrame(
        [(c, s, total, hashes[c]) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return own.join(F.broadcast(about), "cluster").select(
        F.col("vec_id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
