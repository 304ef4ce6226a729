"""Lloyd's clustering over dictionaries of subvectors, in exact integers.

Vectors are cut into blocks of ``BLOCK`` dimensions once.  Chunks of up to
``CHUNK`` vectors keep, for each block, the distinct subvectors and one code
for each vector, which loses nothing.  In a round a task computes the distances
of the distinct subvectors to the matching parts of the centroids and adds them
up by code; sums of a cluster come from how often each code fell to it.  Chunks
never move between tasks: a round sends the centroids out and one row of sums
per cluster back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored

#: Dimensions of a block.
BLOCK = 2
#: Vectors that share dictionaries.
CHUNK = 1 << 16
#: Largest absolute component: squared distances of vectors with 64 of them fit 64 bits.
LIMIT = 1 << 27
#: Vectors whose distances to all centroids are held at a time.
SLICE = 1 << 13


def kept_vectors(df: DataFrame, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector``, the integers floor(scale * x); vectors of another length or with a null or non-finite part go."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * float(scale)))
    fits = F.forall(x, lambda v: F.abs(v * float(scale)) <= float(LIMIT))
    refused = F.raise_error(F.lit(f"a component beyond {LIMIT} after scaling: distances would leave 64 bits"))
    return df.where((F.size(x) == dim) & finite).select(
        F.col(id_col).alias("vec_id"), F.when(fits, scaled).otherwise(refused.cast("array<bigint>")).alias("vector")
    )


def _codes(n: int):
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _packed(ids: list, vectors: np.ndarray) -> dict:
    """A chunk: ids, and for each block the distinct subvectors and the code of each vector."""
    parts, codes = [], []
    for at in range(0, vectors.shape[1], BLOCK):
        distinct, code = np.unique(vectors[:, at : at + BLOCK], axis=0, return_inverse=True)
        parts.append(distinct.astype("<i4").tobytes())
        codes.append(code.ravel().astype(_codes(len(distinct))).tobytes())
    return {"ids": ids, "parts": parts, "codes": codes}


def _unpacked(ids, parts, codes, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for part, code, at in zip(parts, codes, range(0, dim, BLOCK)):
        distinct = np.frombuffer(part, "<i4").reshape(-1, min(BLOCK, dim - at)).astype(np.int64)
        out.append((distinct, np.frombuffer(code, _codes(len(distinct)))))
    return out


def _pack(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        held: list = []
        for batch in batches:
            for at in range(0, len(batch), size):
                ids += batch["vec_id"].astype(object).where(batch["vec_id"].notna(), None).iloc[at : at + size].tolist()
                held += [np.stack(batch["vector"].iloc[at : at + size])]
                if len(ids) >= size:
                    yield pd.DataFrame([_packed(ids, np.concatenate(held))])
                    ids, held = [], []
        if ids:
            yield pd.DataFrame([_packed(ids, np.concatenate(held))])

    return pack


def dictionaries(vectors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of vectors (``ids``, ``parts``, ``codes``), stored for the rounds."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    packed = vectors.mapInPandas(_pack(chunk), f"ids array<{id_type}>, parts array<binary>, codes array<binary>")
    return stored(packed, "subvectors")


def nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every vector of a chunk; of equal distances the smaller cluster."""
    tables = []
    for (distinct, _), at in zip(blocks, range(0, centroids.shape[1], BLOCK)):
        apart = distinct[:, None, :] - centroids[None, :, at : at + BLOCK]
        tables.append((apart * apart).sum(axis=2))
    cluster, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(0, n, SLICE):
        total = np.zeros((min(SLICE, n - a), len(centroids)), np.int64)
        for table, (_, code) in zip(tables, blocks):
            total += table[code[a : a + SLICE]]
        cluster[a : a + SLICE] = total.argmin(axis=1)
        distance[a : a + SLICE] = total.min(axis=1)
    return cluster, distance


def _sums(centroids: np.ndarray):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dim = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for ids, parts, codes in zip(batch["ids"], batch["parts"], batch["codes"]):
                blocks = _unpacked(ids, parts, codes, dim)
                cluster, _ = nearest(blocks, centroids, len(ids))
                count += np.bincount(cluster, minlength=k)
                for (distinct, code), at in zip(blocks, range(0, dim, BLOCK)):
                    m = len(distinct)
                    met = np.bincount(cluster * m + code, minlength=k * m).reshape(k, m)
                    total[:, at : at + BLOCK] += met @ distinct
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used, "n": count[used], "total": pd.Series(total[used].tolist(), dtype=object)})

    return sums


def _assign(centroids: np.ndarray):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, parts, codes in zip(batch["ids"], batch["parts"], batch["codes"]):
                cluster, distance = nearest(_unpacked(ids, parts, codes, centroids.shape[1]), centroids, len(ids))
                yield pd.DataFrame({"vec_id": pd.Series(list(ids), dtype=object), "cluster": cluster.astype(np.int32), "distance": distance})

    return assign


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and id, in that order; at most k rows reach the driver."""
    rows = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector").limit(k)
    return np.array([r["vector"] for r in rows.select("vector").collect()], np.int64)


def centroid_clusters(
    df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:",
    id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length or with a null, NaN or infinite
    part have no row.  Repeated rows count as often as they occur; of vectors
    with equal hash the smaller goes first into the start, those without an id
    last.  Fewer than k vectors start as many clusters; clusters may become
    empty and keep their centroid.  An empty table gives no rows; a component
    beyond ``LIMIT`` after scaling ends the query.
    """
    spark = df.sparkSession
    vectors = kept_vectors(df, dim, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    chunks = dictionaries(vectors, chunk)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame(
            [], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    for _ in range(rounds):
        moved = chunks.mapInPandas(_sums(centroids), "cluster long, n long, total array<long>")
        by_part = moved.select("cluster", "n", *(F.col("total")[i].alias(f"t{i}") for i in range(dim)))
        found = by_part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(f"t{i}") for i in range(dim))).alias("total"))
        centroids = centroids.copy()
        for r in found.collect():  # one row per cluster
            centroids[r["cluster"]] = [t // r["n"] for t in r["total"]]
    assigned = stored(chunks.mapInPandas(_assign(centroids), f"vec_id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, s, sum(inertia.values()), digest(centroids[c].tolist())) for c, s in inertia.items()]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
