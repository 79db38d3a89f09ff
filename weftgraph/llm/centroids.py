"""Centroid clustering by delta Lloyd.

Method.  Each vector keeps its owner and the distance to it; the driver keeps the sum and
count of every cluster (clusters x components numbers, whatever the input).  A round
compares a vector whose owner stood still with the centroids that changed only, and a
vector whose owner moved with all of them.  What changes hands is sent as signed integers:
minus the vector for the old cluster, plus the vector for the new one, added up within each
block of vectors before it is aggregated.  Sums are integers, so they stay exact however
many rounds they are carried on.

A row of the state is a block of vectors, their owners and distances, and the block's
transfers.  Each round reads one version of the state and writes the next in the shared
folder; the one before is removed then, and a lost executor costs a reread.

Defined results: vectors with another number of components, a null or a non-finite
one are left out; null ids are vectors of their own, which start no centroid while others
are left; repeated ids and vectors count each; fewer vectors than centroids make fewer
clusters; an empty table gives an empty result; extra columns are ignored.  Ties of the start
go to the vector that is first component by component.  Components of 2**26 or
more after scaling raise an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.iterate import Versions

BLOCK = 4096
#: up to it, products of doubles are exact; from LARGEST on, distances leave the range of a long
EXACT, LARGEST = 1 << 22, 1 << 26
STATE = "ids array<{kind}>, vectors binary, owners binary, distances binary, moved int, transfers array<struct<cluster:int,n:long,sums:array<long>>>"


def integer_vectors(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v: array<long>) of the vectors that are kept."""
    whole = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) exact squared distances."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT // 2:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", v, v)[:, None] - 2 * (v @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(vectors: np.ndarray, owners: np.ndarray, distances: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners (ties: the smaller number) and distances after the centroids marked ``changed`` moved; owner -1: none yet."""
    owners, distances = owners.copy(), distances.copy()
    stirred = (owners < 0) | changed[owners]
    if stirred.any():
        every = squares(vectors[stirred], centroids)
        owners[stirred] = every.argmin(axis=1)
        distances[stirred] = every.min(axis=1)
    calm, some = np.flatnonzero(~stirred), np.flatnonzero(changed)
    if len(calm) and len(some):
        few = squares(vectors[calm], centroids[some])
        which, least = some[few.argmin(axis=1)], few.min(axis=1)
        takes = (least < distances[calm]) | ((least == distances[calm]) & (which < owners[calm]))
        owners[calm[takes]], distances[calm[takes]] = which[takes], least[takes]
    return owners, distances


def transfers(vectors: np.ndarray, was: np.ndarray, now: np.ndarray) -> list[dict]:
    """Signed sums and counts that clusters gain."""
    moved = np.flatnonzero(was != now)
    ends, signs = np.concatenate([was[moved], now[moved]]), np.repeat([-1, 1], len(moved))
    twice = vectors[np.concatenate([moved, moved])] * signs[:, None]
    return [{"cluster": c, "n": int(signs[ends == c].sum()), "sums": twice[ends == c].sum(axis=0).tolist()} for c in np.unique(ends[ends >= 0]).tolist()]


def _blocks(kept: DataFrame, dims: int) -> DataFrame:
    """The state in which no vector has an owner."""
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                if np.abs(vectors).max(initial=0) >= LARGEST:
                    raise ArithmeticError(f"a component of {LARGEST} or more: squared distances would not fit a long")
                n = len(vectors)
                row = [part.column(0)], [vectors.astype(np.int16 if np.abs(vectors).max() < 1 << 15 else np.int32).tobytes()], [np.full(n, -1, np.int16).tobytes()], [np.zeros(n, np.int64).tobytes()], [n], [[]]
                yield _batch(row, part.column(0).type)

    return kept.select("vec_id", "v").mapInArrow(run, STATE.format(kind=kind))


def _batch(row: tuple, kind: pa.DataType) -> pa.RecordBatch:
    ids, vectors, owners, distances, moved, given = row
    sent = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    columns = [pa.ListArray.from_arrays(pa.array([0, len(ids[0])], pa.int32()), ids[0]), pa.array(vectors, pa.binary()), pa.array(owners, pa.binary()), pa.array(distances, pa.binary()), pa.array(moved, pa.int32()), pa.array(given, sent)]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "vectors", "owners", "distances", "moved", "transfers"])


def _unpacked(batch: pa.RecordBatch, k: int, dims: int) -> tuple:
    """(ids, stored vectors, vectors, owners, distances) of row ``k``."""
    ids = batch.column(0)[k].values
    raw = batch.column(1)[k].as_py()
    vectors = np.frombuffer(raw, np.int16 if len(raw) == 2 * dims * len(ids) else np.int32).reshape(-1, dims).astype(np.int64)
    return ids, raw, vectors, np.frombuffer(batch.column(2)[k].as_py(), np.int16), np.frombuffer(batch.column(3)[k].as_py(), np.int64)


def _step(state: DataFrame, centroids: np.ndarray, changed: np.ndarray, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, raw, vectors, was, distances = _unpacked(batch, k, dims)
                now, distances = assign(vectors, was, distances, centroids, changed)
                yield _batch(([ids], [raw], [now.astype(np.int16).tobytes()], [distances.tobytes()], [int((was != now).sum())], [transfers(vectors, was, now)]), ids.type)

    return state.mapInArrow(run, state.schema)


def cluster(rows: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors (vec_id, embedding).

    Centroids start as the vectors whose ids, behind ``salt``, have the least SHA-256; each of ``rounds``
    assigns and moves them to the floor of the mean of their vectors, then vectors are assigned once more."""
    kept = integer_vectors(rows, dims, scale)
    drawn = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = kept.select("v", drawn.alias("draw")).orderBy(F.asc_nulls_last("draw"), "v").limit(clusters).collect()  # as many rows as clusters
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, dims)
    count, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    versions = Versions(rows.sparkSession)
    state = versions.write(_blocks(kept, dims))
    changed = np.ones(len(centroids), bool)
    for k in range(rounds + 1):
        if not len(centroids) or not changed.any():
            break
        state = versions.write(_step(state, centroids, changed, dims))
        if k == rounds:
            break
        sent = state.filter("moved > 0").select(F.explode("transfers").alias("t"))
        totals = [F.sum(F.col("t.sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
        for r in sent.groupBy("t.cluster").agg(F.sum("t.n").alias("n"), *totals).collect():  # a row a cluster
            count[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + int(r[f"s{i}"]) for i, a in enumerate(sums[r["cluster"]])]
        moved = np.array([[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, count, centroids, strict=True)], np.int64).reshape(-1, dims)
        changed = (moved != centroids).any(axis=1)
        centroids = moved
    return _result(state, rows.schema["vec_id"].dataType.simpleString(), centroids, dims)


def _result(state: DataFrame, kind: str, centroids: np.ndarray, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, _, _, owners, distances = _unpacked(batch, k, dims)
                yield pa.RecordBatch.from_arrays([ids, pa.array(owners.astype(np.int32)), pa.array(distances)], names=["vec_id", "cluster", "distance"])

    rows = state.select("ids", "vectors", "owners", "distances").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    each = {r["cluster"]: r["total"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row a cluster
    about = [(c, each.get(c, 0), sum(each.values()), d) for c, d in digests]
    named = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
