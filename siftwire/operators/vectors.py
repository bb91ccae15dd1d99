"""Exact nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..context import cut

#: Query vectors per block; a block of 64-dimensional floats takes under 1 MB.
BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id): the ``k`` rows of greatest cosine for each query, itself excepted; ties by id.

    The queries go to the tasks in blocks of BLOCK rows; every task keeps its own k best of each query, so the shuffle holds at most
    k rows a query and task.  Null and zero vectors match nothing.
    """
    spark = vectors.sparkSession
    rows = queries.filter(F.col(vector).isNotNull()).select(id_, vector).toLocalIterator()
    out, block = None, []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], np.int64)
        unit = _unit(np.array([r[1] for r in block], np.float64))
        shared = spark.sparkContext.broadcast((ids, unit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            best_s = np.full((len(q_ids), k), -np.inf)
            best_i = np.full((len(q_ids), k), -1, np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                v_ids = b.column(0).to_numpy()
                v = _unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                s = np.round(q @ v.T, 9)
                s[q_ids[:, None] == v_ids[None, :]] = -np.inf
                s[:, ~v.any(axis=1)] = -np.inf
                s = np.concatenate([best_s, s], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(v_ids, (len(q_ids), len(v_ids)))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            good = np.isfinite(best_s)
            at = np.nonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[0]]), pa.array(best_i[at]), pa.array(best_s[at])], ["query_id", "vec_id", "similarity"])

        return vectors.filter(F.col(vector).isNotNull()).select(F.col(id_).cast("bigint"), vector).mapInArrow(run, "query_id bigint, vec_id bigint, similarity double")

    for r in rows:
        block.append(r)
        if len(block) == BLOCK:
            out = search(block) if out is None else out.unionByName(search(block))
            block = []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank bigint, vec_id bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id")


def embed(texts: DataFrame, model, cache: DataFrame | None = None, most: int = 2000, batch: int = 64) -> DataFrame:  # noqa: ANN001
    """(node, vector): the vector of each text, those in ``cache`` (node, vector) taken from there, the others asked of ``model``, a
    function from a list of texts to a list of vectors, ``batch`` at a time in the tasks.

    Texts are cut at ``most`` characters, as the model reads no more.  Blank texts have no vector.  Written once, so no text is asked
    twice; the result is the next cache.
    """
    kind = texts.schema["node"].dataType.simpleString()
    rows = texts.filter("trim(text) != ''").select("node", F.substring("text", 1, most).alias("text")).dropDuplicates(["node"])
    if cache is not None:
        rows = rows.join(cache.select("node"), "node", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model(part.column(1).to_pylist()), pa.list_(pa.float32()))], ["node", "vector"])

    new = cut(rows.mapInArrow(run, f"node {kind}, vector array<float>"))
    return new if cache is None else new.unionByName(cache.join(texts.select("node").distinct(), "node", "left_semi").select("node", "vector"))


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """An offline stand-in for a model: counts of the words' hashes, with signs."""
    import zlib

    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out[i, h % size] += 1 if h >> 16 & 1 else -1
    return out.tolist()


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
