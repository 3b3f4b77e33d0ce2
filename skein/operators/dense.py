"""Exact dense search by cosine, and the predicates that go in front of it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_filter(document_id=None, document_type=None, specialty=None, year_from=None, year_to=None) -> Column:
    """The conjunction of what is given; falsy arguments count as not given. Rows that lack a column's value fail it."""
    preds = [F.col(c) == v for c, v in (("document_id", document_id), ("document_type", document_type), ("specialty", specialty)) if v]
    preds += [F.col("year") >= year_from] if year_from else []
    preds += [F.col("year") <= year_to] if year_to else []
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, to 6 decimals; null (nan) where a vector has no length."""
    size = np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None, :]
    return np.round(np.divide(v @ q.T, size, out=np.full(size.shape, np.nan), where=size > 0), 6)


def _nearest(scores: np.ndarray, ids: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Places of the k best scores of at least `threshold`, smaller ids first among equals."""
    at = np.nonzero(scores >= threshold)[0]
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(queries: DataFrame, corpus: DataFrame, qid: str, id_: str, k: int, threshold: float = 0.3, block: int = 4096) -> DataFrame:
    """(qid, id, score, rank) of the k nearest by cosine of at least `threshold`.

    Queries (a stated set) are taken in blocks of about `block`, each broadcast. A batch of vectors meets a block in one
    matrix product and gives its k best for each query, so what is shuffled is k rows a query and batch. Vectors of
    another size than the query's, and null ones, are not compared. Filters on the corpus come before."""
    spark, out = queries.sparkSession, None
    types = {f.name: f.dataType.simpleString() for f in [*queries.select(qid).schema, *corpus.select(id_).schema]}
    shape = f"{qid} {types[qid]}, {id_} {types[id_]}, score double"
    q = queries.select(qid, "q").where("q is not null")
    d = corpus.select(id_, "v").where("v is not null")
    parts = -(-q.count() // block)
    for part in range(parts):
        rows = (q if parts == 1 else q.where(F.pmod(F.xxhash64(qid), F.lit(parts)) == part)).collect()
        by_size: dict[int, tuple[list, list]] = {}
        for name, v in rows:
            names, vectors = by_size.setdefault(len(v), ([], []))
            names.append(name)
            vectors.append(v)
        held = spark.sparkContext.broadcast({n: (a, np.array(b, dtype=np.float64)) for n, (a, b) in by_size.items()})

        def run(frames, held=held):
            for frame in frames:
                sizes = frame["v"].map(len)
                for n, (names, vectors) in held.value.items():
                    same = frame[sizes == n]
                    for lo in range(0, len(same), 2048):
                        some = same.iloc[lo : lo + 2048]
                        ids, scores = some[id_].to_numpy(), cosines(np.stack(some["v"].to_numpy()).astype(np.float64), vectors)
                        best = [_nearest(scores[:, j], ids, k, threshold) for j in range(len(names))]
                        yield pd.DataFrame({qid: np.repeat(np.array(names, dtype=object), [len(b) for b in best]), id_: ids[np.concatenate(best)], "score": np.concatenate([scores[b, j] for j, b in enumerate(best)])})

        found = d.mapInPandas(run, shape)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], shape + ", rank int")
    r = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), id_))
    return out.withColumn("rank", r).where(F.col("rank") <= k)
