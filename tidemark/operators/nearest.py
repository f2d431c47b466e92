"""Nearest neighbours by cosine similarity: exactly, by blocked matrix products, and by an inverted-file index.

Queries go to the workers as matrices, in blocks of a bounded size; records stream past them in Arrow batches, one matrix
product each. A task keeps its best k of each query and gives them at its end, so what is shuffled is tasks x queries x k rows,
whatever the number of records. More queries than a block holds take one pass over the records for each block.

Defined cases: zero vectors, nulls, vectors with null or non-finite parts, and vectors of another length than the query's match
nothing; ties go to the smaller record id; a top-k leaves out scores of exactly zero, a threshold search has them if it lets
them; repeated rows are records of their own; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.plans.tables import Scratch

#: Numbers in a block of queries (128 MB), and scores computed at once (32 MB).
BLOCK, SCORES = 16_000_000, 4_000_000
#: Rows that the cells of an index are fitted on.
SAMPLE = 50_000


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors as a matrix) of the usable vectors, for each length."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        m = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            yield at[ok], m[ok] / norm[ok, None]


class Best:
    """The k best records of each query so far: greatest score to so many places, then smallest id."""

    def __init__(self, queries: int, k: int, places: int = 9) -> None:
        self.k, self.places = k, places
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.empty((queries, k), object)

    def add(self, scores: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """Scores of queries (all, or those named) by records."""
        of = np.arange(len(self.scores)) if of is None else of
        k, both = self.k, np.concatenate([self.scores[of], scores], axis=1)
        every = np.concatenate([self.ids[of], np.broadcast_to(ids, scores.shape)], axis=1)
        r = np.round(both, self.places)
        keep = np.argpartition(-r, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(r, keep, 1).min(axis=1)
        for i in np.flatnonzero(((r >= last[:, None]).sum(axis=1) > k) & (last > -np.inf)):  # ties at the last place
            some = np.flatnonzero(r[i] >= last[i])
            keep[i] = sorted(some, key=lambda j: (-r[i, j], every[i, j]))[:k]
        self.scores[of], self.ids[of] = np.take_along_axis(both, keep, 1), np.take_along_axis(every, keep, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, at = np.nonzero(self.scores > -np.inf)
        return q, self.ids[q, at], self.scores[q, at]


def _blocks(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    """The queries in tables of at most ``most`` rows, in expectation where there are several."""
    some = queries.limit(most + 1).toArrow()
    if some.num_rows <= most:
        if some.num_rows:
            yield some.combine_chunks()
        return
    n = -(-queries.count() // most)
    for i in range(n):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow().combine_chunks()


def _one(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else c.chunk(0)


def _scored(records: DataFrame, block: pa.Table, named: StructField, k: int | None, least: float | None, probes: dict[int, np.ndarray] | None = None) -> DataFrame:
    """``query_id``, ``record_id``, ``score``: of each task the best k, or all of at least ``least``.

    With probes (size -> queries by cells, whether the query looks into the cell) records have a ``cell``.
    """
    asked = _one(block, "query_id")
    by_size = {m.shape[1]: (at, m) for at, m in matrices(_one(block, "query"))}
    shared = records.sparkSession.sparkContext.broadcast((by_size, probes, asked))
    kind = StructType([named, records.schema["record_id"], StructField("score", DoubleType())])
    arrow = to_arrow_schema(kind)

    def batch(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([shared.value[2].take(pa.array(q, pa.int64())), pa.array(ids.tolist(), arrow.field(1).type), pa.array(scores)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, looks, _ = shared.value
        best = {s: Best(len(at), k) for s, (at, _) in sizes.items()} if least is None else {}
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), object)
            for places, m in matrices(b.column(1)):
                if m.shape[1] not in sizes:
                    continue
                at, q = sizes[m.shape[1]]
                if looks is None:
                    groups = [(slice(None), None)]
                else:
                    cells = b.column(2).to_numpy(zero_copy_only=False)[places]
                    groups = [(np.flatnonzero(cells == c), np.flatnonzero(looks[m.shape[1]][:, c])) for c in np.unique(cells)]
                for some, of in groups:
                    wanted = q if of is None else q[of]
                    mine, own = m[some], places[some]
                    step = max(1, SCORES // max(1, len(wanted)))
                    for i in range(0, len(mine) if len(wanted) else 0, step):
                        s = wanted @ mine[i : i + step].T
                        if least is None:
                            s[s == 0] = -np.inf
                            best[m.shape[1]].add(s, ids[own[i : i + step]], of)
                        else:
                            x, y = np.nonzero(s >= least)
                            yield batch(at[x], ids[own[i : i + step]][y], s[x, y])
        for s, kept in best.items():
            x, found, scores = kept.rows()
            yield batch(sizes[s][0][x], found, scores)

    return records.mapInArrow(run, kind)


def _ranked(hits: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "record_id")
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _empty(records: DataFrame, queries: DataFrame) -> DataFrame:
    kind = StructType([queries.schema["query_id"], records.schema["record_id"], StructField("score", DoubleType())])
    return records.sparkSession.createDataFrame([], kind)


def nearest(records: DataFrame, queries: DataFrame, k: int | None, least: float | None = None, most_queries: int = 10_000) -> DataFrame:
    """``query_id``, ``record_id``, ``score``, ``rank``: the k records of greatest cosine similarity, exactly;
    without k all, as of a threshold search with ``least``.

    records: record_id, embedding; queries: query_id, query (vector).
    """
    if k is None and least is None:
        raise ValueError("neither a number of records nor a threshold")
    rows = records.select("record_id", "embedding")
    out = None
    for block in _blocks(queries.select("query_id", "query").filter(F.size("query") > 0), most_queries):
        hits = _scored(rows, block, queries.schema["query_id"], k, least)
        out = hits if out is None else out.unionByName(hits)
    out = _ranked(_empty(records, queries) if out is None else out, k)
    return out if least is None or k is None else out.filter(F.col("score") >= least)


def fitted_cells(records: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids fitted on the ``sample`` records of least hash, by spherical k-means."""
    some = records.filter(F.size("embedding") > 0).orderBy(F.xxhash64("record_id"), "record_id").limit(sample).select("embedding").toArrow()
    found = list(matrices(_one(some, "embedding"))) if some.num_rows else []
    if not found:
        return np.zeros((0, 0))
    m = max((x for _, x in found), key=len)  # the length that most vectors have
    centre = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(m @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centre)
    return centre


class VectorIndex:
    """An inverted file: every record in the cell of its nearest centroid, written by cells, so that a search reads those it asks.

    The centroids are fitted on a bounded sample; all records of the sample's vector length are indexed, others can't match its
    queries. A search looks into the ``probes`` cells nearest to each query: with as many as there are cells it is exact.
    """

    def __init__(self, records: DataFrame, cells: int = 256, sample: int = SAMPLE) -> None:
        self.spark: SparkSession = records.sparkSession
        rows = records.select("record_id", "embedding")
        self.centre = fitted_cells(rows, cells, sample)
        self.records = records
        if not len(self.centre):
            return
        shared = self.spark.sparkContext.broadcast(self.centre)
        kind = StructType([*rows.schema.fields, StructField("cell", StructType.fromDDL("x int")["x"].dataType)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for places, m in matrices(b.column(1)):
                    if m.shape[1] == shared.value.shape[1]:
                        own = np.argmax(m @ shared.value.T, axis=1).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*b.take(pa.array(places)).columns, pa.array(own)], [*b.schema.names, "cell"])

        self.folder = Scratch(self.spark).folder()
        # sorted by cells in each task: a cell with a third of all records is in the files of all tasks
        rows.mapInArrow(run, kind).sortWithinPartitions("cell").write.partitionBy("cell").parquet(self.folder)
        self.kind = kind

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """Probes, from an eighth of the cells on, doubled until this share of what ``nearest`` finds for some queries is found."""
        want = nearest(self.records, queries, k).select("query_id", "record_id")
        n, all_ = max(1, len(self.centre) // 8), want.count()
        while n < len(self.centre) and self.search(queries, k, n).join(want, ["query_id", "record_id"]).count() < recall * all_:
            n *= 2
        return min(n, max(1, len(self.centre)))

    def search(self, queries: DataFrame, k: int, probes: int = 16, most_queries: int = 10_000) -> DataFrame:
        """As ``nearest``, among the records of the cells that are looked into."""
        out, n = None, min(probes, len(self.centre))
        for block in _blocks(queries.select("query_id", "query").filter(F.size("query") > 0), most_queries) if n else ():
            for at, q in matrices(_one(block, "query")):
                if q.shape[1] != self.centre.shape[1]:
                    continue
                near = np.argpartition(-(q @ self.centre.T), n - 1, axis=1)[:, :n]
                looks = np.zeros((len(q), len(self.centre)), bool)
                np.put_along_axis(looks, near, True, axis=1)
                rows = self.spark.read.schema(self.kind).parquet(self.folder).filter(F.col("cell").isin(np.flatnonzero(looks.any(axis=0)).tolist()))
                hits = _scored(rows.select("record_id", "embedding", "cell"), block, queries.schema["query_id"], k, None, {q.shape[1]: looks})
                out = hits if out is None else out.unionByName(hits)
        return _ranked(_empty(self.records, queries) if out is None else out, k)
