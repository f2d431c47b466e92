"""BM25 for batches of queries, with lengths in characters and statistics over the whole corpus.

One pass over the records writes, for each, which of the queries' terms it has and how often: nothing is shuffled. Document
frequencies come from that table, whose size is that of the hits. Scores are products of its rows with the queries' terms as a
matrix, in Arrow batches; a task keeps its best k of each query, so a top-k shuffles tasks x queries x k rows at most.

Defined cases: null and empty texts and queries match nothing; a null text counts as a record, but not in the mean length;
repeated rows are records of their own; ties go to the smaller record id; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.functions import text
from tidemark.operators.nearest import BLOCK, SCORES, Best
from tidemark.plans.tables import Scratch, spread

K1, B = 1.2, 0.75
#: Terms of queries in a pass over the records (some 50 MB).
TERMS = 1_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id``, ``term``: the different terms of queries (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))


def _postings(records: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``record_id``, ``chars``, ``codes``, ``counts``: which terms each record has (places in the vocabulary), how often."""
    shared = records.sparkSession.sparkContext.broadcast(vocabulary)
    kind = StructType([records.schema["record_id"], *StructType.fromDDL("chars int, codes array<int>, counts array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for b in batches:
            words = b.column(2)
            code = pc.index_in(words.flatten(), value_set=known)
            of = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
            hit = code.is_valid().to_numpy(zero_copy_only=False)
            each = of[hit].astype(np.int64) * max(1, len(known)) + code.drop_null().to_numpy(zero_copy_only=False)
            each, n = np.unique(each, return_counts=True)
            ends = np.searchsorted(each, np.arange(b.num_rows + 1) * max(1, len(known))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (each % max(1, len(known)), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["record_id", "chars", "codes", "counts"])

    words = F.coalesce(F.regexp_extract_all(F.lower("content"), F.lit(text.WORD)), F.array().cast("array<string>"))
    return spread(records.select("record_id", "content")).select("record_id", F.length("content").alias("chars"), words.alias("words")).mapInArrow(run, kind)


class _Queries:
    """A block of queries as matrices of terms by queries: all terms, own terms, anchors."""

    def __init__(self, at: np.ndarray, code: np.ndarray, own: np.ndarray, anchor: np.ndarray, first: int, last: int) -> None:
        some = (at >= first) & (at < last)
        self.first, self.n = first, last - first
        self.codes, place = np.unique(code[some], return_inverse=True)
        shape, q = (len(self.codes), self.n), at[some] - first
        self.own, self.anchor = (np.zeros(shape) for _ in range(2))
        self.own[place, q], self.anchor[place, q] = own[some], anchor[some]
        self.all = np.maximum(self.own, self.anchor)


def _by_record(weights: np.ndarray, codes: np.ndarray, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Sums of weighted rows of ``terms`` over each record's codes."""
    return np.add.reduceat(terms[codes] * weights[:, None], starts, axis=0)


def _judged(mode: str, w: np.ndarray, codes: np.ndarray, starts: np.ndarray, q: _Queries) -> tuple[np.ndarray, np.ndarray]:
    """(score, tier) of records by queries; tier 0 where there is no hit."""
    own = _by_record(w, codes, starts, q.own)
    if mode == "any":
        return own, np.where(own > 0, 3, 0)
    one = np.ones(len(w))
    count = lambda m: _by_record(one, codes, starts, m)
    strict = (count(q.own) == q.own.sum(axis=0)) & (own > 0)
    if mode == "all":
        return own, strict.astype(int)
    anchors, n = q.anchor.sum(axis=0), count(q.anchor)
    anchored = (n == anchors) & ((count(q.all) > n) | (q.all.sum(axis=0) == anchors))
    score = _by_record(w, codes, starts, q.all)
    if mode == "anchored":
        return score, np.where(anchored & (score > 0), 2, 0)
    tier = np.where(strict, 1, np.where(anchored & (anchors > 0), 2, np.where(own > 0, 3, 0)))
    return np.where(tier == 2, score, own), tier


def _hits(records: DataFrame, queries: DataFrame, anchors: DataFrame | None, mode: str, k: int | None) -> DataFrame:
    """``query_id``, ``record_id``, ``score``, ``tier``: all hits, or of each task the best k by tier and score."""
    terms = query_terms(queries).withColumn("own", F.lit(1.0))
    if anchors is not None:
        terms = terms.join(anchors.select("query_id", "term").distinct().withColumn("anchor", F.lit(1.0)), ["query_id", "term"], "full").fillna(0.0, ["own", "anchor"])
    else:
        terms = terms.withColumn("anchor", F.lit(0.0))
    some = terms.limit(TERMS + 1).toArrow()
    if some.num_rows <= TERMS:
        return _pass(records, some, queries.schema["query_id"], mode, k)
    n = -(-terms.count() // TERMS)
    parts = [_pass(records, terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow(), queries.schema["query_id"], mode, k) for i in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pass(records: DataFrame, terms: pa.Table, asked: StructField, mode: str, k: int | None) -> DataFrame:
    spark = records.sparkSession
    kind = StructType([asked, records.schema["record_id"], StructField("score", DoubleType()), StructField("tier", IntegerType())])
    if not terms.num_rows:
        return spark.createDataFrame([], kind)
    whole = terms.combine_chunks()
    ids, words = (whole.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    postings = Scratch(spark).write(_postings(records, words.dictionary.to_pylist()))
    pool = postings.agg(F.count("*"), F.avg("chars")).first()
    frequency = postings.select(F.explode("codes").alias("code")).groupBy("code").count().toArrow()  # no larger than the vocabulary
    df = np.zeros(len(words.dictionary))
    df[frequency.column("code").to_numpy()] = frequency.column("count").to_numpy()
    at, code = (x.indices.to_numpy().astype(np.int64) for x in (ids, words))
    own, anchor = (whole.column(c).to_numpy() for c in ("own", "anchor"))
    shared = spark.sparkContext.broadcast((at, code, own, anchor, np.log(1 + (pool[0] - df + 0.5) / (df + 0.5)), max(pool[1] or 1.0, 1.0), ids.dictionary))
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, code, own, anchor, idf, mean, names = shared.value
        size = max(1, BLOCK // 3 // len(idf))
        blocks = [(i, min(i + size, len(names))) for i in range(0, len(names), size)]
        best = Best(len(names), k, 6) if k else None
        kept = [_Queries(at, code, own, anchor, *x) for x in blocks] if len(blocks) == 1 else None
        for b in batches:
            ends = b.column(2).offsets.to_numpy()
            codes, counts = (b.column(i).values.to_numpy() for i in (2, 3))
            some = np.flatnonzero(np.diff(ends))
            record = np.array(b.column(0).to_pylist(), object)
            chars = np.repeat(b.column(1).fill_null(0).to_numpy()[some], np.diff(ends)[some])
            base = ends[0]
            codes, counts = codes[base : ends[-1]], counts[base : ends[-1]]
            weight = idf[codes] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * chars / mean))
            for q in kept or (_Queries(at, code, own, anchor, *x) for x in blocks):
                place = np.full(len(idf), -1)
                place[q.codes] = np.arange(len(q.codes))
                mine = place[codes]
                of = np.repeat(np.arange(len(some)), np.diff(ends)[some])[mine >= 0]
                w, mine = weight[mine >= 0], mine[mine >= 0]
                step = max(1, SCORES // q.n)
                cut = 0
                while cut < len(mine):
                    # whole records, about so many terms of them
                    end = len(mine) if cut + step >= len(mine) else max(int(np.searchsorted(of, of[cut + step])), int(np.searchsorted(of, of[cut], "right")))
                    row, starts = np.unique(of[cut:end], return_index=True)
                    score, tier = _judged(mode, w[cut:end], mine[cut:end], starts, q)
                    cut = end
                    if best is not None:
                        rank = np.where(tier > 0, score + (3 - tier) * 1e6, -np.inf)
                        best.add(rank.T, record[some[row]], np.arange(q.first, q.first + q.n))
                    else:
                        x, y = np.nonzero(tier)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(y + q.first)), pa.array(record[some[row[x]]].tolist(), arrow.field(1).type), pa.array(score[x, y]), pa.array(tier[x, y].astype(np.int32))], schema=arrow)
        if best is not None:
            y, found, rank = best.rows()
            tier = 3 - (rank // 1e6).astype(np.int32)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(y)), pa.array(found.tolist(), arrow.field(1).type), pa.array(rank - (3 - tier) * 1e6), pa.array(tier)], schema=arrow)

    return postings.mapInArrow(run, kind)


def bm25(records: DataFrame, queries: DataFrame, mode: str = "any", anchors: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """``query_id``, ``record_id``, ``score`` of all hits; with k at least the k best of each query by rounded score.

    mode: ``any`` term of the query, ``all`` terms, or ``anchored``: all terms of ``anchors`` (query_id, term) and any other.
    """
    return _hits(records, queries, anchors, mode, k).select("query_id", "record_id", "score")


def ladder(records: DataFrame, queries: DataFrame, anchors: DataFrame, limit: int, relax: bool = True, allowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Strict hits first, then anchored ones, then any: each record once, at most 3 * limit a query; ``tier`` 1 to 3, ``rank``.

    All tiers are read off one pass over the records. With ``relax`` off, a query with anchors gets hits of the last tier only
    if it has no others: records about other subjects are what anchors keep out. ``allowed`` takes hits out before any are cut.
    """
    rows = _hits(records, queries, anchors, "ladder", None if allowed else 3 * limit)
    rows = allowed(rows) if allowed else rows
    if not relax:
        best = F.min("tier").over(Window.partitionBy("query_id"))
        rows = rows.join(anchors.select("query_id").distinct().withColumn("held", F.lit(True)), "query_id", "left")
        rows = rows.withColumn("best", best).filter("held is null or tier < 3 or best = 3").drop("held", "best")
    w = Window.partitionBy("query_id").orderBy("tier", F.round("score", 6).desc(), "record_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 3 * limit)
