"""Exact top-k by inner product: MaxScore over shards of an inverted index, the shards' best merged.

Dimensions are the terms. Vectors are dealt to shards by hash; within a shard each dimension has a posting list of
weights in row order (vectors are dense, so the row is the place). Weights may be negative: a term's bound is the most that it
can add in the shard, and its spread, the distance to the least it can add, is what decides whether it is essential.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_NO_ID = np.iinfo(np.int64).max
#: Largest number of rows in a shard, whatever the number of queries: some 70 MB at 64 dimensions.
SHARD_ROWS = 131_072
#: Non-essential terms probed between two looks at who is still competitive.
STRIDE = 8
HITS = "query_row long, query_id long, vec_id long, score long"


def quantized(vector: Column, limit: Column | int) -> Column:
    """``floor(256 * x)`` of every component, held within ±limit; null for vectors that are null or hold a null or non-finite one."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(limit)), -F.lit(limit)))
    return F.when(sound, scaled)


def max_score(weights: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """The k best (row, score) of one shard, ties to the smaller id. ``weights``: dimension by row; ``low``, ``high``: their extremes.

    Terms go by spread, largest first. The last terms whose spreads together cannot lift a row that has the least weight in all
    others to the k-th score are non-essential: rows are found by the essential postings, and the others are probed only for
    rows whose bound still reaches the k-th score. Every row that could be told is scored in full.
    """
    terms = np.flatnonzero(query)
    most = np.maximum(query[terms] * low[terms], query[terms] * high[terms])
    least = np.minimum(query[terms] * low[terms], query[terms] * high[terms])
    order = np.argsort(least - most, kind="stable")
    terms, most, least = terms[order], most[order], least[order]
    may_add = np.append(np.cumsum(most[::-1])[::-1], 0)  # from each term on, at most
    rows = np.flatnonzero(ids != own)
    if not len(rows):
        return []
    # The k-th score of the rows that the widest terms put first is a floor of the final one.
    lead = terms[: max(1, len(terms) // 4)]
    guess = query[lead] @ weights[lead]
    guess[ids == own] = np.iinfo(np.int64).min if guess.dtype.kind == "i" else -np.inf
    first = rows if len(rows) <= k else np.argpartition(guess, len(guess) - k)[-k:]
    floor = (query[terms] @ weights[terms][:, first]).min() if len(first) == k else -np.inf
    # Essential: up to where the rest could not lift a row of least weights to the floor.
    reach = np.concatenate([[0], np.cumsum(least)]) + may_add
    essential = int(np.argmax(reach < floor)) if (reach < floor).any() else len(terms)
    score = query[terms[:essential]] @ weights[terms[:essential]]
    rows = rows[score[rows] + may_add[essential] >= floor]
    score = score[rows]
    for at in range(essential, len(terms), STRIDE):
        probe = terms[at : at + STRIDE]
        score = score + query[probe] @ weights[np.ix_(probe, rows)]
        still = score + may_add[min(at + STRIDE, len(terms))] >= floor
        rows, score = rows[still], score[still]
    if len(rows) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[score >= kth], score[score >= kth]
    best = np.lexsort((ids[rows], -score))[:k]
    return [(int(rows[i]), int(score[i])) for i in best]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best other rows of each row for which ``queries`` holds.

    Scores are inner products of ``floor(256 * x)``, exact; ties go to the smaller id. Vectors that are null, or hold a null
    or non-finite component, take no part; shorter vectors count as padded with zeros, and empty ones score zero. Rows with the query's
    id are its own; rows without id are no queries, and as candidates come last among ties; of rows that repeat a query's id each
    has a list of its own. Components so large that a score might leave 64 bits are held at the largest that cannot.
    An empty table, or one without queries, gives no rows. Other columns play no part.

    There are as many shards as the root of the number of queries, and more where a shard would have over ``SHARD_ROWS``
    rows; every query goes to every shard, which streams them past its index, so that a task holds one shard. Rows are dealt by
    id and place, so that neither repeated ids nor repeated vectors meet in one shard. The shards' lists, at most k rows each, are merged by a window.
    """
    spark, ident = vectors.sparkSession, F.col(id_col).cast("long")
    asked = F.coalesce(queries, F.lit(False)) & ident.isNotNull()
    raw = vectors.select(ident.alias("id"), F.col(vector_col).alias("raw"), F.monotonically_increasing_id().alias("row"), asked.alias("asked"))
    size = raw.agg(F.max(F.size("raw")).alias("width"), F.count("*").alias("n"), F.count_if("asked").alias("queries")).first()
    width = max(size.width or 0, 1)
    limit = int(((2**62) // width) ** 0.5)
    shards = max(1, int(np.ceil(size.queries**0.5)), -(-size.n // SHARD_ROWS))
    sound = raw.select("id", "row", "asked", quantized(F.col("raw"), limit).alias("v")).where("v IS NOT NULL")
    rows = sound.select(F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "row", "id", "v")
    spread = sound.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "row", "id", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.union(spread).repartition(max(parts, shards), "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, index = None, [], None
        for batch in batches:
            shard, kind, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            ids = batch.column(3).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column(4), width)
            found: list[tuple] = []
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1), len(shard)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if shard[start] != now:
                    now, pieces, index = shard[start], [], None
                if kind[start] == 0:
                    pieces.append((ids[start:end], matrix[start:end]))
                    continue
                if not pieces and index is None:
                    continue
                if index is None:
                    index = _index(pieces)
                    pieces = []
                theirs, weights, low, high = index
                for i in range(start, end):
                    exact = _exact(matrix[i], low, high)
                    w = weights if exact else weights.astype(np.int64)
                    for at, score in max_score(w, theirs, matrix[i].astype(w.dtype), int(ids[i]), k, low.astype(w.dtype), high.astype(w.dtype)):
                        found.append((int(row[i]), int(ids[i]), None if theirs[at] == _NO_ID else int(theirs[at]), score))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=[f.split()[0] for f in HITS.split(", ")])

    hits = dealt.mapInArrow(run, HITS)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _index(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, the posting list of each dimension in that order, and each dimension's extremes."""
    ids = np.concatenate([p[0] for p in pieces])
    order = np.argsort(ids, kind="stable")
    weights = np.concatenate([p[1] for p in pieces])[order].T
    low, high = weights.min(axis=1), weights.max(axis=1)
    # Products of doubles are exact and fast where all is small, as in any real embedding.
    small = max(-int(low.min()), int(high.max())) < 2**26
    return ids[order], np.ascontiguousarray(weights, dtype=np.float64 if small else np.int64), low, high


def _exact(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
    """No sum of products leaves the whole numbers that doubles hold."""
    return sum(abs(int(q)) * max(abs(int(a)), abs(int(b))) for q, a, b in zip(query, low, high)) < 2**53
