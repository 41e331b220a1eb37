"""Exact top-k search by inner product: buckets of equal length, pruned by local cosine thresholds.

Vectors are sorted by falling length (Euclidean norm) over the whole table and cut into groups of at
most ``GROUP`` vectors; a group is worked on by one task in buckets of ``BUCKET`` vectors. A query
needs a score of at least its k-th best one so far, so in a bucket whose longest vector has the norm
l only vectors whose cosine with the query q reaches t = kth / (|q| * l) can matter:

- t above 1: the bucket and all behind it are skipped (whole groups even before the query is sent to them);
- t of ``COORDINATES_FROM`` or more: coordinate pruning. A unit vector with a cosine of t or more lies, in
  each coordinate f, within q_f * t -+ sqrt((1 - t^2) * (1 - q_f^2)); vectors outside of that in one of the
  query's ``FOCUS`` largest coordinates go;
- else length pruning: of the bucket only the vectors of norm kth / |q| and more stay.

What stays is verified by its inner product, which is exact: in doubles where no sum can reach 2^53,
in Python's integers otherwise. First thresholds come from the ``SEEDS`` longest vectors.

Edge cases: vectors that are null or hold a component that is null, NaN or infinite (also once scaled) take no part; a query
meets vectors of its own dimension only; a query with fewer than k partners gets all of them; a null
id makes no query, but its vector is a candidate and stands behind all ids among ties; of several rows
with one id each is a query and a candidate of the others; ties of score and id are told apart by an
arbitrary but fixed row number; scores beyond 64 bits are held at their limits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .shared import written

GROUP, BUCKET, QUERIES_AT_ONCE = 1 << 16, 1024, 512
#: Vectors that give the first thresholds; they are sent to all tasks.
SEEDS = 2048
COORDINATES_FROM, FOCUS = 0.9, 4
_SLACK = 1e-9
_LIMIT = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (whole numbers, as doubles) and ``norm`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < F.lit(float("inf"))))
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("raw"))
    whole = F.transform("raw", lambda x: _floor(x * F.lit(float(scale))))
    return rows.select("id", whole.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _floor(x: Column) -> Column:
    """Floor as a double; the largest doubles are whole and may lie beyond 64 bits."""
    return F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The rows (all of ``size`` components) of a list column as a matrix."""
    offsets = column.offsets.to_numpy()[rows]
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[:, None] + np.arange(size)]


class Vectors:
    """Vectors of one dimension with ids and row numbers, by falling norm."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, row: np.ndarray, norm: np.ndarray, v: np.ndarray):
        by = np.argsort(-norm, kind="stable")
        self.ids, self.known, self.row, self.norm, self.v = ids[by], known[by], row[by], norm[by], v[by]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            self.unit = np.nan_to_num(self.v / self.norm[:, None])

    def products(self, queries: np.ndarray, norms: np.ndarray, which: np.ndarray | slice) -> np.ndarray:
        """Inner products as 64-bit integers."""
        some = self.v[which]
        top = float(norms.max(initial=0)) * float(self.norm[which].max(initial=0))
        if top < 2.0 ** 52:
            return (queries @ some.T).astype(np.int64)
        exact = [[sum(int(a) * int(b) for a, b in zip(q, v)) for v in some] for q in queries]
        return np.array([[min(max(s, -_LIMIT), _LIMIT) for s in row] for row in exact], np.int64).reshape(len(queries), len(some))


class Best:
    """The k best (score, id, row) so far of some queries; -limit stands for none."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), _LIMIT)
        self.known = np.zeros((n, k), bool)
        self.row = np.full((n, k), _LIMIT)

    def kth(self) -> np.ndarray:
        """What a score must reach, as doubles; -inf where any does."""
        last = self.score[:, -1]
        own = np.where(last == np.iinfo(np.int64).min, -np.inf, last.astype(np.float64))
        return np.maximum(own, self.least)

    def put(self, q: int, score: np.ndarray, vectors: Vectors, at: np.ndarray) -> None:
        score, ids = np.append(self.score[q], score), np.append(self.id[q], vectors.ids[at])
        known, row = np.append(self.known[q], vectors.known[at]), np.append(self.row[q], vectors.row[at])
        by = np.lexsort((row, ~known, ids, ~score))[:self.k]  # ~ turns the order round without an overflow; null ids stand last
        self.score[q], self.id[q], self.known[q], self.row[q] = score[by], ids[by], known[by], row[by]


def feasible(unit_query: np.ndarray, t: float, unit: np.ndarray) -> np.ndarray:
    """Which unit vectors can have a cosine of ``t`` or more with the query, by its largest coordinates."""
    stays = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(unit_query))[:FOCUS]:
        q = unit_query[f]
        width = np.sqrt(max(1 - t * t, 0) * max(1 - q * q, 0)) + 1e-7
        if q < t:  # else the axis itself is near enough
            stays &= unit[:, f] <= q * t + width
        if q > -t:
            stays &= unit[:, f] >= q * t - width
    return stays


def search(vectors: Vectors, v: np.ndarray, norms: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray) -> Best:
    """The k best of ``vectors`` for each query that reach ``least``, without the row of the query itself."""
    best = Best(len(v), k, least)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        units = np.nan_to_num(v / norms[:, None])
    for start in range(0, len(vectors.row), BUCKET):
        part = slice(start, min(start + BUCKET, len(vectors.row)))
        longest, kth = vectors.norm[start], best.kth()
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            reach = norms * longest * (1 + _SLACK)
            t = np.where(reach > 0, kth / reach, np.where(kth > 0, np.inf, 0.0))
            t = np.where(np.isfinite(reach), t, 0.0)
        alive = t <= 1
        if not alive.any():
            break
        by_coordinates = alive & (t >= COORDINATES_FROM)
        for q in np.flatnonzero(by_coordinates):
            stays = np.flatnonzero(feasible(units[q], float(t[q]), vectors.unit[part])) + start
            _verify(best, vectors, v, norms, rows, np.array([q]), stays)
        by_length = np.flatnonzero(alive & ~by_coordinates)
        if len(by_length):
            shortest = float(np.min(np.where(norms[by_length] > 0, kth[by_length] / np.maximum(norms[by_length], 1e-300), -np.inf))) * (1 - _SLACK)
            stays = np.arange(start, start + int(np.searchsorted(-vectors.norm[part], -shortest, side="right")) if shortest > 0 else part.stop)
            _verify(best, vectors, v, norms, rows, by_length, stays)
    return best


def _verify(best: Best, vectors: Vectors, v: np.ndarray, norms: np.ndarray, rows: np.ndarray, queries: np.ndarray, at: np.ndarray) -> None:
    if not len(at):
        return
    scores = vectors.products(v[queries], norms[queries], at)
    reached = scores >= best.kth()[queries][:, None]
    for k in np.flatnonzero(reached.any(axis=1)):
        some = np.flatnonzero(reached[k] & (vectors.row[at] != rows[queries[k]]))
        if len(some) > best.k:  # only what can be among the k best goes on: the k-th score and its ties
            least = np.partition(scores[k, some], len(some) - best.k)[len(some) - best.k]
            some = some[scores[k, some] >= least]
        if len(some):
            best.put(int(queries[k]), scores[k, some], vectors, at[some])


def _vectors(batch: pa.RecordBatch, rows: np.ndarray, size: int) -> Vectors:
    ids = batch.column("id")
    known = np.asarray(ids.is_valid())[rows]
    return Vectors(
        ids.fill_null(_LIMIT).to_numpy()[rows], known, batch.column("row").to_numpy()[rows], batch.column("norm").to_numpy()[rows],
        _matrix(batch.column("v"), rows, size),
    )


def _by_dimension(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    return {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}


def _one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def with_thresholds(queries: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Column ``least``: the k-th best score among the seeds; -infinity where there are fewer. ``seeds`` has ``SEEDS`` rows at most."""
    longest = seeds.toArrow().combine_chunks().to_batches()
    sent = queries.sparkSession.sparkContext.broadcast(longest[0] if longest else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {} if sent.value is None else {s: _vectors(sent.value, rows, s) for s, rows in _by_dimension(sent.value).items()}
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            for size, rows in _by_dimension(batch).items():
                for start in range(0, len(rows), QUERIES_AT_ONCE):
                    some = rows[start:start + QUERIES_AT_ONCE]
                    if size in known:
                        own = batch.column("row").to_numpy()[some]
                        least[some] = search(known[size], _matrix(batch.column("v"), some, size), batch.column("norm").to_numpy()[some], own, k, np.full(len(some), -np.inf)).kth()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    return queries.mapInArrow(run, "id long, v array<double>, norm double, row long, least double")


def grouped(vectors: DataFrame) -> DataFrame:
    """Column ``group``: stretches of vectors of about one norm, the longest first, and ``row``, a number of the row.

    Equal norms are told apart by a hash, so that many equal vectors spread over groups.
    """
    n = vectors.count()
    parts = max(-(-n // GROUP), min(shuffle_partitions(vectors), -(-n // BUCKET)), 1)
    ranged = vectors.repartitionByRange(parts, F.col("norm").desc(), F.xxhash64("id", "v"))
    return written(ranged.select("*", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("group")))


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` of the k best candidates of every query.

    ``is_query`` is a condition on ``id``, the id as a long. Components are floor(scale * x). The bounds of the groups are read by the driver:
    two numbers for ``GROUP`` vectors. The queries are sent to all groups that can hold one of their best.
    """
    session = vectors.sparkSession
    base = quantised(vectors, scale, id_col, vector_col)
    rows = grouped(base)
    tops = {r["group"]: r["top"] for r in rows.groupBy("group").agg(F.max("norm").alias("top")).collect()}
    bounds = [tops.get(g, 0.0) for g in range(max(tops, default=-1) + 1)]
    for g in reversed(range(len(bounds) - 1)):  # an empty group never hides a longer one behind it
        bounds[g] = max(bounds[g], bounds[g + 1])
    asked = rows.filter(F.coalesce(is_query, F.lit(False))).select("id", "v", "norm", "row")
    asked = with_thresholds(asked, rows.orderBy(F.desc("norm"), "row").limit(SEEDS).drop("group"), k)
    sent = session.sparkContext.broadcast(np.array(bounds))

    @F.arrow_udf("int")
    def groups_needed(norm: pa.Array, least: pa.Array) -> pa.Array:
        # the bounds fall, so the needed groups are the first ones
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            q, t = norm.to_numpy(zero_copy_only=False), least.to_numpy(zero_copy_only=False)
            shortest = np.where((t > 0) & np.isfinite(q), np.where(q > 0, t / q, np.inf) * (1 - _SLACK), -np.inf)
        return pa.array(np.searchsorted(-sent.value, -shortest, side="right").astype(np.int32))

    met = asked.withColumn("needed", groups_needed("norm", "least")).filter("needed > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("needed") - 1)).alias("group"))
    both = rows.select("id", "v", "norm", "row", F.lit(None).cast("double").alias("least"), "group").unionByName(met.drop("needed"))
    groups = max(len(bounds), 1)
    both = both.repartition(groups, "group").sortWithinPartitions("group", F.col("least").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, known = None, [], None
        for batch in batches:
            of, query = batch.column("group").to_numpy(), np.asarray(batch.column("least").is_valid())
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if of[a] != group:
                    group, held, known = of[a], [], None
                if not query[a]:
                    held.append(part)
                    continue
                if known is None:
                    whole = _one_batch(held) if held else part.slice(0, 0)
                    known, held = {s: _vectors(whole, r, s) for s, r in _by_dimension(whole).items()}, []
                yield from _answers(_one_batch([part]), known, k)

    found = both.mapInArrow(run, "query_row long, query_id long, id long, row long, score long")
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.select("*", F.row_number().over(by).alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _answers(part: pa.RecordBatch, known: dict[int, Vectors], k: int) -> Iterator[pa.RecordBatch]:
    ids, row, norm, least = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row", "norm", "least"))
    for size, rows in _by_dimension(part).items():
        for start in range(0, len(rows) if size in known else 0, QUERIES_AT_ONCE):
            some = rows[start:start + QUERIES_AT_ONCE]
            best = search(known[size], _matrix(part.column("v"), some, size), norm[some], row[some], k, least[some])
            q, r = np.nonzero(best.score > np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[some][q]), pa.array(ids[some][q]), pa.array(best.id[q, r], mask=~best.known[q, r]), pa.array(best.row[q, r]), pa.array(best.score[q, r])],
                names=["query_row", "query_id", "id", "row", "score"],
            )
