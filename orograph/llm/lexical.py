"""Ranked lexical search, term at a time with a limited set of accumulators.

A pass over all texts writes, for every text, its number of terms and the frequencies of the terms
that some query holds; document frequencies and the totals come from this table. A second pass reads
it in shards of ``SHARD`` texts. For each query its terms are taken rarest first. A text gets an
accumulator by a term only as long as the sum of the bounds of that term and of those still to come
(weight times the highest frequency part in the shard) reaches the k-th score so far, the higher one
of the k-th partial score in the shard and of the k-th final score of the shards before it. From then
on only texts that have an accumulator are updated, exactly. A text without one cannot be among the
k best, so the k best of a task are exact; those of all tasks are ranked in two levels.

The weight of a term is floor(1000 * ln((2N + 2) / (2 df + 1))) with N the texts that hold any term;
its part in a text of tf occurrences and n terms is (10^9 tf) div (1000 tf + 12 m) with
m = 75 + (25 n N) div L and L the number of all terms. All sums are 64-bit integers.

The queries are a query set: they are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text,
each of which is one more pass, so memory is bounded for any number of them. A longer query is a block
of its own.

Edge cases: null and empty texts and texts without terms rank nowhere and do not count for N; queries
without terms (or without a text that holds one) have no rows; fewer than k matching texts are all
given; ties go to the smaller id, null ids last, then to an arbitrary but fixed order of rows with one
id; queries with one id are ranked one by one and each gives its rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import id_and_text, list_array, slices
from .shared import written

SHARD, BLOCK_BYTES = 8192, 16 << 20
#: Parts of a query's candidates in the first level of the last ranking.
PARTS = 64
_TERM = bytes(c for c in range(256) if c > 0x7F or bytes([c]).isalnum())
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _TERM else 0x20 for c in range(256))
_NONE = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: letters and digits of ASCII, with A-Z lowered, and all characters beyond ASCII."""
    return text.translate(TABLE).split()


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, object, bytes]]]:
    """The queries as (number, id, text) in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for number, row in enumerate(queries.select(id_col, text_col).toLocalIterator()):
        text = (row[1] or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((number, row[0], text))
        size += len(text)
    if block:
        yield block


@lru_cache(maxsize=2)
def _opened(packed: bytes):
    return pickle.loads(zlib.decompress(packed))


def _sent(df: DataFrame, value: object) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(value)))


def frequencies(docs: DataFrame, vocabulary: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` (terms with repeats), and the ``terms`` of the vocabulary, as numbers, with their frequencies ``tf``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _opened(vocabulary.value)
        for part in slices(batches):
            lengths, sizes, terms, tf = [], [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(text)
                held = [(number[w], c) for w, c in Counter(words).items() if w in number]
                lengths.append(len(words))
                sizes.append(len(held))
                terms += [t for t, _ in held]
                tf += [c for _, c in held]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(lengths, pa.int64()), list_array(np.array(terms, np.int32), np.array(sizes, np.int64), pa.int32()),
                 list_array(np.array(tf, np.int32), np.array(sizes, np.int64), pa.int32())],
                names=["id", "n", "terms", "tf"],
            )

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>")


class Shard:
    """Postings of some texts by term, with their parts of the score."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, texts: int, total: int, vocabulary: int):
        of = np.repeat(np.arange(len(n)), sizes)
        by = np.argsort(terms, kind="stable")
        self.starts = np.searchsorted(terms[by], np.arange(vocabulary + 1))
        self.texts = of[by]
        factor = 25 * texts
        if factor * int(n.max(initial=0)) < 1 << 62:
            m = 75 + factor * n // max(total, 1)
        else:
            m = np.array([75 + factor * int(x) // max(total, 1) for x in n], np.int64)
        tf = tf[by].astype(np.int64)
        self.part = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.texts])

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.texts[a:b], self.part[a:b]


def kth_highest(scores: np.ndarray, k: int) -> int:
    """The k-th highest of the scores above 0, or 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def accumulate(shard: Shard, n_texts: int, query: list[tuple[int, int]], k: int, known: int) -> tuple[np.ndarray, int]:
    """Scores of the texts of a shard, exact for all that can be among the k best, and how many terms made accumulators.

    ``query`` has (term, weight times repeats), rarest first; ``known`` is a score that k texts have already.
    """
    scores = np.zeros(n_texts, np.int64)
    lists = [(weight, *shard.postings(term)) for term, weight in query]
    bounds = [weight * int(part.max(initial=0)) for weight, _, part in lists]
    left, creating, made = sum(bounds), True, 0
    for (weight, texts, part), bound in zip(lists, bounds):
        if not bound:
            continue
        if creating:
            creating = left >= max(known, kth_highest(scores, k), 1)
            made += creating
        if not creating:
            has = scores[texts] > 0
            texts, part = texts[has], part[has]
        scores[texts] += weight * part
        left -= bound
    return scores, made


def _ranked(scores: np.ndarray, order: np.ndarray, k: int, least: int) -> np.ndarray:
    """Indexes of the k highest scores above 0 that reach ``least``, ties by ``order``."""
    some = np.flatnonzero(scores >= max(least, 1))
    if len(some) > k:
        some = some[scores[some] >= kth_highest(scores[some], k)]
    return some[np.lexsort((order[some], -scores[some]))][:k]


def _best(shards: Iterator[pa.RecordBatch], queries: list, texts: int, total: int, vocabulary: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best texts of a task's shards for each query (number, [(term, weight)])."""
    best = {}
    for batch in shards:
        ids, row = batch.column("id"), batch.column("row").to_numpy()
        terms, tf = batch.column("terms"), batch.column("tf")
        sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        shard = Shard(batch.column("n").to_numpy(), terms.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False), sizes, texts, total, vocabulary)
        known = np.asarray(ids.is_valid())
        values = ids.fill_null(_NONE).to_numpy()
        order = np.empty(len(values), np.int64)
        order[np.lexsort((row, ~known, values))] = np.arange(len(values))
        for number, query in queries:
            have = best.get(number)
            least = int(have[0][-1]) if have is not None and len(have[0]) == k else 0
            scores, _ = accumulate(shard, len(values), query, k, least)
            top = _ranked(scores, order, k, least)
            if len(top):
                new = (scores[top], values[top], known[top], row[top])
                if have is not None:
                    new = tuple(np.concatenate(x) for x in zip(have, new))
                    by = np.lexsort((new[3], ~new[2], new[1], -new[0]))[:k]
                    new = tuple(x[by] for x in new)
                best[number] = new
    for number, (score, value, known, row) in best.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(score), number)), pa.array(value, mask=~known), pa.array(row), pa.array(score)], names=["number", "id", "row", "score"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``SHARD`` rows (the last one fewer)."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, SHARD - n))
            batch = batch.slice(SHARD - n)
            n += held[-1].num_rows
            if n == SHARD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str, item_type: str, item_col: str) -> DataFrame:
    session = docs.sparkSession
    asked = [(number, name, Counter(terms_of(text))) for number, name, text in block]
    numbers = {t: i for i, t in enumerate(dict.fromkeys(t for _, _, terms in asked for t in terms))}
    held = written(frequencies(docs, _sent(docs, numbers), id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    sums = held.agg(F.count_if(F.col("n") > 0).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    texts, total = sums["texts"], sums["total"]
    df = {r["term"]: r["df"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * texts + 2) / (2 * f + 1))) for t, f in df.items()}
    queries = [
        (number, sorted(((numbers[t], weight[numbers[t]] * c) for t, c in terms.items() if weight.get(numbers[t])), key=lambda x: (df[x[0]], x[0])))
        for number, _, terms in asked
    ]
    sent, size = _sent(docs, [q for q in queries if q[1]]), len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best(_shards(batches), _opened(sent.value), texts, total, size, k)

    found = held.select(F.col("id").cast("long").alias("id"), "n", "terms", "tf", "row").mapInArrow(run, "number long, id long, row long, score long")
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    part = Window.partitionBy("number", F.pmod(F.shiftright("row", 33), F.lit(PARTS)))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    first = found.withColumn("first", F.row_number().over(part.orderBy(*order))).filter(F.col("first") <= k)
    ranked = first.select("number", "id", "score", rank.alias("rank")).filter(F.col("rank") <= k)
    names = session.createDataFrame([(number, name) for number, name, _ in asked], f"number long, item {item_type}")
    return ranked.join(F.broadcast(names), "number").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col``, ``rank`` (from 1), ``id_col`` (a long) and ``score`` of the k best texts for every item."""
    item_type = items.schema[item_col].dataType.simpleString()
    out = None
    for block in query_blocks(items, item_col, item_text_col):
        found = _search_block(docs, block, k, id_col, text_col, item_type, item_col)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` long, score long")
