"""Periodic runs of words, found by uniting suffix classes in the order of falling LCP.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of
``least`` words and ``times`` periods at least. All suffixes of a text are sorted by doubling their
sorted prefixes (for many texts at once); the ranks of each doubling also give the longest common
prefix (LCP) of neighbours in that order. As in Kruskal's algorithm, the neighbours are taken by
falling LCP and their classes united (union-find, the smaller class into the larger one); a class
keeps its places in order. Where a union makes two places i < j neighbours in their class and
j - i <= LCP / (times - 1), the words from i to j + LCP have the period j - i. It is the smallest one,
since a smaller one would have put another place between them before; it cannot be extended to the
right; and of all seeds of a run just one cannot be extended to the left. So each run comes up once.

Only texts in which some stretch of as many words as the smallest possible LCP occurs twice are
sorted; hashes of these stretches can name a text too many, never one too few.

Edge cases: a null or empty text, or one of white space only, has no words and no run, and collapses
to an empty text; equal rows give equal rows; null ids stay; extra columns are ignored. A text is worked
on whole by one task, in memory of about 4 * log2(longest repeat) bytes a word beside the text itself.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import id_and_text, slices
from .hashing import mix, runs

LEAST, TIMES = 6, 4


class Numbers(dict):
    """Numbers of words by their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def shortest_prefix(least: int, times: int) -> int:
    """The smallest LCP that a pair of places one period apart can have in a run."""
    return min(max(least - q, (times - 1) * q) for q in range(1, max(least, 1) + 1))


def may_repeat(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each text (``counts`` words each), whether it may hold some ``n`` words in a row twice."""
    ends = np.cumsum(counts)
    text_of = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    first = ends - counts
    at = np.arange(len(text_of)) - np.repeat(np.cumsum(np.maximum(counts - n + 1, 0)) - np.maximum(counts - n + 1, 0), np.maximum(counts - n + 1, 0)) + first[text_of]
    out = np.zeros(len(counts), bool)
    if len(at):
        keys = mix(runs(words.astype(np.uint64), n)[at] + text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        bits = max(int(len(keys)).bit_length() + 3, 8)
        place = (keys >> np.uint64(64 - bits)).astype(np.int64)
        met = np.flatnonzero(np.bincount(place, minlength=1 << bits)[place] > 1)
        order = met[np.argsort(keys[met])]
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        out[text_of[order[same]]] = True
    return out


def sorted_suffixes(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of all suffixes in order (of their text first), and the ranks by their first 1, 2, 4, ... words.

    Every text ends with a word that occurs nowhere else, so no common prefix reaches into the next text.
    """
    n = len(words)
    key = text_of * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    slots, rank, ranks, h = np.arange(n), np.zeros(n, np.int64), [], 0
    while len(slots):
        at = order[slots]
        if h:
            key = rank[at] * (n + 1) + rank[np.minimum(at + h, n - 1)]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[slots] = at
        else:
            key = key[at]
        first = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        ranks.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        slots = slots[~(first & np.append(first[1:], True))]
        h = 2 * h or 1
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes r of the order whose suffix shares ``least`` words or more with the one before it, and how many."""
    level = min(len(ranks) - 1, max(least, 1).bit_length() - 1)
    at = np.flatnonzero(ranks[level][order[1:]] == ranks[level][order[:-1]]) + 1
    a, b = order[at - 1].copy(), order[at].copy()
    n, common = len(order), np.zeros(len(at), np.int64)
    for k in reversed(range(len(ranks))):
        inside = (a < n) & (b < n)
        same = inside & (ranks[k][np.where(inside, a, 0)] == ranks[k][np.where(inside, b, 0)])
        step = same.astype(np.int64) << k
        a, b, common = a + step, b + step, common + step
    long = common >= least
    return at[long], common[long]


def united(order: np.ndarray, at: np.ndarray, common: np.ndarray, times: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, LCP) of places that become neighbours in a class and lie within LCP / (times - 1)."""
    by = np.argsort(-common, kind="stable")
    edges = at[by]
    parent = {r: r for r in np.unique(np.concatenate([edges - 1, edges])).tolist()}
    members = {r: [place] for r, place in zip(parent, order[list(parent)].tolist())} if parent else {}

    def find(r: int) -> int:
        while (up := parent[r]) != r:
            parent[r] = r = parent[up]
        return r

    for r, shared in zip(edges.tolist(), common[by].tolist()):
        a, b = find(r - 1), find(r)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        parent[b] = a
        larger, smaller, reach = members[a], members.pop(b), shared // (times - 1)
        last, before = len(smaller) - 1, -1
        for k, place in enumerate(smaller):
            p = bisect_left(larger, place)
            if p and before < larger[p - 1] and place - larger[p - 1] <= reach:
                yield larger[p - 1], place, shared
            if p < len(larger) and larger[p] - place <= reach and (k == last or smaller[k + 1] > larger[p]):
                yield place, larger[p], shared
            before = place
        if len(smaller) << 4 < len(larger):
            for place in smaller:
                insort(larger, place)
        else:
            larger += smaller
            larger.sort()  # two ordered stretches: linear


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of texts by index, in order; ``words`` are the words of all texts as numbers."""
    shortest = shortest_prefix(least, times)
    chosen = np.flatnonzero(may_repeat(words, counts, shortest))
    if not len(chosen):
        return {}
    firsts, top = np.cumsum(counts) - counts, int(words.max()) + 1
    lengths = counts[chosen] + 1
    some = np.full(int(lengths.sum()), -1, np.int64)
    starts = np.cumsum(lengths) - lengths
    for k, text in enumerate(chosen.tolist()):
        some[starts[k]:starts[k] + lengths[k] - 1] = words[firsts[text]:firsts[text] + counts[text]]
    some[starts + lengths - 1] = top + np.arange(len(chosen))
    order, ranks = sorted_suffixes(some, np.repeat(np.arange(len(chosen)), lengths))
    at, common = common_prefixes(order, ranks, shortest)
    seeds = [(i, j - i, shared) for i, j, shared in united(order, at, common, times) if shared + j - i >= least and (i == 0 or some[i - 1] != some[j - 1])]
    if not seeds:
        return {}
    i, period, shared = np.array(seeds, np.int64).T
    of = np.searchsorted(starts, i, side="right") - 1
    out: dict[int, list[tuple[int, int, int]]] = {}
    for text, *run in sorted(zip(chosen[of].tolist(), (i - starts[of]).tolist(), (shared + period).tolist(), period.tolist()), key=lambda s: (s[0], s[1], s[3])):
        out.setdefault(text, []).append(tuple(run))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one blank, without those that some run holds behind its first period."""
    kept, done = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if b > done:
            kept += words[done:max(a, done)]
            done = b
    return b" ".join(kept + words[done:])


_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_words``, ``runs array<struct<start,length,period>>`` by start and period, and the ``collapsed`` text.

    ``times`` is 2 or more. Words are the longest stretches without ASCII white space, numbered from 0.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and a word at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.split() for t in part.column("text").cast(pa.binary()).to_pylist()]
            counts = np.array([len(t) for t in texts], np.int64)
            words = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
            found = runs_of(words, counts, least, times)
            flat = np.array([r for k in sorted(found) for r in found[k]], np.int64).reshape(-1, 3)
            offsets = np.append(0, np.cumsum([len(found.get(k, ())) for k in range(len(texts))])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(_RUNS)))
            text = pa.array([collapsed(t, found[k]) if k in found else b" ".join(t) for k, t in enumerate(texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), lists, text], names=[id_col, "n_words", "runs", "collapsed"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col``, where every tenth text (by the checksum h of its id) gets a periodic tail.

    With g = h div 10 and n words, each word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) div (3 + g % 8); such a text has its words joined by one blank. A null id is left alone.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def word(i: Column) -> Column:
            return F.get(words, F.when(i < a, i.cast("long")).otherwise(a + (i - a) % p).cast("int"))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rewritten = F.get(F.transform(F.array(words), tail), F.lit(0))  # in an array, so that the words are split once
    return docs.select(F.col(id_col), F.when(F.col(text_col).isNotNull() & (h % 10 == 0), rewritten).otherwise(F.col(text_col)).alias(text_col))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period; nulls if none) and digests of all runs and of the collapsed text."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.select(F.col(id_col).alias("id"), "runs", "collapsed", F.array_max(order).alias("top"), text.alias("lines"))
    return rows.select(
        F.col("id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.small")).alias("period"), F.floor(1000 * F.col("top.length") / -F.col("top.small")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
