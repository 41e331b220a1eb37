"""Ranked lexical search against plain loops; the SQL of the query is compared in test_groups."""

import collections
import math
import random
import re

import numpy as np
import pytest

from orograph.llm import lexical
from tests.llm.conftest import ODD

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})


def terms(text):
    return [t.translate(LOWER) for t in re.findall(TERM, text or "")]


def plain(docs, items, k=20):
    """(item id, rank, doc id, score); rows of one id are told apart by nothing."""
    held = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    texts, total = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 75 + 25 * n * texts // total
                    score += math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS id", "2 AS n", "3 AS terms", "4 AS row", "5 AS score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS number", "2 AS rank")
    return sorted(map(tuple, lexical.search(d, q, k).collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 60, 400])))) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(200)]  # ties
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30])))) for i in range(25)]
    return docs, items + [(30, docs[7][1]), (31, "w1 w1 W1, w2"), (32, None), (33, "unknown"), (34, "..."), (5, "w3 w9"), (None, "w5 w90")]


@pytest.mark.parametrize("shard, k, block", [(8192, 20, 1 << 24), (50, 3, 300), (64, 20, 1)])
def test_equals_plain_loops(spark, texts, monkeypatch, shard, k, block):
    docs, items = texts
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    if block < 1000:
        items = items[:6] + items[-6:]
    blocks = lexical.query_blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert (len(list(blocks)) > 1) == (block < 1000)
    assert found(spark, docs, items, k) == plain(docs, items, k)


def test_shards_of_any_size_give_the_same_and_fewer_accumulators(texts):
    docs, items = texts
    held = [collections.Counter(terms(t)) for _, t in docs]
    numbers = {t: i for i, t in enumerate(sorted({t for c in held for t in c}))}
    n = np.array([sum(c.values()) for c in held])
    flat = [(numbers[t], f) for c in held for t, f in c.items()]
    shard = lexical.Shard(n, np.array([t for t, _ in flat]), np.array([f for _, f in flat]), np.array([len(c) for c in held]), len(docs), int(n.sum()), len(numbers))
    df = collections.Counter(t for c in held for t in c)
    limited = 0
    for _, text in items[:25]:
        query = sorted((df[t], numbers[t], 1000 * math.log(2 * len(docs) / (2 * df[t] + 1)) // 1 * c) for t, c in collections.Counter(terms(text)).items() if t in df)
        query = [(t, int(w)) for _, t, w in query]
        full, _ = lexical.accumulate(shard, len(docs), query, len(docs) + 1, 0)
        some, made = lexical.accumulate(shard, len(docs), query, 20, 0)
        limited += made < len(query)
        least = lexical.kth_highest(full, 20)
        assert (some[full >= max(least, 1)] == full[full >= max(least, 1)]).all() and ((some == 0) | (some == full) | (full < least)).all()
    assert limited > 3


def test_odd_rows(spark, odd, nothing):
    cases = list(enumerate(ODD)) + [(None, "no id word"), (4, "word"), (None, "word")]
    items = [(1, "word same TEXT mit é"), (2, "ab x a 9"), (3, None), (4, "nul"), (5, "K İ ﻿mark ��")]
    assert found(spark, cases, items) == plain(cases, items)
    assert found(spark, cases, []) == []
    assert lexical.search(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.search(odd, spark.createDataFrame(items, "item_id long, text string")).count() > 3
