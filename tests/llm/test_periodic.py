"""Periodic runs against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from orograph.llm import periodic
from orograph.llm.queries import QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """All runs by trying every period: stretches of equal words q apart, without those that a smaller period has too."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    dropped = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def found(texts, least=6, times=4):
    counts = np.array([len(t) for t in texts], np.int64)
    numbers = periodic.Numbers()
    words = np.array([numbers[w] for t in texts for w in t], np.int64)
    got = periodic.runs_of(words, counts, least, times)
    return [got.get(k, []) for k in range(len(texts))]


@pytest.mark.parametrize("least, times", [(6, 4), (1, 2), (9, 3), (4, 2)])
def test_runs_equal_plain_loops(least, times):
    rng = random.Random(7)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 40))] for _ in range(150)]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("abcde") for _ in range(rng.randint(1, 7))]
            parts += (unit * rng.randint(1, 9))[:rng.randint(1, 60)]
        texts.append(parts)
    texts += [list("a" * 300), list("ab" * 100), list("aab" * 40 + "aaab" * 30), []]
    texts += [texts[5]] * 3
    for text, got in zip(texts, found(texts, least, times)):
        assert got == plain_runs(text, least, times)


def test_nested_and_touching_runs():
    words = list("aaaaaab" * 5 + "x" * 7 + "xy" * 6)
    got = found([words])[0]
    assert got == plain_runs(words) and len(got) >= 7
    assert periodic.collapsed([w.encode() for w in words], got).decode() == plain_collapsed(words, got)


def test_a_very_long_text_is_done_whole():
    words = [f"w{i}" for i in range(1000)] * 5 + ["a"] * 100_000 + ["b"] + ["a"] * 50_000
    assert found([words])[0] == [(0, 5000, 1000), (5000, 100_000, 1), (105_001, 50_000, 1)]


def with_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = words if doc_id is None else with_tail(doc_id, words)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_collapsed(words, runs))]
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, *digests)


def test_the_query_equals_plain_loops(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r[1] for r in got.values()) > 10
    for i, text in docs:
        if len((text or "").split()) < 600:
            assert got[i] == expected(i, text)


def test_odd_rows(spark, odd, nothing):
    cases = [t if t is None or len(t) < 10_000 else t[:300] for t in ODD] + ["go " * 30, "\t\x0b"]
    df = spark.createDataFrame(list(enumerate(cases)) + [(None, "go " * 30)], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS runs", "3 AS collapsed", "4 AS n_words")
    rows = periodic.summary(periodic.find_runs(periodic.with_periodic_tails(df))).collect()
    want = [expected(i, t) for i, t in enumerate(cases)] + [expected(None, "go " * 30)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert periodic.find_runs(odd).count() == len(ODD) + 2
    assert [r.length for r in periodic.summary(periodic.find_runs(odd.filter("doc_id = 9"))).collect()] == [20_000]
    assert periodic.summary(periodic.find_runs(nothing)).count() == 0
