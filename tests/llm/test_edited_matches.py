"""Fingerprints of edited texts: first anchors in common are not searched, and digests read few anchors; against plain loops."""

import random

from pyspark.sql import functions as F

from orograph.llm import fingerprints
from tests.llm import brute_passages
from tests.llm.test_passages import words


def texts():
    """Documents in order of their ids: repeated lines, copies, halves of the one before, and texts without anything in common."""
    rng = random.Random(11)
    lines = [words(rng, 5) + "\n" for _ in range(6)]
    out = ["".join(rng.choice(lines) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(50)]
    out += [words(rng, n) for n in (1, 3, 40, 400)] + ["ab" * 200, "ab" * 90, "", " ", "x" * 300, "x" * 300]
    for text in out[20:30]:
        out += [text, text[len(text) // 2:] + words(rng, 20), words(rng, 9) + text[:len(text) // 3]]
    return out


def report(spark):
    docs = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts(), texts()[1:] + texts()[:1])]
    return edited, sorted(fingerprints.passage_report(df).collect(), key=lambda r: r.doc_id)


def test_reports_equal_plain_loops_where_texts_repeat_themselves(spark):
    edited, rows = report(spark)
    for r, text, other, follows in zip(rows, texts(), edited, texts()[1:] + texts()[:1]):
        a, b, c = (brute_passages.anchors(t) for t in (text, other, follows))
        assert (r.n_anchors, r.matched_edited, r.matched_next) == (len(a), brute_passages.matched(a, b), brute_passages.matched(a, c))
        assert (r.near_edited, r.near_next) == (brute_passages.like(text, other), brute_passages.like(text, follows))
        for passage, x in ((r.matched_edited_passage, b), (r.matched_next_passage, c)):
            if passage is not None:
                at, other_at = ([code for code, place in side if place >= first][:1] for side, first in ((a, passage.at), (x, passage.other_at)))
                assert at == other_at and 0 < passage.anchors <= min(len(a), len(x))


def test_digests_are_the_smallest_hashes(spark):
    edited, rows = report(spark)
    for r, text, other in zip(rows, texts(), edited):
        for got, t in ((r.fingerprint, text), (r.edited_fingerprint, other)):
            codes = sorted({code % (1 << 32) for code, _ in brute_passages.anchors(t)})[:fingerprints.SIZE]
            assert got == "".join(f"{c:08x}" for c in codes)


def test_first_anchors_in_common_are_not_searched(spark):
    edited, _ = report(spark)
    pairs = [(k, a, b) for k, (a, b) in enumerate(zip(texts(), edited))]
    df = spark.createDataFrame(pairs, "k long, a string, b string").repartition(2)
    df = fingerprints.with_character_anchors(fingerprints.with_character_anchors(df, "a", "x"), "b", "y")
    same = F.size(F.filter("x", lambda c: F.array_contains("y", c) & (c.bitwiseAND(F.lit(0xFFFFFFFF)) + 24 <= F.length("a") / 2)))
    df = fingerprints.with_matches(df.withColumn("same", same), "x", "y", "whole")
    rows = fingerprints.with_matches(df, "x", "y", "n", "same").collect()
    assert all(r.n == r.whole and (r.n_passage and r.n_passage.anchors) == (r.whole_passage and r.whole_passage.anchors) for r in rows)
    assert sum(r.same > 0 for r in rows) > 40
    # What both have first alike is taken as given, so it is not among the pairs that are searched.
    given = df.withColumns({"same": F.lit(2), "x": F.expr("array(1L, 2L)"), "y": F.expr("array(1L, 2L)")}).drop("whole", "whole_passage")
    assert {r.n for r in fingerprints.with_matches(given, "x", "y", "n", "same").collect()} == {2}
