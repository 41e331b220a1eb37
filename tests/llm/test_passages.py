"""Fingerprints by characters: anchors in plain loops, edits in unspaced runs and short texts, passages of long texts."""

import hashlib
import random
import string

from orograph.llm import fingerprints
from orograph.llm.queries import QUERIES
from tests.llm import brute_passages
from tests.llm.conftest import ODD


def likenesses(spark, pairs):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string").repartition(2)
    rows = fingerprints.with_character_anchors(fingerprints.with_character_anchors(rows, "a", "x"), "b", "y")
    rows = fingerprints.with_matches(rows, "x", "y", "n").withColumn("near", fingerprints.dice(fingerprints.F.col("n"), fingerprints.F.col("x"), fingerprints.F.col("y")))
    return sorted(rows.collect(), key=lambda r: r.k)


def words(rng, n):
    return " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_character_anchors_equal_plain_loops(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é😀漢x") for _ in range(n)) for n in (1, 11, 12, 13, 40, 300, 4107, 4108, 9000)] + [t for t in ODD if t is None or len(t) < 5000]
    for r, text in zip(likenesses(spark, [(t, t) for t in texts]), texts):
        assert [((c >> 32), c & 0x7FFFFFFF) for c in r.x] == brute_passages.anchors(text) and r.near == 1.0


def test_a_character_put_into_an_unspaced_run_changes_little(spark):
    rng = random.Random(2)
    runs = ["".join(rng.choice(letters) for _ in range(4000)) for letters in (string.ascii_letters + string.digits, "".join(map(chr, range(0x4E00, 0x5200))))]
    pairs = [(r, "x" + r) for r in runs] + [(r, r[:2000] + "x" + r[2000:]) for r in runs]
    assert all(r.near > 0.97 for r in likenesses(spark, pairs))


def test_one_changed_character_in_five_words_leaves_likeness(spark):
    rng, pairs = random.Random(3), []
    for _ in range(200):
        text = words(rng, 5)
        at = rng.randrange(len(text))
        pairs.append((text, text[:at] + "#" + text[at + 1:]))
    near = [r.near for r in likenesses(spark, pairs)]
    assert sum(x == 0 for x in near) < 40 and sum(near) / len(near) > 0.3


def test_a_passage_of_very_long_texts_is_found_with_its_place(spark):
    rng = random.Random(4)
    shared = words(rng, 300)
    pairs, places = [], []
    for _ in range(6):
        a, b = words(rng, 5000), words(rng, 2500)
        pairs.append((f"{a} {shared} {words(rng, 5000)}", f"{b} {shared} {words(rng, 2500)}"))
        places.append((len(a) + 1, len(b) + 1))
    for r, (at, other) in zip(likenesses(spark, pairs), places):
        assert r.near > 0.03 and r.n_passage.anchors > 300
        assert abs(r.n_passage.at - at) < 40 and r.n_passage.at - at == r.n_passage.other_at - other


def test_anchors_out_of_order_do_not_match(spark):
    rng = random.Random(5)
    a, b = words(rng, 200), words(rng, 200)
    row = likenesses(spark, [(a + b, b + a)])[0]
    assert 0.4 < row.near < 0.6


def test_matches_equal_plain_loops(spark):
    rng = random.Random(6)
    lines, pairs = [words(rng, 6) + "\n" for _ in range(8)], []
    for _ in range(60):
        mixed = [[rng.choice(lines) for _ in range(rng.choice([0, 1, 3, 12, 40]))] for _ in range(2)]
        if rng.random() < 0.5:
            mixed[1] = [x for x in mixed[0] if rng.random() < 0.8]
        pairs.append(tuple("".join(m) for m in mixed))
    pairs += [("x" * 500, "x" * 300), (None, "abc"), ("abc", "abc"), (None, " ")]
    for r, (a, b) in zip(likenesses(spark, pairs), pairs):
        assert r.n == brute_passages.matched(brute_passages.anchors(a), brute_passages.anchors(b)) and r.near == brute_passages.like(a, b)


def test_anchors_of_edited_texts_equal_those_read_directly(spark):
    rng = random.Random(8)
    some = [" ", " " * 40, "\n", "", "a", "ab cd", "x" * 30, "é漢 b" * 9, words(rng, 30), words(rng, 200), " " * 20 + words(rng, 6), words(rng, 4) + " " * 30, words(rng, 900), "漢" * 5000]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in some for b in some)]
    df = spark.createDataFrame(rows, "k int, text string, next_text string").repartition(4)
    df = fingerprints.with_character_anchors(fingerprints.with_character_anchors(df, "text", "codes"), "next_text", "next_codes")
    half = fingerprints.F.expr("CAST(floor(length(text) / 2) AS INT)")
    df = df.select("*", half.alias("half")).selectExpr("*", "concat(substring(text, 1, length(text) - half), substring(next_text, 1, half)) AS edited")
    df = fingerprints.edited_anchors(df, fingerprints.F.expr("length(text) - half"), fingerprints.F.expr("least(half, length(next_text))"), "quick")
    bad = [(r.text[:40], r.next_text[:40]) for r in fingerprints.with_character_anchors(df, "edited", "direct").collect() if r.quick != r.direct]
    assert not bad


def test_the_query_gives_these_likenesses(spark, odd, nothing):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, sf).collect()}
    for k, (i, text) in enumerate(docs):
        if k % 10 == 0 and len(text) < 5000:
            follows, half = docs[(k + 1) % len(docs)][1], len(text) // 2
            edited = text[:len(text) - half] + follows[:half]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].near_edited == brute_passages.like(text, edited)
            if len(follows) < 5000:
                assert got[i].near_next == brute_passages.like(text, follows)
    assert fingerprints.passage_report(odd).count() == len(ODD) + 2 and fingerprints.passage_report(nothing).count() == 0
