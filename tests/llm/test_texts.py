"""Personal data, licenses, fingerprints and decontamination against plain loops, on odd rows too."""

import collections
import hashlib
import random
import re

import pytest

from orograph.llm import decontamination, fingerprints, licenses, pii
from tests.llm import brute_fingerprints, brute_pii
from tests.llm.conftest import ODD

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def made(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def words(text):
    return re.findall(WORD, (text or "").translate(UPPER))


@pytest.fixture(scope="module")
def personal():
    rng = random.Random(3)
    parts = list("a1b2. @-+%()_é😀 0 4") + ["4111 1111 1111 1111", "a@b.c", "+1 (555) 123-4567", "1.2.3.4", "300.1.1.1", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "﻿"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["1.2.3.4 " * 1000, "a.b@c.d_e@f.g " * 500, "a@" + "b." * 5000 + "c", "7" * 20_000]


def test_personal_data_equals_plain_loops_and_is_redacted(spark, personal):
    df = made(spark, personal).selectExpr("*", "length(text) AS n_chars", "'kept' AS spans")
    rows = {r.doc_id: r for r in pii.summary(pii.find_spans(df)).collect()}
    redacted = {r.doc_id: r for r in pii.redact(df).collect()}
    for i, text in enumerate(personal):
        r = rows[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute_pii.row(text)
        out, at = "", 0
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            if int(a) >= at:
                out += text[at:int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert redacted[i].text == out + text[at:] and redacted[i].n_chars == len(redacted[i].text) and redacted[i].spans == "kept"
    assert any("iban" in r.spans for r in rows.values())


def test_words_near_a_span_raise_its_score(spark):
    rows = pii.find_spans(made(spark, ["call +1 555 123 4567", "xxxx +1 555 123 4567"])).orderBy("doc_id").collect()
    assert [round(r.spans[0].score, 2) for r in rows] == [0.8, 0.7]


def test_personal_data_of_odd_rows(spark, odd, nothing):
    rows = [r for r in pii.summary(pii.find_spans(odd)).collect() if r.doc_id is not None]
    assert len(rows) == len(ODD) + 1
    for r in rows:
        if len(ODD[r.doc_id] or "") < 10_000:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute_pii.row(ODD[r.doc_id])
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).filter("text IS NULL").count() == 1
    assert pii.summary(pii.find_spans(nothing)).count() == 0 and pii.redact(nothing).count() == 0


def licensed(text):
    w, found = words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_licenses_equal_plain_loops(spark, odd, nothing):
    rng = random.Random(4)
    parts = "gnu general public license apache MIT License cc-by é. \x00 x İ K".split() + ["..", "gnu general public license", licenses.TEXTS["bsd"], "-", "Apache/License"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "-", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["mit license " * 2000]
    rows = licenses.summary(made(spark, texts)).collect() + [r for r in licenses.summary(odd).collect() if r.doc_id is not None]
    assert len(rows) == len(texts) + len(ODD) + 1
    for k, r in enumerate(rows):
        text = texts[r.doc_id] if k < len(texts) else ODD[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licensed(text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.summary(nothing).count() == 0


def verified(text):
    """Labels and score by loops: hits of pairs, their diagonals, stretches of diagonals, the longest chain of each."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    pairs, labels, score = list(zip(words, words[1:])), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        known = phrase.split()
        if any(words[i:i + len(known)] == known for i in range(len(words))):
            labels.add(label)
            score = 1.0
    for label, template in licenses.TEXTS.items():
        known = list(zip(template.split(), template.split()[1:]))
        diagonals = collections.defaultdict(list)
        for p, pair in enumerate(pairs):
            for at, other in enumerate(known):
                if pair == other:
                    diagonals[p - at].append(p)
        stretches, reach = [], None
        ordered = sorted((ps[0], d, ps[-1] + 2) for d, ps in diagonals.items())
        for k, (first, d, last) in enumerate(ordered):
            if k == 0 or abs(d - ordered[k - 1][1]) > licenses.SHIFT or first > reach + licenses.GAP:
                stretches.append([])
            stretches[-1].append(d)
            reach = max(last, reach or 0)
        for stretch in stretches:
            hits = sorted((p, p - d) for d in stretch for p in diagonals[d])
            best = {}
            for p, at in hits:
                best[p, at] = 1 + max((n for (q, other), n in best.items() if q < p and other < at), default=0)
            share = max(best.values()) / len(known)
            if share >= licenses.MIN_SHARE:
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_and_scores_equal_plain_loops_and_repeats_are_no_license(spark):
    rng = random.Random(21)
    repeats = ["permission is " * 12, "and or " * 20, "source code form " * 3 + "of the software " * 10, "the license " * 40, "you may not " * 30 + "of the " * 30]
    texts = list(repeats)
    for template in licenses.TEXTS.values():
        words = template.split()
        for share in (0.0, 0.1, 0.3, 0.6):
            texts.append("so " + " ".join(w for w in words if rng.random() >= share for w in ([w, "extra"] if rng.random() < share / 3 else [w])) + " end")
        texts.append(" ".join(rng.sample(words, len(words))))
        texts.append(" ".join(words[:len(words) // 2] + ["x"] * 20 + words[len(words) // 2:]))
        texts.append(" ".join(words + words[3:] + words))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.summary(made(spark, texts)).collect()}
    for i, text in enumerate(texts):
        labels, score = verified(text)
        assert got[i] == (labels, round(score, 9)), text[:80]
    assert all(got[i] == ("", 0.0) for i in range(len(repeats)))
    assert sum(labels != "" for labels, _ in got.values()) > 20


def test_other_templates_can_be_scanned(spark):
    known = licenses.templates(spark, {}, {"own": "all rights of this house stay with its owner and nobody else"})
    rows = licenses.scan(made(spark, ["x all rights of this old house stay with its owner and nobody else y", "mit license"]), known=known).collect()
    assert [(r.label, r.first) for r in rows] == [("own", 1)]


def test_license_texts_with_changes_are_one_verified_span(spark):
    text = "Intro. " + licenses.TEXTS["mit"].replace("free of charge", "without any charge at all").upper() + " the end"
    rows = licenses.scan(made(spark, [text, "permission is hereby given"])).collect()
    assert [(r.doc_id, r.label) for r in rows] == [(0, "mit")] and rows[0]["first"] == 1 and 0.5 < rows[0].share < 1


def test_fingerprints_equal_plain_loops(spark):
    rng = random.Random(6)
    vocabulary = ["one", "two", "three", "é", "longer-word-here", "x" * 20, "😀", "of"]
    docs = [(rng.randint(-10 ** 6, 10 ** 6) * 3 + k % 3, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 50, 400])))) for k in range(150)]
    docs = list({i: (i, t) for i, t in docs}.values()) + [(10 ** 15, None), (10 ** 15 + 1, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, fingerprints.edit_report(df).collect())) == brute_fingerprints.report(docs)
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprints.edit_report(one).collect()] == brute_fingerprints.report([(7, "a b c d e f")])


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    rows = fingerprints.edit_report(odd).collect()
    assert len(rows) == len(ODD) + 2 and all(r.edited_sha256 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_text = {}
    for r in rows:
        if r.doc_id is not None:
            assert by_text.setdefault(ODD[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert fingerprints.edit_report(nothing).count() == 0
    assert fingerprints.fingerprints(odd).count() == len(rows)


def hits(text, items, n):
    w, marked, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for k in range(max(1, len(v) - n + 1) if v else 0):
            window = v[k:k + n]
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    marked.update(range(i, i + len(window)))
                    names.add(str(name))
    return len(w), len(marked), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(marked)


def test_decontamination_equals_plain_loops(spark, odd, nothing, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["a", "B", "c", "é", "dd", "ab"]
    line = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(k, line(rng.choice([1, 3, 4, 5, 9]))) for k in range(12)] + [(20, None), (21, "..."), (22, "a b"), (23, "A, b")]
    texts = [line(rng.randint(0, 30)) for _ in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontamination.BLOCK_BYTES, 20):  # one block, and many
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", most)
        found = decontamination.find_windows(made(spark, texts), bench, words=4)
        for r in decontamination.summary(found).collect():
            assert tuple(r)[1:] == hits(texts[r.doc_id], items, 4)
    for r in found.collect():
        text = texts[r.doc_id]
        assert ["".join(words(text[s.start:s.end])) for s in r.char_spans] == ["".join(words(text)[s.start:s.end]) for s in r.word_spans]
    for r in decontamination.summary(decontamination.find_windows(odd, bench, words=4)).collect():
        if r.doc_id is not None:
            assert tuple(r)[1:] == hits(ODD[r.doc_id], items, 4)
    none = decontamination.summary(decontamination.find_windows(odd, bench.limit(0))).collect()
    assert len(none) == len(ODD) + 2 and not any(r.contaminated for r in none)
    assert decontamination.find_windows(nothing, bench).count() == 0
