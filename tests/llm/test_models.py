"""Classifiers: their parts against plain loops, held-out accuracy, and odd rows."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from orograph.llm import language, quality
from orograph.llm.queries import QUERIES, remainder
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_features_equal_plain_loops_and_do_not_depend_on_the_batch():
    texts = ["Aa bb bb bb cc!\nAa bb\nAa bb\n", "x", "", "one two three one two three $$ ## 12", "É é"]
    x = quality.features(pa.array(texts))
    for text, row in zip(texts, x):
        assert np.allclose(row, quality.features(pa.array([text]))[0])
        w, lines = text.split(), [s for s in text.split("\n") if s]
        triples = list(zip(w, w[1:], w[2:]))
        want = {
            "distinct_words": len(set(w)) / max(1, len(w)), "commonest_word": max(collections.Counter(w).values(), default=0) / max(1, len(w)),
            "same_as_before": sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w)), "distinct_triples": len(set(triples)) / max(1, len(w) - 2),
            "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0, "log_chars": np.log1p(len(text)),
        }
        got = dict(zip(quality.FEATURES, row))
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (text, got, want)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) != (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert {2, 5} in [set(p) for p in model.pairs] and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_quality_on_held_out_documents(spark):
    rows = QUERIES["op3_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rows.join(labels, "doc_id").filter("held_out").selectExpr("count(*) AS n", "avg(CAST(predicted = quality AS INT)) AS right").first()
    assert got.n > 50 and got.right > 0.97
    assert rows.count() == 1000 and rows.filter("score < 0 OR score > 1").count() == 0


def test_labels_of_held_out_documents_are_not_learned(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    got = spark.range(200).select("id").withColumnRenamed("id", "doc_id").filter(remainder(4) == 2).collect()
    assert [r.doc_id for r in got] == held


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    unlabelled = quality.train(odd, labels.limit(0))
    assert all(r.score > 0.7 for r in quality.score(odd, unlabelled).collect())
    assert quality.score(nothing, model).count() == 0
    assert odd.filter(quality.score_column(odd["text"], unlabelled) >= 0.7).count() == odd.count()


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op9_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = rows.join(docs, "doc_id").filter("held_out").selectExpr("count(*) AS n", "avg(CAST(lang = lang_pred AS INT)) AS right", "avg(score) AS score").first()
    assert got.n > 100 and got.right > 0.97 and abs(got.score - got.right) < 0.05


def test_document_frequencies_equal_plain_counts(spark):
    texts = ["abc", "abd", None, "", "ABC"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    want = np.zeros(language.SIZE + 1, int)
    for t in texts:
        want[language.counts(t or "")[0]] += 1
        want[language.SIZE] += 1
    assert (language.document_frequencies(df) == want).all()


def test_language_of_odd_rows(spark, odd, nothing):
    docs = odd.selectExpr("*", "CASE WHEN doc_id % 3 = 0 THEN 'aa' WHEN doc_id % 3 = 1 THEN 'bb' END AS lang")
    model = language.train(docs)
    assert model.languages == ["aa", "bb"]
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in ODD[r.doc_id] or "")) and 0 <= r.score <= 1
    unknown = language.train(nothing)
    assert {r.lang_pred for r in language.predict(docs, unknown).collect()} == {"und"}


def test_ngrams_stay_within_their_text():
    orders, offsets = language.ngrams(["ab", "cd"])
    alone, _ = language.ngrams(["ab"])
    assert all((a[:offsets[1]] == b).all() for a, b in zip(orders, alone))


@pytest.mark.parametrize("name", ["op3_quality_classifier", "op9_language_id"])
def test_scores_are_the_same_however_rows_are_dealt(spark, name, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(7).write.parquet(str(tmp_path / f"{t}.parquet"))
    a, b = ({r.doc_id: round(r.score, 9) for r in QUERIES[name](spark, p).collect()} for p in (SF, str(tmp_path)))
    assert a == b


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)))
    monkeypatch.setattr(language, "fit", lambda samples, languages, idf: seen.append(len(samples)))
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('some text ', id) AS text", "'en' AS lang")
    same = spark.range(3000).selectExpr("8L AS doc_id", "'always the same' AS text", "'fr' AS lang")
    both = docs.union(same)
    quality.train(both, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int"), bound=200)
    language.train(both, bound=200)
    assert 0 < seen[0] <= 400 and 50 < seen[1] <= 400
