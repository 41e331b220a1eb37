"""Account numbers followed by other words in capitals."""

import pytest

from orograph.llm import pii

ACCOUNTS = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB29NWBK60161331926819"]


@pytest.mark.parametrize("behind", ["", ".", " BIC CAIXESBBXXX", " BANK", " A", " OK NOW", " DE89 3704 0044 0532 0130 00"])
def test_words_behind_an_account_number_are_not_part_of_it(spark, behind):
    texts = [f"Pay to {a}{behind}" for a in ACCOUNTS]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "iban"] for r in pii.find_spans(rows).collect()}
    second = ["DE89 3704 0044 0532 0130 00"] if "DE89" in behind else []
    assert found == {k: [a, *second] for k, a in enumerate(ACCOUNTS)}
    for r in pii.redact(rows).collect():
        assert r.text.startswith("Pay to [IBAN]") and ACCOUNTS[r.doc_id] not in r.text


def test_account_numbers_that_fail_or_run_on_are_left(spark):
    texts = ["AT61 1904 3002 3457 3202 BANK", "AT611904300234573201X", "xAT611904300234573201", "ES91 2100 0418 4502 0005 133"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(not [s for s in r.spans if s.kind == "iban"] for r in pii.find_spans(rows).collect())


def test_words_nearby_decide_on_social_security_numbers(spark):
    texts = ["SSN 123-45-6789", "part no 123-45-6789", "social security: 219-09-9999, old", "ssn 000-12-3456 666-12-3456 900-11-2222 123-00-4567 123-45-0000", "ssn 1123-45-67890", "mail a@b.co"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.summary(pii.find_spans(rows)).collect()}
    assert got == {0: ("ssn:4:15", [0.8]), 1: ("", []), 2: ("ssn:17:28", [0.8]), 3: ("", []), 4: ("", []), 5: ("email:5:11", [1.0])}
    assert [r.text for r in pii.redact(rows).orderBy("doc_id").limit(2).collect()] == ["SSN [SSN]", texts[1]]


def test_context_words_can_be_given(spark):
    kinds = [pii.Kind("code", "[0-9]{4}", "", "geheim", 0.5, near=0.3, least=0.7)]
    rows = spark.createDataFrame([(1, "geheim 1234"), (2, "open 1234")], "doc_id long, text string")
    assert {r.doc_id: [s.start for s in r.spans] for r in pii.find_spans(rows, kinds).collect()} == {1: [7], 2: []}
