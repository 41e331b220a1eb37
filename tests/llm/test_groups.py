"""Near copies, chat windows and the pipeline against plain loops."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from orograph.llm import chat, near_copies
from orograph.llm.queries import ORACLES, QUERIES, QUALITY_LIMIT
from tests.llm.brute_near import components
from tests.llm.brute_pii import base
from tests.llm.conftest import MODEL, ODD
from tests.llm.test_texts import hits
from workload.compare import compare, connect

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    common, docs = [rng.choice(vocabulary) for _ in range(30)], []
    for _ in range(20):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 60, 120, 300]))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            p = rng.choice([0, 0.005, 0.01, 0.03, 0.06])
            copy = [x for x in (rng.choice(vocabulary) if rng.random() < p else x for x in words) if rng.random() > p / 2]
            docs.append(" ".join(copy + common if rng.random() < 0.3 else copy))
    docs += [None, "", " "] * 2
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("rare_df, stars, crowded, block", [(3, 0, 5, 7), (1, 1, 2, 3), (2, 6, 1000, 9), (near_copies.RARE, near_copies.STARS, near_copies.CROWDED, near_copies.BLOCK)])
def test_groups_equal_plain_loops(spark, copies, rare_df, stars, crowded, block):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    got = near_copies.near_copies(df, rare_df=rare_df, stars=stars, crowded=crowded, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(copies)


def test_groups_of_odd_rows(spark, odd, nothing):
    rows = near_copies.near_copies(odd).collect()
    want = components([(i, t) for i, t in enumerate(ODD)])
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert (r.n_shingles, r.component_id) == ((1, None) if r.doc_id is None else want[r.doc_id])
    assert near_copies.near_copies(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toArrow(), connect(SF).sql(ORACLES[name]).to_arrow_table()) is None


def said(rows):
    """Per conversation what the read-back must give."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(7), []
    parts = ["a", "\\", "\n", "<|im_end|>", "<|im_start|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<", " hello world", "é😀", "<|endoftext|>", "\r"]
    for conv in [*range(30), None]:
        for turn in range(rng.choice([1, 2, 5, 30, 600 if conv == 3 else 4])):
            role = rng.choice(["user", "assistant", "assistant", "tool\nx\\", None]) if turn else rng.choice(["system", "user"])
            text = rng.choice([None, "", *("".join(rng.choice(parts) for _ in range(rng.choice([3, 50, 400]))) for _ in range(4))])
            rows.append((conv, None if conv == 5 and turn == 2 else turn, role, text))
    return rows + rows[:3]


def test_chats_are_read_back_whole(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(4).selectExpr("*", "'x' AS conv", "1 AS window", "2 AS tokens")
    got = chat.read_back(chat.format_conversations(df, MODEL)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == said(talks)
    assert chat.read_back(chat.format_conversations(df.limit(0), MODEL)).count() == 0


def test_windows_keep_to_the_budget(spark, talks):
    short = [(c, t, r, (x or "")[:60]) for c, t, r, x in talks]
    budget = chat.Budget(window=400, history=120, system=120)
    df = spark.createDataFrame(short, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, MODEL, budget).orderBy("conv", "window").collect()
    assert max(w.tokens for w in windows) <= budget.window
    assert sum(w.repeated > 0 for w in windows) > 10
    for w in windows:
        turns = chat.parse(w.text)
        assert [chat.unescape(w.text[s.start:s.end]) for s in w.loss] == [t for r, t in turns[w.repeated:] if r == "assistant"]
        assert not any(m in chat.unescape("") for m in ("<s>",)) and "</s>" not in w.text and "[INST]" not in w.text
    with_system = {w.conv for w in windows if chat.parse(w.text)[0][0] == "system"}
    assert all(chat.parse(w.text)[0][0] == "system" for w in windows if w.conv in with_system)


def test_a_long_system_turn_is_not_repeated_without_bound(spark):
    """Output stays within about twice the conversation, and everything is read back, very long turns too."""
    said_once = "You are a careful assistant. " * 520
    rows = [(1, 0, "system", said_once)] + [(1, t, ("user", "assistant")[t % 2], f"turn {t} " + "some words here " * 16) for t in range(1, 400)]
    rows += [(2, 0, "user", "long " * 30_000), (2, 1, "assistant", "also long " * 20_000), (2, 2, "assistant", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_conversations(df, MODEL)
    given = {c: sum(len(t) + 40 for conv, _, _, t in rows if conv == c) for c in (1, 2)}
    sizes = {r.conv: r.n for r in formatted.selectExpr("conv", "length(text) AS n").groupBy("conv").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert all(sizes[c] < 2.6 * given[c] for c in given)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(formatted).collect()} == said(rows)


def test_pipeline_stages_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = rows(stages["quality"](spark, docs, SMALL))
    scores = {r.doc_id: r.score for r in QUERIES["op3_quality_classifier"](spark, SMALL).collect()}
    assert set(good) == {i for i, s in scores.items() if s >= QUALITY_LIMIT}
    single = rows(stages["near copies"](spark, docs, SMALL))
    assert set(single) == {c for _, c in components(sorted(rows(docs).items())).values()}
    clean = rows(stages["decontamination"](spark, docs, SMALL))
    assert set(clean) == {i for i, t in rows(docs).items() if not hits(t, bench, 10)[-1]}
    redacted = stages["personal data"](spark, docs, SMALL)
    assert redacted.columns == docs.columns and all(not base(t) for t in rows(redacted).values())
    untouched = {i: t for i, t in rows(docs).items() if not base(t)}
    assert sum(rows(redacted)[i] == t for i, t in untouched.items()) >= len(untouched) - 1
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_different_texts_of_one_id_all_stay(spark):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, one), (7, other), (7, other), (3, one), (None, "c d e f g h"), (None, "c d e f g h"), (None, "x y z"), (9, "c d e f g h"), (11, None), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.keep_one_copy(spark, df, SMALL)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(3, one), (7, other), (9, "c d e f g h"), (None, "x y z"), (11, None), (12, "")], key=repr)


def test_stages_take_odd_tables(spark, odd):
    docs = odd.selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SMALL)
            assert name == "encoding" or out.columns == docs.columns
            assert out.count() <= table.count()
