"""Token counts and byte-level coding against the libraries, and how they treat odd rows."""

import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orograph.llm import byte_bpe, token_counts
from tests.llm.conftest import MODEL, ODD, RANKS

PARTS = st.lists(st.sampled_from(["a", "b", " ", "  ", "▁", "\t", "\n", "é", "😀", "\x00", "<s>", "</s>", "the", " hello", "'s", "'re", "'", "''ll", "1", "½", "　", "\x85", "x" * 40]), max_size=25).map("".join)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.piece_counter(MODEL)


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    own = byte_bpe.byte_coder(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}), own


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(PARTS, st.text(max_size=60)))
def test_counts_equal_the_library(pieces, text):
    library, own = pieces
    assert own.count(text) == len(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(PARTS, st.text(max_size=60)), min_size=1, max_size=4))
def test_ids_equal_the_library_and_decode_to_the_text(coder, texts):
    library, own = coder
    ids, counts, offsets = own.encode(pa.array(texts, pa.string()))
    decoded = own.decode(ids, counts, offsets).to_pylist()
    at = 0
    for text, n, back in zip(texts, counts, decoded):
        got = ids[at:at + n].tolist()
        assert got == library.encode_ordinary(text) and back == text.encode()
        assert all(library.decode_bytes([i]) == back[a:][:len(library.decode_bytes([i]))] for i, a in zip(got, offsets[at:at + n]))
        at += n


def test_a_clash_of_hashes_changes_nothing(coder, monkeypatch):
    library, own = coder
    monkeypatch.setattr(byte_bpe.Texts, "hashes", lambda self, a, b: (b - a).astype("uint64"))
    ids, _, _ = own.encode(pa.array(["one two six ten", "the cat sat"]))
    assert ids.tolist() == [i for t in ("one two six ten", "the cat sat") for i in library.encode_ordinary(t)]


def test_ids_that_do_not_fit_their_offsets_are_an_error(coder):
    _, own = coder
    ids, counts, offsets = own.encode(pa.array(["some text here"]))
    with pytest.raises(ValueError):
        own.decode(ids, counts, offsets + 1)


def test_long_texts_and_blocks(coder):
    library, own = coder
    texts = ["word's " * 3000, "a" * 5000, "\n " * 2000, "'ll" * 1500, ""]
    ids, counts, _ = own.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)] and len(counts) == 5


def test_rank_file_is_read_whole(coder):
    with open(RANKS, "rb") as f:
        assert coder[1].ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_counts_of_odd_rows(spark, odd, nothing, pieces):
    library, _ = pieces
    rows = token_counts.token_counts(odd, MODEL, limit=50).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.doc_id is not None:
            text = ODD[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 50)
    assert token_counts.token_counts(nothing, MODEL).count() == 0


def test_coding_of_odd_rows(spark, odd, nothing, coder):
    library, _ = coder
    encoded = byte_bpe.encode(odd, RANKS)
    for r in encoded.collect():
        if r.doc_id is not None:
            text = (ODD[r.doc_id] or "").encode()
            assert r.ids == library.encode_ordinary(text.decode())
            ends = [*r.offsets[1:], len(text)]
            assert all(library.decode_bytes([i]) == text[a:b] for i, a, b in zip(r.ids, r.offsets, ends))
    for r in byte_bpe.decode(encoded, RANKS, first=2, last=5).collect():
        assert r.decoded == library.decode_bytes(r.ids[2:5])
    for r in byte_bpe.digests(byte_bpe.decode(encoded, RANKS)).collect() + byte_bpe.digests(byte_bpe.encode_and_decode(odd, RANKS)).collect():
        if r.doc_id is not None:
            text = ODD[r.doc_id] or ""
            ids = library.encode_ordinary(text)
            assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(nothing, RANKS), RANKS)).count() == 0
