"""Token counts of a piece model, by heap-and-linked-list byte-pair merging.

A text is normalised as the model asks (blanks become the mark U+2581, one is put before the text)
and cut before every run of marks: no piece of such a model holds a mark behind another character,
so merging never crosses these places and the counts of the units add up. The count of a unit is
its initial symbols minus the merges; characters outside the vocabulary stand as their UTF-8 bytes.
No identifiers are made.

Edge cases: a null or empty text has 0 tokens; equal rows give equal rows; extra columns are ignored.
A text without blanks is one unit, which takes n log n steps. The counts of units of up to
``CACHED_CHARS`` characters are remembered by each worker, ``CACHED_UNITS`` at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import id_and_text, slices
from .merging import merge

MARK = "▁"
CACHED_CHARS = 48
CACHED_UNITS = 1_000_000
_RUNS = re.compile(" +[^ ]*")


class PieceCounter(dict):
    """Counts of units by text; a unit is a text behind one blank, which is left out of the key."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if model.normalize("  a ") != MARK * 3 + "a" + MARK:
            raise ValueError("only models that keep all blanks and put one in front are supported")
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ranks)

    def unit(self, text: str) -> int:
        """Tokens of one normalised unit."""
        ranks = self.ranks
        if text in ranks and len(text) == 1:
            return 1
        symbols = list(text)
        left = len(symbols) - merge(symbols, ranks)
        return left + sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in ranks)

    def __missing__(self, key: str) -> int:
        n = self.unit(MARK + key.replace(" ", MARK))
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED_UNITS:
                self.clear()
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if self.whole:
            return self[text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return sum(self[u[1:]] for u in _RUNS.findall(" " + text))
        return sum(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def piece_counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``model_path`` is a file that every executor has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(count, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
