"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised on their bytes: A-Z is lowered and every ASCII character but letters and digits
becomes a blank; characters beyond ASCII stay and are word characters. The words of a text, joined by
single blanks, are scanned once by the automaton of all windows of the benchmark (``words`` item
words in a row; a shorter item is one window). A match between blanks is an occurrence; its place
counted in words is mapped back to code points of the original text.

The benchmark is a query set. Its automaton is built in blocks of at most ``BLOCK_BYTES`` of
windows, so a benchmark of any size is scanned whole with bounded memory; each block is one more
scan of the texts. What is sent to the executors is checked by that size.

Edge cases: a null or empty text, or one without words, has 0 words and no hits; an item without
words has no window; items with equal windows are all named; an empty benchmark hits nothing; equal
rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import id_and_text, slices

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Bytes of text that are scanned against one block before the next one is loaded.
SCAN_BYTES = 4 << 20
_WORD = bytes(c for c in range(256) if c > 0x7F or bytes([c]).isalnum())
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(items: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows as text between blanks, each with its number of words and the ids of its items."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    item = items.select(F.col(id_col).cast("string").alias("item"), F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - words + 1))
    cut = item.filter("size(words) > 0").select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, words))).alias("w"))
    return cut.groupBy(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("window"), F.size("w").alias("n")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def window_blocks(windows: DataFrame) -> Iterator[list]:
    """The windows in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in windows.toLocalIterator():
        block.append((row.window.encode().decode("latin-1"), row.n, tuple(row["items"])))
        size += len(row.window)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(maxsize=1)
def automaton(packed: bytes) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for window, n, items in pickle.loads(zlib.decompress(packed)):
        a.add_word(window, (len(window), n, items))
    a.make_automaton()
    return a


def occurrences(line: str, machine: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words (from, to) of all occurring windows and their items; ``line`` has a blank around every word."""
    found = list(machine.iter(line)) if len(machine) else []
    if not found:
        return [], set()
    blanks = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    firsts = [(int(blanks[end - size + 1]) - 1, n) for end, (size, n, _) in found]
    return [(first, first + n) for first, n in firsts], set().union(*(items for _, (_, _, items) in found))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def sent_blocks(benchmark: DataFrame, words: int, item_col: str, text_col: str) -> list[Broadcast]:
    """The blocks of windows, sent to the executors one by one."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(zlib.compress(pickle.dumps(b))) for b in window_blocks(windows_of(benchmark, words, item_col, text_col))]


def scan(texts: list[str], blocks: list[Broadcast]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Numbers of words, merged spans of hit words, and items found, for each text."""
    split = [normal_words(t.encode()) for t in texts]
    lines = [(b" " + b" ".join(w) + b" ").decode("latin-1") if w else "" for w in split]
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        machine = automaton(block.value)
        for k, line in enumerate(lines):
            spans, names = occurrences(line, machine)
            if spans:
                hits[k] += spans
                items[k] |= names
    return [len(w) for w in split], [merged(h) for h in hits], items


def hit_column(text: Column, benchmark: DataFrame, words: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> Column:
    """Whether any window occurs in the text, as a column expression, for rows whose other columns are to stay."""
    blocks = sent_blocks(benchmark, words, item_col, item_text_col)

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), SCAN_BYTES)
            yield pa.array([bool(h) for p in parts for h in scan(p.column("text").to_pylist(), blocks)[1]], pa.bool_())
        automaton.cache_clear()

    return run(F.coalesce(text, F.lit("")))


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as code points of the text (from, to)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(raw.tobytes().translate(NORMAL), np.uint8) != 0x20
    edges = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first, last = chars[np.flatnonzero(edges == 1)], chars[np.flatnonzero(edges == -1)]
    return [(int(first[a]), int(last[b - 1])) for a, b in spans]


SCHEMA = "n_words long, word_spans array<struct<start:long,end:long>>, char_spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in row] for row in rows], _SPANS)


def find_windows(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: its words, the hit spans in words and in code points (merged), and the items found (as strings, sorted)."""
    rows = id_and_text(docs, id_col, text_col)
    blocks = sent_blocks(benchmark, words, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SCAN_BYTES):
            texts = part.column("text").to_pylist()
            counts, hits, items = scan(texts, blocks)
            chars = [original_spans(t, h) if h else [] for t, h in zip(texts, hits)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts, pa.int64()), _spans(hits), _spans(chars), pa.array(map(sorted, items), pa.list_(pa.string()))],
                names=[id_col, "n_words", "word_spans", "char_spans", "items"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Words hit, items and whether the text is contaminated, from the spans."""
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("word_spans") > 0).alias("contaminated"),
    )
