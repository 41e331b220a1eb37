"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The splitting pattern of the public rank files is an automaton of nine states over eight classes of
code points. Every class is a transition function; the functions and all their compositions form a
small monoid, so a position's state is an associative scan over the elements of the monoid: blocks
of the text are scanned side by side, the block results are chained, and one lookup gives each
position's state. Whether a token starts at a position follows from the state before it, its class
and whether a visible character comes next. No regular expression is used.

The slices between the starts are encoded by merging adjacent byte pairs by rank; equal slices of a
batch are looked up once, and what a slice encodes to is remembered by the worker. Byte offsets of the
tokens are kept: decoding gathers the bytes of all tokens from one flat table, each to its offset, and
fails where they do not fit; any range of tokens can be decoded alone.

Edge cases: a null or empty text has no tokens and decodes to an empty one; equal rows give equal
rows; extra columns are ignored. Nulls in the id column stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bytes_of, id_and_text, list_array, slices
from .hashing import Texts
from .merging import merge

CACHED_BYTES = 64
#: Slices remembered by a worker: so many new ones, and as many from before.
CACHED_SLICES = 150_000
#: Stretches that are gathered at once.
AT_ONCE = 1 << 17

# Classes of code points; the last one separates texts.
LETTER, SUFFIX, PAIR, NUMBER, QUOTE, OTHER, BLANK, SPACE, RESET = range(9)
# States: what stands before a position.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, QUOTED, QUOTED_PAIR, CONTRACTED = range(9)
# Fixed values of the pattern: endings of one and of two letters behind an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
# White space in the sense of Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 512


def _step(state: int, kind: int) -> int:
    if kind == RESET:
        return START
    if kind in (LETTER, SUFFIX, PAIR):
        if state == QUOTED and kind != LETTER:
            return CONTRACTED if kind == SUFFIX else QUOTED_PAIR
        return CONTRACTED if state == QUOTED_PAIR else IN_LETTERS
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, QUOTED, AFTER_BLANK) else QUOTED
    return {OTHER: IN_OTHERS, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE}[kind]


def _starts(state: int, kind: int, visible_next: bool) -> bool:
    if kind == RESET or state == START:
        return True
    if kind in (LETTER, SUFFIX, PAIR):
        return state in (IN_NUMBERS, IN_OTHERS, AFTER_SPACE, CONTRACTED) or state == QUOTED and kind == LETTER
    if kind == NUMBER:
        return state not in (IN_NUMBERS, AFTER_BLANK)
    if kind in (QUOTE, OTHER):
        return state not in (IN_OTHERS, QUOTED, AFTER_BLANK)
    return state not in (AFTER_BLANK, AFTER_SPACE) or visible_next


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements (rows of next states), the element of each class, products "first a, then b", and the table of starts."""
    functions = [tuple(_step(s, k) for s in range(9)) for k in range(9)]
    elements = list(dict.fromkeys([tuple(range(9)), *functions]))
    for a in elements:  # grows while it is read, until it is closed
        for f in functions:
            if (product := tuple(f[s] for s in a)) not in elements:
                elements.append(product)
    index = {e: i for i, e in enumerate(elements)}
    after = np.array([[index.get(tuple(b[s] for s in a), 0) for b in elements] for a in elements], np.uint8)
    starts = np.array([[[_starts(s, k, v) for v in (False, True)] for k in range(9)] for s in range(9)])
    return np.array(elements, np.uint8), np.array([index[f] for f in functions], np.uint8), after, starts


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from Unicode's general categories; one more for the separator."""
    import regex

    table = np.full(0x110001, OTHER, np.uint8)
    for first in range(0, 0x110000, 0x1000):
        text = "".join(map(chr, range(first, first + 0x1000)))
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            table[[ord(c) for c in regex.findall(pattern, text)]] = kind
    table[WHITE_SPACE] = SPACE
    table[0x20], table[0x27], table[0x110000] = BLANK, QUOTE, RESET
    return table


def boundaries(points: np.ndarray) -> np.ndarray:
    """Indexes of code points where a token starts; 0x110000 separates texts and counts as a start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    elements, of_class, after, starts = _monoid()
    kinds = _classes()[points]
    visible = np.zeros(n, bool)
    visible[:-1] = kinds[1:] < BLANK
    for c in SHORT_ENDINGS:
        kinds[points == ord(c)] = SUFFIX
    for a, b in LONG_ENDINGS:
        kinds[:-1][(points[:-1] == ord(a)) & (points[1:] == ord(b))] = PAIR
    blocks = -(-n // BLOCK)
    steps = np.zeros(blocks * BLOCK, np.uint8)  # element 0 changes nothing
    steps[:n] = of_class[kinds]
    steps = np.ascontiguousarray(steps.reshape(blocks, BLOCK).T)
    size, products = len(elements), after.ravel()
    for j in range(1, BLOCK):
        steps[j] = products[steps[j - 1].astype(np.intp) * size + steps[j]]
    state, entry = START, np.zeros(blocks, np.uint8)
    rows = elements.tolist()
    for b, last in enumerate(steps[-1].tolist()):
        entry[b] = state
        state = rows[last][state]
    states = np.empty(blocks * BLOCK + 1, np.uint8)
    states[0] = START
    states[1:] = elements.ravel()[steps.T.astype(np.intp) * 9 + entry[:, None]].ravel()
    return np.flatnonzero(starts.ravel()[(states[:n].astype(np.intp) * 9 + kinds) * 2 + visible])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of stretches, one stretch behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def merged_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short slice: the pair of lowest rank, the first of equals, is merged until none is left.

    For a few dozen bytes, searching a list of ranks is quicker than keeping a heap.
    """
    none, get = 1 << 31, ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (lowest := min(pairs)) != none:
        i = pairs.index(lowest)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i]:cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1]:cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``source``, one behind the other; some at a time, as an index takes eight times the room of a byte."""
    parts = [source[ranges(starts[k:k + AT_ONCE], lengths[k:k + AT_ONCE])] for k in range(0, len(starts), AT_ONCE)]
    return np.concatenate(parts) if parts else source[:0]


class ByteCoder(dict):
    """Ids of slices by their bytes, and the bytes of all ids in one flat table."""

    def __init__(self, rank_path: str):
        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = sorted((i, b) for b, i in self.ranks.items())
        self.lengths = np.zeros(by_id[-1][0] + 1, np.int64)
        self.lengths[[i for i, _ in by_id]] = [len(b) for _, b in by_id]
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)
        self.before: dict[bytes, list[int]] = {}

    def __missing__(self, piece: bytes) -> list[int]:
        if piece in self.before:
            ids = self.before[piece]
        elif piece in self.ranks:
            ids = [self.ranks[piece]]
        elif len(piece) <= CACHED_BYTES:
            ids = merged_ids(piece, self.ranks)
        else:
            symbols = [piece[i:i + 1] for i in range(len(piece))]
            merge(symbols, self.ranks)
            ids = [self.ranks[s] for s in symbols if s is not None]
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED_SLICES:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        """Give the memory of the remembered slices back."""
        self.clear()
        self.before = {}

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 of all texts, first byte and length of each slice, and the number of slices of each text."""
        data, offsets = bytes_of(texts)
        inside = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero(inside)  # byte of every code point
        # Texts are parted by a mark of their own, so that no slice reaches over an end.
        ends = np.searchsorted(place, offsets[1:])
        marked = np.insert(points, ends, 0x110000)
        mark_at = ends + np.arange(len(ends))
        starts = boundaries(marked)
        starts = starts[~np.isin(starts, mark_at, assume_unique=True)]
        text_of = np.searchsorted(mark_at, starts)
        first = place[starts - text_of] if len(starts) else np.zeros(0, np.int64)
        counts = np.bincount(text_of, minlength=len(ends))
        after = np.append(first[1:], len(data))
        last = np.cumsum(counts)[counts > 0] - 1
        after[last] = offsets[1:][counts > 0]
        return data, first, after - first, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each has, and the byte of its text where each token begins.

        Equal slices are looked up once: they are told by a hash, and every one is compared with its first of that hash.
        """
        data, first, lengths, per_text = self.pieces(texts)
        keys = Texts(data, np.array([0, len(data)])).hashes(first, first + lengths)
        _, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        alike = (lengths == lengths[sample][which]).all() and np.array_equal(gathered(data, first, lengths), gathered(data, first[sample][which], lengths))
        if not alike:  # a clash of hashes: look up every slice
            sample = which = np.arange(len(first))
        raw = data.tobytes()
        found = [self[raw[a:b]] for a, b in zip(first[sample].tolist(), (first + lengths)[sample].tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        each = sizes[which]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[which], each)]
        # tokens of a text: those of its slices
        tokens = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(per_text)])]
        counts = np.diff(tokens)
        begins = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        return ids, counts, begins - np.repeat(begins[tokens[:-1][counts > 0]], counts[counts > 0])

    def decode(self, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray | None = None) -> pa.Array:
        """Bytes of every list of ids, gathered from the table; where ``offsets`` are given, each token must fall on its own."""
        lengths = self.lengths[ids]
        data = gathered(self.table, self.firsts[ids], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        if offsets is not None:
            begins = np.cumsum(lengths) - lengths - np.repeat(ends[:-1], counts)
            if not np.array_equal(begins, offsets):
                raise ValueError("the ids do not fit their offsets")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


@lru_cache(maxsize=2)
def byte_coder(rank_path: str) -> ByteCoder:
    return ByteCoder(rank_path)


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col``, ``ids array<int>`` and ``offsets array<int>`` (the byte where each token begins).

    With ``decoded``, the ids are decoded again in the same pass, each token at its offset, into a further column.
    ``rank_path`` is a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(rank_path)
        for part in slices(batches):
            ids, counts, offsets = coder.encode(part.column("text"))
            columns = [part.column("id"), list_array(ids, counts, pa.int32()), list_array(offsets.astype(np.int32), counts, pa.int32())]
            if decoded:
                columns.append(coder.decode(ids, counts, offsets))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "offsets", "decoded"][:len(columns)])
        coder.forget()

    rows = id_and_text(docs, id_col, text_col)
    more = ", decoded binary" if decoded else ""
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, ids array<int>, offsets array<int>{more}")


def decode(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids", first: int = 0, last: int | None = None) -> DataFrame:
    """``id_col``, the ids and ``decoded binary``: the bytes of tokens ``first`` to ``last`` (exclusive; None: to the end); a null list decodes to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(rank_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                lists = part.column(1)
                some = lists.fill_null([]) if lists.null_count else lists
                sizes = np.diff(some.offsets.to_numpy()).astype(np.int64)
                begin = np.minimum(first, sizes)
                taken = np.maximum((sizes if last is None else np.minimum(last, sizes)) - begin, 0)
                ids = some.flatten().to_numpy(zero_copy_only=False)[ranges(np.cumsum(sizes) - sizes + begin, taken)]
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(lists, pa.list_(pa.int32())), coder.decode(ids, taken)], names=[id_col, ids_col, "decoded"])

    rows = encoded.select(id_col, ids_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, `{ids_col}` array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with what the ids decode to, in one pass."""
    return encode(docs, rank_path, id_col, text_col, decoded=True)


def digests(decoded: DataFrame, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Number of ids and digests of the ids (decimal, joined by commas) and of the decoded bytes; ``keep`` names columns that stay."""
    return decoded.select(
        id_col, *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
