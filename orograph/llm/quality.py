"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gets a few shape features, computed for many texts at once. Each feature is cut into bins
at quantiles. Boosting goes round the features: a tree of at most four leaves is fitted to the
residuals over one feature's bins and added, shrunk, to that feature's lookup table; then the pairs
of features that explain most of what is left get tables of their own, from trees that split both.
A text's score is the sum of its table entries through the logistic function.

The model is fitted on the driver, on at most about ``SAMPLE_ROWS`` labelled rows drawn by a hash of
the id; everything else runs over all rows.

Edge cases: a null or empty text has zero features and gets a score like any other; without any
label, or with labels of one kind only, the score is the share of label 1 (1 of nothing); several
labels of one id are averaged; equal rows give equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import bytes_of, id_and_text, slices
from .hashing import WHITE, Texts, first_of, runs

#: Bound of the labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_chars", "word_length", "upper_share", "symbol_share", "digit_share", "distinct_words", "commonest_word", "same_as_before",
    "distinct_triples", "repeated_lines", "log_words_per_line", "symbol_words", "bang_share", "beyond_ascii",
)
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS, LEAST_ROWS, RIDGE = 32, 120, 0.15, 6, 40, 20, 1.0

_B = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_B >= a) & (_B <= b) for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39)))
_SYMBOL = (_B > 0x20) & (_B < 0x7F) & ~_UPPER & ~_LOWER & ~_DIGIT
_LINE = _B == 0x0A


def _ratio(a, b) -> np.ndarray:
    return np.asarray(a, float) / np.maximum(b, 1)


def _grouped(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group (rows first[i] to first[i + 1]): number of distinct keys and the size of the commonest."""
    n = len(first) - 1
    group = np.repeat(np.arange(n), np.diff(first))
    order = np.sort((group.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    if not len(order):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    owner = (order[new] >> np.uint64(40)).astype(np.int64)
    sizes = np.diff(np.append(new, len(order)))
    most = np.zeros(n)
    np.maximum.at(most, owner, sizes)
    return np.bincount(owner, minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    data, offsets = bytes_of(texts)
    t = Texts(data, offsets)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    chars, upper, lower, digit, symbol = (count(table[data]) for table in ((_B & 0xC0) != 0x80, _UPPER, _LOWER, _DIGIT, _SYMBOL))
    high = count(data >= 0xC0)
    starts, ends = t.stretches(WHITE)
    first = first_of(starts, offsets)
    words, h = np.diff(first), t.hashes(starts, ends)
    distinct, commonest = _grouped(h, first)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[2:] = np.cumsum(h[1:] == h[:-1])
    inner = same[first[1:]] - same[np.minimum(first[:-1] + 1, first[1:])]
    triples = runs(h, 3)
    triple_first = np.concatenate([[0], np.cumsum(np.maximum(words - 2, 0))])
    keep = np.ones(len(triples), bool)
    for back in (1, 2):  # triples that reach into the next text
        at = first[1:] - back
        keep[at[(at >= 0) & (at < len(triples)) & (words >= back)]] = False
    distinct3, _ = _grouped(triples[keep], triple_first)
    line_starts, line_ends = t.stretches(_LINE)
    line_first = first_of(line_starts, offsets)
    lines = np.diff(line_first)
    distinct_lines, _ = _grouped(t.hashes(line_starts, line_ends), line_first)
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    only_symbols = np.concatenate([[0], np.cumsum((marks[ends] - marks[starts]) * 2 > (ends - starts))])
    return np.column_stack([
        np.log1p(chars), _ratio(chars, words).clip(0, 100), _ratio(upper, upper + lower + high), _ratio(symbol, chars), _ratio(digit, chars),
        _ratio(distinct, words), _ratio(commonest, words), _ratio(inner, words), _ratio(distinct3, words - 2), 1 - _ratio(distinct_lines, lines) * (lines > 0) - (lines == 0),
        np.log1p(_ratio(words, lines)), _ratio(only_symbols[first[1:]] - only_symbols[first[:-1]], words), _ratio(count(data == 0x21), words), _ratio(high, chars),
    ])


def _best_cut(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, int]:
    """Gain and place (bins below it go left) of the best cut of a row of bins; place 0 if there is none."""
    gl, hl, cl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(c)[:-1]
    gt, ht, ct = g.sum(), h.sum(), c.sum()
    gain = gl ** 2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt ** 2 / (ht + RIDGE)
    gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = 0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 0 else (0.0, 0)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return -g.sum() / (h.sum() + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with at most four leaves."""
    out = np.zeros(len(g))
    _, cut = _best_cut(g, h, c)
    for a, b in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        _, inner = _best_cut(g[a:b], h[a:b], c[a:b])
        for x, y in ((a, a + inner), (a + inner, b)) if inner else ((a, b),):
            out[x:y] = _leaf(g[x:y], h[x:y])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree over two features' bins: one cut of the first, and one of the second on either side.

    The cut of the first is the one that leaves the best two cuts of the second.
    """
    below = [np.cumsum(x, 0)[:-1] for x in (g, h, c)]
    above = [x.sum(0) - y for x, y in zip((g, h, c), below)]

    def best(side: list[np.ndarray]) -> np.ndarray:
        """For every row: the best score with one cut along the row, or without."""
        total = [x.sum(1, keepdims=True) for x in side]
        left = [np.cumsum(x, 1)[:, :-1] for x in side]
        score = left[0] ** 2 / (left[1] + RIDGE) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + RIDGE)
        score[(left[2] < LEAST_ROWS) | (total[2] - left[2] < LEAST_ROWS)] = 0
        return np.maximum(score.max(1, initial=0), (total[0] ** 2 / (total[1] + RIDGE))[:, 0])

    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    gains = best(below) + best(above) - whole
    gains[(below[2].sum(1) < LEAST_ROWS) | (above[2].sum(1) < LEAST_ROWS)] = 0
    cut = int(np.argmax(gains)) + 1 if len(gains) and gains.max() > 0 else 0
    out = np.zeros(g.shape)
    for a, b in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        _, inner = _best_cut(g[a:b].sum(0), h[a:b].sum(0), c[a:b].sum(0))
        for x, y in ((0, inner), (inner, g.shape[1])) if inner else ((0, g.shape[1]),):
            out[a:b, x:y] = _leaf(g[a:b, x:y], h[a:b, x:y])
    return (float(gains.max()) if cut else 0.0), out


@dataclass
class AdditiveModel:
    """Lookup tables over bins; ``edges[f]`` are the limits between the bins of feature f."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.bins(x), np.full(len(x), self.base)
        for b, table in zip(bins, self.tables):
            total += table[b]
        for (i, j), table in self.pairs.items():
            total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on features and labels of 0 and 1."""
    prior = (y.sum() + 1) / (len(y) + 1) if y.all() else y.mean()
    model = AdditiveModel(float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6)))))
    if y.all() or not y.any():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins, sizes = model.bins(x), [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    def histogram(at: np.ndarray, n: int, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(at, w, n) for w in (g, h)] + [np.bincount(at, minlength=n)]

    for _ in range(ROUNDS):
        for f, n in enumerate(sizes):
            step = RATE * _tree(*histogram(bins[f], n, *slopes()))
            model.tables[f] += step
            total += step[bins[f]]

    def over_pair(i: int, j: int) -> tuple[float, np.ndarray]:
        parts = histogram(bins[i] * sizes[j] + bins[j], sizes[i] * sizes[j], *slopes())
        return _pair_tree(*[p.reshape(sizes[i], sizes[j]) for p in parts])

    either = [max((over_pair(i, j)[0], i, j), (over_pair(j, i)[0], j, i)) for i in range(len(sizes)) for j in range(i)]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for _, i, j in sorted(either, reverse=True)[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * over_pair(i, j)[1]
            table += step
            total += step[bins[i], bins[j]]
    return model


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, bound: int) -> DataFrame:
    """One label (share of 1) per id, of about ``bound`` ids drawn by a hash if there are more.

    An id may stand on many rows, so ``train`` bounds the rows as well.
    """
    one = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("id").agg(F.avg("label").alias("label"))
    n = one.count()
    return one if n <= bound else one.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit the model on labelled documents; pass only the labels that may be learned.

    At most 2 * ``bound`` rows reach the driver, as features: of the rows of the drawn ids those with the smallest hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "label", "draw")], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "label", "draw", "x"])

    sample = F.broadcast(labelled_sample(labels, label_col, id_col, bound))  # at most about ``bound`` rows
    rows = id_and_text(docs, id_col, text_col).join(sample, "id")
    read = rows.select("id", "text", "label", F.xxhash64("id", "text").alias("draw")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label double, draw long, x array<double>")
    got = read.orderBy("draw", "id", "label").limit(2 * bound).orderBy("id", "label", "draw").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, (got.column("label").to_numpy() >= 0.5).astype(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher is better) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.score(features(part.column("text"))))], names=[id_col, "score"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, score double")


def score_column(text: Column, model: AdditiveModel) -> Column:
    """The score as a column expression, for rows whose other columns are to stay."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))
        return pa.array(np.concatenate([model.score(features(p.column("text"))) for p in parts] or [np.zeros(0)]))

    return run(F.coalesce(text, F.lit("")))
