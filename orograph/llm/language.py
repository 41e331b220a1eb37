"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased texts are read as code points; their n-grams of one to three are hashed to ``SIZE``
features. A feature's weight in a text is its share of the text's n-grams times its inverse
document frequency, counted over all documents that may be learned. The regression is trained by
follow-the-regularised-leader with an elastic net, which keeps most coefficients at zero, and its
temperature is set on a part of the sample that was held back. As the model is linear, a text is
scored by adding table entries over its n-grams.

The regression is fitted on the driver on about ``SAMPLE_ROWS`` texts, spread evenly over the
languages and drawn by a hash of the id; document frequencies and scores cover all rows.

Edge cases: a null or empty text, or one without a letter, is ``und`` with score 0; with no language
to learn every text is; equal rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import id_and_text, slices

#: Bound of the texts that the regression is fitted on.
SAMPLE_ROWS = 3_000
SIZE = 1 << 15
ORDERS = 3
SCALE = 100.0
UNKNOWN = "und"
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.001, 3
_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the feature of the n-gram at every place (``SIZE``: none), and where each text begins.

    Every text has a blank before and after it; n-grams never reach into the next text.
    """
    lowered = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    out, state = [], np.zeros(len(points), np.uint32)
    for n in range(ORDERS):
        state = state[:len(points) - n] * _FACTORS[1] + (points[n:] + np.uint32(n + 1)) * _FACTORS[0]
        mixed = (state ^ (state >> np.uint32(15))) * _FACTORS[2]
        index = np.full(len(points), SIZE, np.int32)
        index[:len(state)] = mixed >> np.uint32(17)
        for back in range(1, n + 1):
            index[offsets[1:] - back] = SIZE
        out.append(index)
    return out, offsets


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text and how often each occurs."""
    flat = np.concatenate(ngrams([text])[0])
    n = np.bincount(flat, minlength=SIZE + 1)[:SIZE]
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at].astype(np.int32)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Number of texts with each feature, and last the number of texts; one vector per task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(SIZE + 1, np.int64), np.zeros(SIZE + 1, bool)
        for part in slices(batches):
            orders, offsets = ngrams(part.column("text").to_pylist())
            for a, b in zip(offsets, offsets[1:]):
                seen[:] = False
                for index in orders:
                    seen[index[a:b]] = True
                seen[SIZE] = True
                total += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["feature", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = np.zeros(SIZE + 1, np.int64)
    for feature, n in rows.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():  # at most SIZE + 1 rows
        out[feature] = n
    return out


@dataclass
class LanguageModel:
    """``table[feature, language]``, one more row of zeros for none, ``bias`` and ``temperature``."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        orders, offsets = ngrams(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        for index in orders:
            sums += np.add.reduceat(self.table[index], offsets[:-1], axis=0)
        sizes = np.diff(offsets)
        total = sum(np.maximum(sizes - n, 0) for n in range(ORDERS))
        logits = (sums / np.maximum(total, 1)[:, None] * SCALE + self.bias) / self.temperature
        p = _softmax(logits)
        best = p.argmax(1)
        known = np.array([_LETTER.search(t) is not None for t in texts])
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p[np.arange(len(texts)), best], 0.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> LanguageModel:
    """Follow-the-regularised-leader over (features, counts, language) in the given order; every fifth sample only calibrates."""
    n_languages = len(languages)
    z, n = np.zeros((SIZE + 1, n_languages)), np.zeros((SIZE + 1, n_languages))  # the last row is the bias, of value 1
    bias = np.array([SIZE])

    def vector(at, count):
        return np.append(at, bias), np.append(count / count.sum() * idf[at] * SCALE, 1.0)

    def weights(rows):
        zr, nr = z[rows], n[rows]
        l1 = np.where(rows == SIZE, 0.0, L1)[:, None]
        return np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / ((BETA + np.sqrt(nr)) / ALPHA + L2))

    learn = [s for i, s in enumerate(samples) if i % 5]
    hold = [s for i, s in enumerate(samples) if i % 5 == 0] or learn
    for _ in range(EPOCHS):
        for at, count, y in learn or hold:
            rows, x = vector(at, count)
            w = weights(rows)
            error = _softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(np.arange(SIZE + 1))
    logits = np.array([x @ w[rows] for rows, x in (vector(at, count) for at, count, _ in hold)])
    target = np.array([y for *_, y in hold])

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean()

    temperature = min(np.geomspace(0.1, 10, 81), key=loss)
    table = np.vstack([w[:SIZE] * idf[:, None], np.zeros((1, n_languages))]).astype(np.float32)
    return LanguageModel(languages, table, w[SIZE], float(temperature))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on documents with a language; pass only those that may be learned.

    Rows are drawn by a hash of id and text, about ``bound`` of them, and at most 2 * ``bound`` reach the driver, however
    often a row is repeated.
    """
    rows = id_and_text(docs, id_col, text_col, F.col(lang_col).alias("lang")).filter("lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((SIZE + 1, 0), np.float32), np.zeros(0), 1.0)
    frequencies = document_frequencies(rows)
    idf = np.log((1 + frequencies[SIZE]) / (1 + frequencies[:SIZE])) + 1
    share = bound / len(languages)
    most = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int((1 << 30) * min(1.0, share / sizes[lang])))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [counts(t) for t in part.column("text").to_pylist()]
            columns = [part.column("key"), part.column("lang"), *[pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "at", "n"])

    drawn = rows.filter(draw < most[F.col("lang")]).select(F.xxhash64("id", "text", F.lit(1)).alias("key"), "text", "lang")
    got = drawn.mapInArrow(run, "key long, lang string, at binary, n binary").orderBy("key", "lang").limit(2 * bound).toArrow().to_pylist()
    got.sort(key=lambda r: (r["key"], r["lang"], r["at"], r["n"]))  # an order that does not depend on the tasks
    samples = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32), languages.index(r["lang"])) for r in got]
    return fit([s for s in samples if len(s[0])], languages, idf)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            languages, p = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(languages, pa.string()), pa.array(p)], names=[id_col, "lang_pred", "score"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
