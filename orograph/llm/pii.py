"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, checks confirm them (parts of an address up to 255, Luhn for
cards, the number of digits for phones, remainder 97 for account numbers, the numbers that are given
out for social security) and words near a span raise its score. A span of a kind with a limit counts
only if its score reaches it: a social security number needs such a word, as nothing else tells it
from other numbers of that form. The base kinds have no limit. Everything happens within a row: no shuffle, and no Python on the executors.

How spans are found: ``split`` by a pattern gives what stands between its matches and
``regexp_extract_all`` the matches, so the places are running sums of their lengths. The sums are
built in chunks of ``CHUNK`` so that a text with very many matches stays cheap. All repetitions are
possessive or over single characters, so no text, however long, deepens Java's matching stack, and
a match may only begin where a run of its first class does (or the match before it ended).

Edge cases: a null or empty text has no spans; equal rows give equal rows; extra columns are kept
by ``redact`` and ignored by ``find_spans``. Places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128
NEAR = 48


@dataclass(frozen=True)
class Kind:
    """How one kind is found: pattern, words near it that speak for it, the score without them, what they add, and the score that it takes."""

    name: str
    pattern: str
    hint: str          # a text without a match of this has no span (a cheap test)
    words: str
    score: float
    check: str | None = None
    near: float = 0.1
    least: float = 0.0


def _behind(chars: str) -> str:
    return rf"(?:(?<![{chars}])|\G)"


#: Characters of an account number by country, as the IBAN registry has them.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account() -> str:
    """Blocks of four with blanks between: as many characters as the country has, or else as many as stand there."""

    def known(n: int, countries: str) -> str:
        rest = rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
        return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"

    each = "|".join(known(n, c) for n, c in ACCOUNT_LENGTHS.items())
    other = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{each})(?![A-Za-z0-9])|{other}(?![A-Za-z0-9]))"


#: Score that spans of the added kinds must reach.
ADDED_LIMIT = 0.75
LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"{_behind(LOCAL)}[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|address", 0.9),
    Kind("ip", rf"{_behind('0-9')}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip|host|server|address|login", 0.6, "ip"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", "card|visa|credit|pay|account", 0.7, "card"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax", 0.7, "phone"),
    Kind("iban", _account(), "", "iban|account|bank|transfer", 0.8, "iban", least=ADDED_LIMIT),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", r"\bssn\b|social[\x20-]security", 0.4, "ssn", 0.4, ADDED_LIMIT),
)
BASE = ("email", "ip", "card", "phone")


def with_running(rows: DataFrame, values: str, out: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Column ``out``: ``combine`` over the longs before each entry of ``values``, and over all, beginning with 0; null where ``values`` is.

    Chunks, their totals and the sums within them are steps of their own, so that none is computed twice.
    """

    def fold(x, first):
        return F.aggregate(x, F.array(first), lambda acc, v: F.array_append(acc, combine(F.element_at(acc, -1), v)))

    zero, kept, chunks = F.lit(0).cast("long"), rows.columns, F.col(f"{out}_chunks")
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
    rows = rows.select(*kept, F.when(F.col(values).isNotNull(), F.transform(starts, lambda c: F.slice(values, c, CHUNK))).alias(f"{out}_chunks"))
    totals = fold(F.transform(chunks, lambda c: F.aggregate(c, zero, combine)), zero)
    rows = rows.select(*kept, chunks, totals.alias(f"{out}_firsts"))
    parts = F.zip_with(chunks, F.slice(f"{out}_firsts", 1, F.size(chunks)), lambda c, first: F.slice(fold(c, first), 2, CHUNK))
    return rows.select(*kept, F.concat(F.array(zero), F.flatten(parts)).alias(out))


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    twice = F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + F.when((F.length(digits) - i) % 2 == 1, F.get(twice, F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (without blanks) leaves 1 when divided by 97, its first four characters moved behind."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda a, i: F.when(
            F.ascii(F.substring(turned, i, F.lit(1))) < 65, (a * 10 + F.substring(turned, i, F.lit(1)).cast("int")) % 97
        ).otherwise((a * 100 + F.ascii(F.substring(turned, i, F.lit(1))) - 55) % 97),
    )
    return value == 1


def _valid(check: str | None, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if check == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if check == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if check == "phone":
        return F.length(digits).between(10, 15)
    if check == "iban":
        account = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(False)
    if check == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def find_spans(docs: DataFrame, kinds: Sequence[Kind] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: structs (start, rank, end, kind, score) by start, then by the order of ``kinds``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_spans(rows, kinds).select(F.col("id").alias(id_col), "spans")


def _with_spans(rows: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """``rows`` with a column ``spans``. Every step is a projection of its own, so that nothing is computed twice."""
    text, names, kept = F.col("text"), [k.name for k in kinds], rows.columns
    none = F.array().cast("array<string>")
    found = {k.name: F.when(text.contains(k.hint), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in kinds}
    rows = rows.select(*kept, *[found[n].alias(f"m_{n}") for n in names])
    rows = rows.select(*rows.columns, *[F.when(F.size(f"m_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none).alias(f"b_{k.name}") for k in kinds])

    def lengths(n: str) -> Column:
        """From each match to the end of what stands behind it."""
        steps = F.zip_with(F.slice(f"b_{n}", 2, F.size(f"m_{n}")), f"m_{n}", lambda b, m: (F.length(b) + F.length(m)).cast("long"))
        return F.when(F.size(f"m_{n}") > 0, steps)

    rows = rows.select(*rows.columns, *[lengths(n).alias(f"l_{n}") for n in names])
    for n in names:
        rows = with_running(rows, f"l_{n}", f"s_{n}", lambda a, v: a + v)

    def spans(rank: int, kind: Kind) -> Column:
        n = kind.name

        def span(m: Column, i: Column) -> Column:
            around = F.concat_ws(" ", F.right(F.get(f"b_{n}", i), F.lit(NEAR)), F.left(F.get(f"b_{n}", i + 1), F.lit(NEAR)))
            score = F.lit(kind.score) + F.when(around.rlike(f"(?i)(?:{kind.words})"), kind.near).otherwise(0.0)
            start = F.length(F.get(f"b_{n}", F.lit(0))) + F.get(f"s_{n}", i)
            counts = _valid(kind.check, m) if kind.score >= kind.least else _valid(kind.check, m) & (score >= kind.least)
            return F.when(counts, F.struct(
                start.cast("long").alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).cast("long").alias("end"), F.lit(n).alias("kind"), score.alias("score"),
            ))

        return F.filter(F.transform(f"m_{n}", span), lambda s: s.isNotNull())

    return rows.select(*kept, F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(kinds)])).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans as a text, and their scores in the same order."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), F.transform(spans, lambda s: F.round(s["score"], 3)).alias("scores"))


def redact(docs: DataFrame, kinds: Sequence[Kind] = KINDS, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with every span of ``text_col`` replaced by its kind in brackets, and ``length_col`` set to the new length.

    Overlapping spans are taken out together, under the kind of the first. Other columns stay as they are.
    A text without spans, or a null one, stays unchanged, as does its length.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _with_spans(docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), kinds)
    some = F.size("spans") > 0
    ends = F.when(some, F.transform("spans", lambda s: s["end"]))
    rows = with_running(rows.select("row", "spans", ends.alias("ends"), F.when(some, F.encode("text", "UTF-32")).alias("points")), "ends", "covered", lambda a, v: F.greatest(a, v))
    mark = F.lit(b"\x00\x00\xfe\xff")  # else a leading U+FEFF of a piece would be taken for it

    def piece(start: Column, end: Column | None = None) -> Column:
        size = F.length("points") if end is None else (end - start) * 4
        return F.decode(F.concat(mark, F.substring(F.col("points"), (start * 4 + 1).cast("int"), size.cast("int"))), "UTF-32")

    def part(s: Column, i: Column) -> Column:
        before = F.get("covered", i)
        return F.when(s["start"] < before, "").otherwise(F.concat(piece(before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))

    text = F.concat(F.array_join(F.transform("spans", part), ""), piece(F.element_at("covered", -1)))
    rows = rows.select("row", F.when(some, text).alias("redacted"))
    new = {text_col: F.coalesce("redacted", F.col("row").getField(text_col))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("redacted").isNotNull(), F.length("redacted")).otherwise(F.col("row").getField(length_col)).cast(docs.schema[length_col].dataType)
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
