"""Document fingerprints from closed syncmers, with SQL functions only.

A text is read as units of up to ``UNIT`` visible characters (words, or pieces of longer runs). A
window of ``K`` units is chosen when the smallest hash of its inner windows of ``S`` units lies at
its first or last place. Whether it is chosen depends on the window alone, so an edit changes only
the windows that touch it, and an unchanged passage keeps its anchors with their distances. The
fingerprint keeps the ``SIZE`` smallest anchor hashes, as 8 hexadecimal digits each; the likeness of
two fingerprints is the estimated share of anchors that both texts have (Dice, 0 to 1).

Edge cases: a null text counts as empty; a text without visible characters has no anchors and an
empty fingerprint, which is like another empty one (1.0) and unlike all others (0.0); a text of fewer
than ``K`` units has its whole sequence as its one anchor; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions

UNIT, K, S, SIZE = 8, 4, 2, 64
#: Characters of a window and of its inner windows, and windows of one piece of text.
CHAR_K, CHAR_S, PIECE = 12, 4, 1024
#: Buckets of consecutive ids per shuffle partition, so that partitions come out even.
BUCKETS = 8
_LOW = -(2 ** 63)


def with_anchors(rows: DataFrame, text_col: str, out: str) -> DataFrame:
    """Column ``out``: structs (hash, at) of all chosen windows, ``at`` being the first unit, by place.

    Units, their hashes and those of the inner windows are steps of their own, so that none is computed twice.
    """
    kept, h, inner = rows.columns, F.col(f"{out}_h"), F.col(f"{out}_inner")
    units = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0))
    rows = rows.select(*kept, F.transform(units, lambda u: F.xxhash64(u)).alias(f"{out}_h"))
    rows = rows.select(*kept, h, F.zip_with(h, F.slice(h, S, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b)).alias(f"{out}_inner"))
    places = F.sequence(F.lit(0), F.greatest(F.size(h) - K, F.lit(0)))

    def chosen(i: Column) -> Column:
        first, *middle, last = [F.get(inner, i + j) for j in range(K - S + 1)]
        return F.least(first, last) <= (F.least(*middle) if len(middle) > 1 else middle[0])

    def anchor(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(K)]).alias("hash"), i.alias("at"))

    whole = F.array(F.struct(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)).alias("hash"), F.lit(0).alias("at")))
    none = F.array().cast("array<struct<hash:bigint,at:int>>")
    return rows.select(*kept, F.when(F.size(h) == 0, none).when(F.size(h) < K, whole).otherwise(F.transform(F.filter(places, chosen), anchor)).alias(out))


def sketch(anchors: Column) -> Column:
    """The smallest distinct hashes of anchors, as numbers of 32 bits in order."""
    codes = F.transform(anchors, lambda a: F.shiftrightunsigned(a["hash"], 32))
    return F.slice(F.array_sort(F.array_distinct(codes)), 1, SIZE)


def as_text(codes: Column) -> Column:
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of anchors in common: Jaccard over the smallest codes of both, turned into Dice."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SIZE)
    jaccard = F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.greatest(F.size(both), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2 * jaccard / (1 + jaccard))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` and ``anchors`` of every row."""
    rows = with_anchors(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", "anchors")
    return rows.select(id_col, as_text(sketch(F.col("anchors"))).alias("fingerprint"), "anchors")


def _bucket(key: Column, firsts: list[int]) -> Column:
    """Index of the last entry of ``firsts`` that is not above ``key``, by halving steps."""
    table, step, steps = F.array(*map(F.lit, firsts)), 1, []
    while step < len(firsts):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, s: F.when((at + s < len(firsts)) & (F.get(table, F.least(at + s, F.lit(len(firsts) - 1))) <= key), at + s).otherwise(at),
    )


def with_next(rows: DataFrame, id_col: str, tie_col: str, columns: list[str], between: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Columns ``next_...`` of the row that follows by an integer id (then ``tie_col``); the first row follows the last.

    The ids are cut into buckets of consecutive ids, of which a few hundred limits reach the driver. The
    first rows of a bucket are also sent to the bucket before it (those of the first one to the last), so
    each row meets its successor in its bucket, after one shuffle. A null id comes before all others.
    ``between`` adds columns to the rows behind the shuffle.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    ids = rows.select(key.alias("key"))
    n = BUCKETS * shuffle_partitions(rows)
    cuts = ids.agg(F.min("key").alias("least"), F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()
    if cuts["least"] is None:
        rows = between(rows) if between else rows
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    limits = sorted({cuts["least"], *(c for c in cuts["cuts"] if c > cuts["least"])})
    firsts = sorted(r.first_key for r in ids.groupBy(_bucket(F.col("key"), limits).alias("b")).agg(F.min("key").alias("first_key")).collect())
    rows = rows.select("*", key.alias("_key")).withColumn("_bucket", _bucket(F.col("_key"), firsts))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("carried"))
    before = F.struct(((F.col("_bucket") + len(firsts) - 1) % len(firsts)).alias("bucket"), F.lit(True).alias("carried"))
    first = F.get(F.array(*map(F.lit, firsts)), F.col("_bucket"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_key") == first, F.array(own, before)).otherwise(F.array(own))))
    by = Window.partitionBy("_to.bucket").orderBy("_to.carried", "_key", tie_col)
    if between:
        rows = between(rows.withColumn("_at", F.col("_to.bucket")).repartition(shuffle_partitions(rows), "_at"))
        by = Window.partitionBy("_at").orderBy("_to.carried", "_key", tie_col)
    out = rows.select("*", *[F.lead(c).over(by).alias(f"next_{c}") for c in columns])
    return out.filter("NOT _to.carried").drop("_key", "_bucket", "_to", "_at")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its second half replaced by the start of the next document)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_anchors(rows, "text", "anchors").select("id", "text", F.xxhash64("text").alias("tie"), sketch(F.col("anchors")).alias("codes"))
    rows = with_next(rows, "id", "tie", ["text", "codes"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "codes", "next_codes", edited.alias("edited"))
    rows = with_anchors(rows, "edited", "edited_anchors").withColumn("edited_codes", sketch(F.col("edited_anchors")))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, an array, with the value computed once, also where ``then`` reads it for every element."""
    return F.flatten(F.transform(F.array(value), then))


def character_anchors(points: Column, blank: Column) -> Column:
    """Codes (32 bits of hash, then the first character's place) of the chosen windows of ``CHAR_K`` characters, by place.

    ``points`` is the text in UTF-32. It is cut into pieces that overlap by a window less one character;
    as the choice depends on the window alone, the cuts change nothing and only bound the memory.
    """
    k, s, n = CHAR_K, CHAR_S, F.length(points)
    high = F.lit(-(1 << 32))

    def of_piece(at: Column, p: Column) -> Column:
        last = F.greatest(F.length(p).cast("int") - 4 * k + 1, F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), last + 4 * (k - s), F.lit(4)), lambda i: F.xxhash64(F.substring(p, i, F.lit(4 * s))))

        def codes(h: Column) -> Column:
            # The lesser of both ends is held against one inner window after the other, as most are given up after a few.
            ends = F.transform(h, lambda x, i: F.least(x, F.get(h, i + (k - s))))

            def code(end: Column, i: Column) -> Column:
                chosen = F.get(h, i + (k - s)).isNotNull()
                for j in range(1, k - s):
                    chosen = (end <= F.get(h, i + j)) & chosen
                return F.when(chosen, F.xxhash64(F.substring(p, i * 4 + 1, F.lit(4 * k))).bitwiseAND(high).bitwiseOR((at + i).cast("long")))

            return F.array_compact(F.transform(ends, code))

        return _let(hashes, codes)

    starts = F.sequence(F.lit(0), F.greatest((n / 4).cast("int") - k, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(starts, lambda at: _let(F.substring(points, at * 4 + 1, F.lit(4 * (PIECE + k - 1))), lambda p: of_piece(at, p)))
    whole = F.array(F.xxhash64(points).bitwiseAND(high))
    return F.when(blank, F.array().cast("array<bigint>")).when(n < 4 * k, whole).otherwise(F.flatten(pieces))


def with_character_anchors(rows: DataFrame, text_col: str, out: str) -> DataFrame:
    """Column ``out``: ``character_anchors`` of a text; a null one has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.select("*", F.encode(text, "UTF-32").alias("_points"), (~text.rlike(r"\S")).alias("_blank"))
    return rows.select("*", character_anchors(F.col("_points"), F.col("_blank")).alias(out)).drop("_points", "_blank")


def edited_anchors(rows: DataFrame, kept: Column, put: Column, out: str) -> DataFrame:
    """Columns ``out``: anchors of the text made of the first ``kept`` characters of a row and the first ``put`` of the next one,
    and ``out``_same: how many of the first ones are known to be those of ``codes``.

    A window's choice depends on the window alone, so the windows inside of either part are those of ``codes`` and
    ``next_codes``, at other places; only the windows over the seam are hashed. Texts that are blank or shorter than a
    window, for which other rules hold, are read directly. ``rows`` has text, codes, next_text, next_codes and edited.
    """
    k, low = CHAR_K, F.lit((1 << 32) - 1)

    def place(c: Column) -> Column:
        return c.bitwiseAND(low)

    rows = rows.select("*", kept.cast("int").alias("_kept"), put.cast("int").alias("_put"))
    kept, put = F.col("_kept"), F.col("_put")
    first = F.greatest(kept - (k - 1), F.lit(0))
    last = F.least(kept + put, kept + (k - 1))
    direct = ~F.col("text").rlike(r"\S") | ~F.col("next_text").rlike(r"\S") | (kept + put < k) | ~F.col("edited").rlike(r"\S")
    seam = F.substring(F.col("edited"), first + 1, F.when((last - first < k) | (put == 0) | (kept == 0), F.lit(0)).otherwise(last - first))
    rows = rows.select("*", direct.alias("_direct"), first.alias("_first"), F.encode(F.when(direct, F.col("edited")).otherwise(seam), "UTF-32").alias("_points"))
    # what is read directly may be blank; a blank seam between visible parts has anchors
    found = character_anchors(F.col("_points"), F.col("_direct") & ~F.col("edited").rlike(r"\S"))
    rows = rows.select("*", F.when(F.col("_direct"), found).when(F.length("_points") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(found, lambda c: c + F.col("_first"))).alias("_seam"))
    rows = rows.select("*", F.when(F.col("_direct"), F.array().cast("array<bigint>")).otherwise(F.filter("codes", lambda c: place(c) + k <= kept)).alias("_before"))
    after = F.transform(F.filter("next_codes", lambda c: place(c) + k <= put), lambda c: c + kept)
    rows = rows.select("*", F.when(F.col("_direct"), F.col("_seam")).otherwise(F.concat("_before", "_seam", after)).alias(out), F.size("_before").alias(f"{out}_same"))
    return rows.drop("_kept", "_put", "_direct", "_first", "_points", "_seam", "_before")


def with_digests(rows: DataFrame, digests: dict[str, str]) -> DataFrame:
    """For every column of anchors its digest, a column of the given name: the smallest distinct hashes, a text of fixed size at most.

    Of many anchors those below a bound are looked at first; where they are not enough, all of them.
    """
    kept, some = rows.columns, 4 * SIZE

    def least(codes: Column) -> Column:
        return F.slice(F.sort_array(F.array_distinct(F.transform(codes, lambda c: F.shiftrightunsigned(c, 32)))), 1, SIZE)

    def below(codes: Column) -> Column:
        bound = F.floor(F.lit(some << 32) / F.greatest(F.size(codes), F.lit(some)))
        return _let(bound, lambda b: F.filter(codes, lambda c: F.shiftrightunsigned(c, 32) < b))

    rows = rows.select("*", *[below(F.col(c)).alias(f"_low_{c}") for c in digests])
    rows = rows.select("*", *[least(F.col(f"_low_{c}")).alias(f"_least_{c}") for c in digests])

    def text(c: str) -> Column:
        enough = (F.size(f"_least_{c}") == SIZE) | (F.size(f"_low_{c}") == F.size(c))
        return as_text(F.when(enough, F.col(f"_least_{c}")).otherwise(least(F.col(c))))

    return rows.select(*kept, *[text(c).alias(name) for c, name in digests.items()])


def _anchor_hashes(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.shiftright(c, 32))


def _behind(codes: Column, same: Column) -> Column:
    """What follows the first ``same`` anchors."""
    return F.slice(codes, same + 1, F.size(codes))


def with_matches(rows: DataFrame, a: str, b: str, out: str, same: str | None = None) -> DataFrame:
    """Columns ``out`` (most anchors of both in one order) and ``out``_passage (anchors in a row: number, place in both).

    Anchors with one hash are paired by number, counted from the front, and where the texts have
    different numbers of them also from the back; the better of both counts. In the order of ``b``, the
    pairs' places in the order of ``a`` are cut into runs of consecutive ones, which always go together;
    the heaviest increasing chain of runs is found with a frontier of (last place, weight).

    ``same`` names a column with a number of first anchors that both have alike. Counted from the front these are
    paired with each other and stand before all other pairs, so only what follows them is searched. If all pairs go
    into the chain, it is the longest there can be; else what is counted from the back is read from the whole of both.
    """
    side, low = 1 << 31, F.lit((1 << 32) - 1)
    none = F.array().cast("array<bigint>")

    def step(*more: Column) -> None:
        nonlocal rows
        rows = rows.select("*", *more)

    def pair(whole: Column, i: Column, j: Column) -> Column:
        place = F.lit(side - 1)
        return F.shiftleft(F.get(whole, i).bitwiseAND(place), 32).bitwiseOR(F.get(whole, j).bitwiseAND(place))

    def entries(x: str, first: Column, second: Column, wanted: Column) -> None:
        """Columns all, turns and groups: entries of both sides by hash, side and place, where ``a`` turns into ``b``, and (turn, entries of a, entries of b) if some hash is repeated."""
        step(F.when(wanted, F.sort_array(F.concat(first, F.transform(second, lambda c: c.bitwiseOR(F.lit(side)))))).otherwise(none).alias(f"_all{x}"))
        whole = F.col(f"_all{x}")

        def alike(i: Column, j: Column) -> Column:
            return F.shiftright(F.get(whole, i).bitwiseXOR(F.get(whole, j)), 32) == 0

        # First entries of both sides: a hash of both texts has exactly one place where ``a`` turns into ``b``.
        turns = F.filter(F.sequence(F.lit(1), F.size(whole) - 1), lambda i: F.shiftright(F.get(whole, i).bitwiseXOR(F.get(whole, i - 1)), 31) == 1)
        bounds = F.filter(F.sequence(F.lit(0), F.size(whole)), lambda i: (i == 0) | (i == F.size(whole)) | ~alike(i, i - 1))
        step(F.when(F.size(whole) > 1, turns).otherwise(F.array().cast("array<int>")).alias(f"_turns{x}"))
        repeated = F.exists(f"_turns{x}", lambda i: ((i > 1) & alike(i, i - 2)) | ((i + 1 < F.size(whole)) & alike(i, i + 1)))
        step(F.when(repeated, bounds).alias(f"_bounds{x}"))
        # The bounds round a turn by the sorted union of both.
        step(F.when(F.col(f"_bounds{x}").isNotNull(), F.sort_array(F.concat(F.transform(f"_bounds{x}", lambda i: i * 2), F.transform(f"_turns{x}", lambda i: i * 2 + 1)))).alias(f"_marks{x}"))
        marks = F.col(f"_marks{x}")
        around = F.filter(F.sequence(F.lit(1), F.size(marks) - 2), lambda j: F.get(marks, j) % 2 == 1)
        groups = F.transform(around, lambda j: F.struct(
            F.floor(F.get(marks, j) / 2).cast("int").alias("turn"),
            ((F.get(marks, j) - 1 - F.get(marks, j - 1)) / 2).cast("int").alias("n_a"),
            ((F.get(marks, j + 1) - F.get(marks, j) + 1) / 2).cast("int").alias("n_b"),
        ))
        step(F.when(marks.isNotNull(), groups).alias(f"_groups{x}"))

    def numbered(x: str, back: bool) -> Column:
        whole = F.col(f"_all{x}")

        def of_group(g: Column) -> Column:
            turn, n_a, n_b = g["turn"], g["n_a"], g["n_b"]
            m = F.least(n_a, n_b)
            first_a, first_b = (turn - m, turn + n_b - m) if back else (turn - n_a, turn)
            return F.transform(F.sequence(F.lit(0), m - 1), lambda r: pair(whole, first_a + r, first_b + r))

        return F.coalesce(F.flatten(F.transform(f"_groups{x}", of_group)), F.transform(f"_turns{x}", lambda i: pair(whole, i - 1, i)))

    def chained(x: str) -> None:
        """Columns r (runs), n (anchors of the heaviest chain) and l (longest run) of the pairs p."""
        pairs, order, cuts, runs, chain = (F.col(f"_{c}{x}") for c in "pocrf")
        step(F.sort_array(F.transform(pairs, lambda p, i: F.shiftleft(p, 32).bitwiseOR(i.cast("long")))).alias(f"_s{x}"))
        step(F.transform(f"_s{x}", lambda v: v.bitwiseAND(low).cast("int")).alias(f"_o{x}"))
        cut = F.filter(F.sequence(F.lit(0), F.size(order)), lambda j: (j == 0) | (j == F.size(order)) | (F.get(order, j) != F.get(order, j - 1) + 1))
        step(F.when(F.size(order) > 0, cut).alias(f"_c{x}"))
        run = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts)), lambda j, k: F.struct((k - j).alias("n"), F.get(order, j).alias("v")))
        step(run.alias(f"_r{x}"))

        def taken(front: Column, r: Column) -> Column:
            at = F.shiftleft(r["v"].cast("long"), 32)

            def put(before: Column) -> Column:
                weight = F.coalesce(F.get(before, F.size(before) - 1).bitwiseAND(low), F.lit(0).cast("long")) + r["n"]
                after = F.filter(front, lambda e: (e > at) & (e.bitwiseAND(low) > weight))
                return F.concat(before, F.array(at.bitwiseOR(weight)), F.when(F.get(front, F.size(front) - 1) > at, after).otherwise(none))

            return _let(F.when(F.get(front, F.size(front) - 1) > at, F.filter(front, lambda e: e < at)).otherwise(front), put)

        step(F.aggregate(runs, none, taken).alias(f"_f{x}"))
        longest = F.array_max(F.transform(runs, lambda r: F.struct(
            r["n"].alias("anchors"), F.shiftright(F.get(pairs, r["v"]), 32).alias("at"), F.get(pairs, r["v"]).bitwiseAND(low).alias("other_at"),
        )))
        step(F.get(chain, F.size(chain) - 1).bitwiseAND(low).alias(f"_n{x}"), longest.alias(f"_l{x}"))

    kept, alike_first = rows.columns, F.col(same) if same else F.lit(0)
    rest = [_behind(F.col(c), alike_first) if same else F.col(c) for c in (a, b)]
    step(F.arrays_overlap(*map(_anchor_hashes, rest)).alias("_common"))
    entries("1", *rest, F.col("_common"))
    step(F.sort_array(numbered("1", False)).alias("_p1"))
    chained("1")
    uneven = F.exists("_groups1", lambda g: g["n_a"] != g["n_b"])
    back = (alike_first > 0) & (F.col("_n1") < F.size("_p1")) | (alike_first == 0) & F.coalesce(uneven, F.lit(False))
    step(F.coalesce(back, F.lit(False)).alias("_back"))
    entries("2", F.col(a), F.col(b), F.col("_back"))
    step(F.sort_array(numbered("2", True)).alias("_p2"))
    chained("2")
    # The first anchors are a run; the first run of what follows them goes on with it if it is the first on both sides.
    begun = alike_first + F.when(F.get("_r1", F.lit(0))["v"] == 0, F.get("_r1", F.lit(0))["n"]).otherwise(0)
    begun = F.when(alike_first > 0, F.struct(
        begun.alias("anchors"), F.get(a, F.lit(0)).bitwiseAND(F.lit(side - 1)).alias("at"), F.get(b, F.lit(0)).bitwiseAND(F.lit(side - 1)).alias("other_at")))
    return rows.select(
        *kept, F.coalesce(F.greatest(F.coalesce("_n1", F.lit(0).cast("long")) + alike_first, "_n2"), F.lit(0).cast("long")).alias(out),
        (F.greatest("_l1", "_l2", begun) if same else F.greatest("_l1", "_l2")).alias(f"{out}_passage"),
    )


def share(matched: Column, n_a: Column, n_b: Column) -> Column:
    """Share of ``n_a`` and ``n_b`` anchors that are matched; 1 where there are none."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise(2 * matched / F.greatest(n_a + n_b, F.lit(1)))


def dice(matched: Column, a: Column, b: Column) -> Column:
    """Share of the anchors of two texts that are matched; 1 where neither has any."""
    return share(matched, F.size(a), F.size(b))


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``edit_report``, by characters: likeness by all anchors in consistent order, their numbers, and the longest passage in common.

    A passage is a struct (anchors, at, other_at), places in characters. Anchors are computed behind the shuffle, so only texts are sent.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = with_next(rows, "id", "tie", ["text", "codes"], lambda r: with_character_anchors(r, "text", "codes"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", "text", "next_text", n.cast("long").alias("n_chars"), half.alias("half"), "codes", "next_codes", edited.alias("edited"))
    rows = edited_anchors(rows, F.col("n_chars") - F.col("half"), F.least("half", F.length("next_text")), "edited_codes")
    codes, edited_codes, next_codes, same = F.col("codes"), F.col("edited_codes"), F.col("next_codes"), F.col("edited_codes_same")
    # What follows the first anchors of an edited text are those over the seam, of less than two windows, and then those of the next text.
    unlike = F.slice(edited_codes, same + 1, F.when(same > 0, F.lit(2 * CHAR_K)).otherwise(F.size(edited_codes)))
    rows = rows.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *[F.size(c).alias(f"n_{c}") for c in ("codes", "edited_codes", "next_codes")], "codes", "edited_codes", "next_codes", "edited_codes_same",
        F.arrays_overlap(_anchor_hashes(codes), _anchor_hashes(F.concat(next_codes, unlike))).alias("_common"),
    )
    rows = with_digests(rows, {"codes": "fingerprint", "edited_codes": "edited_fingerprint"})
    # Most texts have nothing in common with either but those first ones: of these only one is kept, for its place.
    rows = rows.withColumns({
        c: F.when(F.col("_common"), F.col(c)).otherwise(F.slice(c, 1, n)) for c, n in (("codes", 1), ("edited_codes", 1), ("next_codes", 0))
    }).drop("_common")
    rows = with_matches(rows, "codes", "edited_codes", "matched_edited", "edited_codes_same").drop("edited_codes", "edited_codes_same")
    rows = with_matches(rows, "codes", "next_codes", "matched_next")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", share(F.col("matched_edited"), F.col("n_codes"), F.col("n_edited_codes")).alias("near_edited"),
        share(F.col("matched_next"), F.col("n_codes"), F.col("n_next_codes")).alias("near_next"), F.col("n_codes").cast("long").alias("n_anchors"),
        "matched_edited", "matched_next", "matched_edited_passage", "matched_next_passage",
    )
