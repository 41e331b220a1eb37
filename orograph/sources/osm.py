"""Map features from feature-server responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.unroll import unroll_indexed
from ..session import shuffled

_POINTS = "array<struct<lat: double, lon: double>>"
RESPONSE_SCHEMA = (
    f"elements array<struct<type: string, id: bigint, geometry: {_POINTS}, "
    f"members: array<struct<type: string, geometry: {_POINTS}>>, tags: map<string, string>>>"
)


def parse_osm_json(responses: DataFrame, body: str = "body") -> DataFrame:
    """Features of JSON responses: type, id, geometry, tags and the position in the response.

    Ways keep their own geometry. Relations join the geometry of all members in order and then
    their own; inner rings are not told apart. Elements without geometry and other element
    types are left out, missing tags become an empty map.
    """
    rest = [c for c in responses.columns if c != body]
    parsed = responses.select(*rest, F.from_json(body, RESPONSE_SCHEMA).alias("_r"))
    items = unroll_indexed(parsed, F.col("_r.elements"), "pos", "_e").drop("_r")
    own = F.coalesce(F.col("_e.geometry"), F.array().cast(_POINTS))
    members = F.filter(
        F.transform(F.coalesce(F.col("_e.members"), F.array().cast(f"array<struct<type: string, geometry: {_POINTS}>>")),
                    lambda m: m["geometry"]),
        lambda g: g.isNotNull(),
    )
    geometry = F.when(F.col("_e.type") == "relation", F.concat(F.flatten(members), own)).when(F.col("_e.type") == "way", own)
    out = items.select(
        *rest, "pos", F.col("_e.type").alias("type"), F.col("_e.id").alias("id"), geometry.alias("geometry"),
        F.coalesce(F.col("_e.tags"), F.create_map().cast("map<string,string>")).alias("tags"),
    )
    return out.filter(F.size("geometry") > 0)


def response_errors(responses: DataFrame, body: str = "body") -> DataFrame:
    """The responses that are no JSON object with a list of elements, with the reason: such a response gives no features.

    A null body is a response that was not received.
    """
    rest = [c for c in responses.columns if c != body]
    parsed = responses.select(*rest, body, F.try_parse_json(body).alias("_json"))
    elements = F.schema_of_variant(F.try_variant_get("_json", "$.elements", "variant"))
    reason = (
        F.when(F.col(body).isNull(), F.lit("no response")).when(F.col("_json").isNull(), F.concat(F.lit("broken JSON of "), F.octet_length(body).cast("string"), F.lit(" bytes")))
        .when(~F.coalesce(elements.startswith("ARRAY"), F.lit(False)), F.lit("no list of elements"))
    )
    return parsed.select(*rest, reason.alias("reason")).filter("reason IS NOT NULL")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of JSON files up to every closing brace, with their quotes and the braces that open in them.

    A file is cut at its braces by the splits of the text reader, so many tasks read it. ``open_0`` counts for a piece that
    begins outside of a text, ``open_1`` for one that begins inside.
    """
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))
    # Without escaped characters, every second part between quotes is outside of texts.
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)

    def braces(parity: int) -> Column:
        chosen = F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), "")
        return F.length(chosen) - F.length(F.translate(chosen, "{", ""))

    return pieces.select("*", ((F.size(parts) - 1) % 2).alias("quotes"), braces(0).alias("open_0"), braces(1).alias("open_1"), (F.octet_length("value") + 1).alias("bytes"))


_SPLIT = ["file", "split"]


def _inside():
    """The pieces of a split up to one."""
    return Window.partitionBy(*_SPLIT).orderBy("at")


def _before(column: str, window) -> Column:
    """Sum over what comes earlier in a window."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Place of every piece in its split, and what it adds to the depth if the split begins outside or inside of a text."""
    pieces = pieces.select("*", _before("quotes", _inside()).alias("quotes_before"), F.row_number().over(_inside()).alias("number"))

    def depth(start: int) -> Column:
        begins, ends = (F.col("quotes_before") + start) % 2, (F.col("quotes_before") + F.col("quotes") + start) % 2
        return F.when(begins == 0, F.col("open_0")).otherwise(F.col("open_1")) - F.when(ends == 0, 1).otherwise(0)

    return pieces.select("*", depth(0).alias("depth_0"), depth(1).alias("depth_1"))


def _split_facts(pieces: DataFrame) -> DataFrame:
    """State of its file before every split, and the sums of the file; a few numbers a split are all that meets per file.

    Where a split begins is not known before all are counted, so the depths that occur in it are kept for both states of the
    text, each with its number of pieces: with them the elements that end in it are known from its first depth.
    """
    rows = _numbered(pieces)
    state = [(F.sum(f"depth_{p}").over(_inside()).alias(f"at_{p}"), ((F.col("quotes_before") + F.col("quotes") + p) % 2).alias(f"in_{p}")) for p in (0, 1)]
    rows = rows.select("*", *[c for both in state for c in both])
    sums = ("quotes", "depth_0", "depth_1", "bytes")
    levels = ["at_0", "in_0", "at_1", "in_1"]
    rows = rows.groupBy(*_SPLIT, *levels).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("pieces"), F.first("size").alias("size"))
    splits = rows.groupBy(*_SPLIT).agg(*[F.sum(c).alias(c) for c in (*sums, "pieces")], F.first("size").alias("size"), F.collect_list(F.struct(*levels, "pieces")).alias("levels"))
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("split")
    splits = splits.select("*", (_before("quotes", earlier) % 2).alias("start"))
    splits = splits.select("*", F.when(F.col("start") == 0, F.col("depth_0")).otherwise(F.col("depth_1")).alias("gain"))
    splits = splits.select(
        *_SPLIT, "start", "levels", _before("gain", earlier).alias("depth_start"), _before("pieces", earlier).alias("pieces_start"), F.count(F.lit(1)).over(whole).alias("n_splits"),
        *[F.sum(c).over(whole).alias(f"file_{c}") for c in ("gain", "quotes", "bytes", "pieces")], F.max("size").over(whole).alias("size"))

    def ended(l: Column) -> Column:
        at, inside = F.when(F.col("start") == 0, l["at_0"]).otherwise(l["at_1"]), F.when(F.col("start") == 0, l["in_0"]).otherwise(l["in_1"])
        return (inside == 0) & (at + F.col("depth_start") == 1)

    # only the last split can have a last piece that does not end, and no other follows it
    n = F.aggregate(F.filter("levels", ended), F.lit(0).cast("bigint"), lambda a, l: a + l["pieces"])
    splits = splits.withColumn("n", n).drop("levels")
    # The last piece has no brace behind it unless the bytes add up with one.
    return splits.select("*", _before("n", earlier).alias("first"), (F.col("file_bytes") > F.col("size")).alias("open_end")).drop("n")


def _ended(pieces: DataFrame, facts: DataFrame) -> DataFrame:
    """Pieces with their number in the file and ``ends``, 1 where the brace behind them ends an element.

    Pieces are shuffled here, once, to the facts of their split; what follows stays within a split.
    """
    rows = _numbered(pieces.drop("size").join(shuffled(facts), _SPLIT))
    gained = F.when(F.col("start") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    in_text = (F.col("quotes_before") + F.col("quotes") + F.col("start")) % 2
    rows = rows.withColumns({"gained": gained, "in_text": in_text, "number": F.col("pieces_start") + F.col("number")})
    rows = rows.withColumn("depth", F.col("depth_start") + F.sum("gained").over(_inside()))
    closed = ~(F.col("open_end") & (F.col("number") == F.col("file_pieces")))
    # an element ends where a brace leads back to the depth of the whole document
    return rows.withColumn("ends", (closed & (F.col("in_text") == 0) & (F.col("depth") == 1)).cast("int"))


def read_osm_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features (file, pos, type, id, geometry, tags) of JSON files of any size, and one row (file, elements, reason) per file.

    Each file is parsed by many tasks. Quotes are counted first: their number before a piece says whether it begins inside of a
    text. Then braces outside of texts give its depth. Both are sums within a split, and sums over the splits of a file. The
    text is shuffled once, by splits, which put their elements together; only elements over the end of a split are sent again.
    A file that breaks off, or whose braces or quotes do not fit, has a reason, and
    gives the features that are whole before that. Positions count the elements of a file from 0. Spark's readers
    skip files without a byte, so those have no row.
    """
    pieces = _pieces(spark, path)
    facts = _split_facts(pieces.drop("value"))

    def joined(facts: DataFrame) -> DataFrame:
        rows = _ended(pieces, facts)
        rows = rows.select("*", (F.col("first") + _before("ends", _inside())).alias("pos"))
        return rows.groupBy(*_SPLIT, "pos", "first", "pieces_start").agg(F.max("ends").alias("done"), F.array_sort(F.collect_list(F.struct("number", "value"))).alias("parts"))

    # what comes first in a split may have begun in an earlier one, unless it is the first of its file
    inside = (F.col("done") == 1) & ((F.col("pos") > F.col("first")) | (F.col("pieces_start") == 0))
    over_end = joined(facts.filter("n_splits > 1")).filter(~inside).groupBy("file", "pos").agg(F.max("done").alias("done"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))
    elements = joined(facts).filter(inside).select("file", "pos", "parts").unionByName(over_end.filter("done = 1").select("file", "pos", "parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    # the first one begins behind the opening of the document, the others behind a comma
    text = F.when(F.col("pos") == 0, F.regexp_replace(text, r"^[^{]*\{[^{]*", "")).otherwise(F.regexp_replace(text, r"^[^{]*", ""))
    bodies = elements.select("file", "pos", F.concat(F.lit('{"elements":['), text, F.lit("]}")).alias("body"))
    objects = bodies.select("file", "pos", "body", F.from_json("body", RESPONSE_SCHEMA)["elements"][0]["type"].alias("_type"))
    # objects beside the list (facts on the response) come before it and have no type
    found = parse_osm_json(objects.filter("_type IS NOT NULL").select("file", F.col("pos").alias("_pos"), "body")).drop("pos")
    ahead = objects.filter("_type IS NULL").groupBy("file").agg(F.count(F.lit(1)).alias("_ahead"))
    features = found.join(ahead, "file", "left").withColumn("pos", (F.col("_pos") - F.coalesce("_ahead", F.lit(0))).cast("int")).drop("_pos", "_ahead")
    counts = objects.filter("_type IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("elements"))
    files = facts.filter("pieces_start = 0").select(
        "file", (F.col("file_quotes") % 2).alias("in_text"), (F.col("file_gain") + F.when(F.col("open_end") & (F.col("file_quotes") % 2 == 0), 1).otherwise(0)).alias("depth"))
    reason = F.when(F.col("in_text") == 1, F.lit("ends inside of a text")).when(F.col("depth") > 0, F.concat(F.lit("ends at depth "), F.col("depth").cast("string"))).when(F.col("depth") < 0, F.lit("closes more than it opens"))
    report = files.join(counts, "file", "left").select("file", F.coalesce("elements", F.lit(0)).alias("elements"), reason.alias("reason"))
    return features, report


def read_osm_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of all response files under ``path``, one JSON document per file; a broken one ends the job.

    ``read_osm_parts`` reads large files in parts and names broken ones instead.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("file")
    )
    broken = F.raise_error(F.concat(F.lit("no feature response: "), F.col("file")))
    return parse_osm_json(files.withColumn("body", F.when(F.try_parse_json("body").isNull(), broken).otherwise(F.col("body"))))


def with_hot_tags(features: DataFrame, keys: tuple[str, ...] = ("highway", "building", "natural", "landuse")) -> DataFrame:
    """Copies of the tags that filters use, as columns: map lookups are not pushed to Parquet."""
    return features.withColumns({f"tag_{k}": F.try_element_at("tags", F.lit(k)) for k in keys})
