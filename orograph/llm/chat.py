"""Chat formatting in budgeted windows.

Turns are written as ``<|im_start|>role``, a line break, the text and ``<|im_end|>``. Control strings
inside roles and texts are broken by a backslash behind their first character, and backslashes are
doubled, so the output can be read back exactly.

The tokens of the turns are summed up along a conversation (in blocks of turns, then over blocks).
The sums choose the windows: turns that begin in the same stretch of ``stride`` tokens form one, but
for a turn that runs over the end of its stretch, which has a window to itself. So a window's turns
hold at most ``stride`` tokens, unless a single turn is longer (it is kept whole). Every turn is new
in one window. Before its new turns a window repeats the leading system turn and the turns just
before, as far as they fit in ``history`` tokens; repeated turns are not in the loss mask.

A system turn longer than half of ``stride`` makes the stride of its conversation twice as long as itself,
so all its repetitions together are no longer than about the conversation; windows then hold more tokens
than ``window``. They do also where a single turn, or a system turn beyond ``system`` tokens, is longer.

No step needs a conversation in one place but the digest of its whole text, which streams over the
sorted windows with a running hash.

Edge cases: null roles and texts count as empty; a null conversation id is a conversation of its own;
turns are ordered by (turn, role, text), nulls first, so equal rows follow each other and both count;
an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .shared import checkpointed
from .token_counts import piece_counter

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control strings without their first character, "<" or "[" (fixed values of common templates).
CONTROL = r"([<\[])(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
#: Turns of one block of the prefix sums.
BLOCK = 256
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Budget:
    """Tokens of a window: new turns, repeated history, and what is set aside for the system turn."""

    window: int = 1024
    history: int = 256
    system: int = 128

    @property
    def stride(self) -> int:
        return self.window - self.history - self.system


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def with_tokens(turns: DataFrame, model_path: str) -> DataFrame:
    """``turns`` with the tokens of each formatted turn, by the piece model at ``model_path``."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        counter = piece_counter(model_path)
        return pa.array([n for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])) for n in map(counter.count, part.column("text").to_pylist())], pa.int64())

    return turns.withColumn("tokens", count(F.concat("head", "body", F.lit(CLOSE))))


def formatted_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role and the formatted turn in two parts: ``head`` (marker and role) and ``body`` (escaped text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    head = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), head.alias("head"), escaped(text).alias("body"))


def with_places(turns: DataFrame) -> DataFrame:
    """Adds ``number`` (from 0), ``start`` (tokens before it, without a leading system turn) and ``lead`` (tokens of that turn) along each conversation."""
    turns = turns.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    inner = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    inside = turns.select("*", (F.row_number().over(inner) - 1).alias("at"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("sum"))
    over = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"), F.min(F.struct(F.col("turn"), F.col("role"), F.col("body"), F.col("tokens"))).alias("first"))
    lead = Window.partitionBy("conv").orderBy("block")
    first = F.first("first").over(lead)
    system = F.when(first["role"] == "system", first["tokens"]).otherwise(0)
    blocks = blocks.select(
        F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("b_n"),
        (F.coalesce(F.sum("total").over(over), F.lit(0)) - system).alias("b_sum"), system.alias("lead"),
    )
    joined = inside.join(blocks, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    return joined.select("conv", "role", "head", "body", "tokens", (F.col("at") + F.col("b_n")).alias("number"), (F.col("sum") + F.col("b_sum")).alias("start"), "lead")


def windows(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """conv, window, text, loss (spans of code points), repeated (leading turns that earlier windows hold), tokens.

    ``turns`` has the columns of ``with_places``.
    """
    system = (F.col("number") == 0) & (F.col("role") == "system")
    stride = F.greatest(F.lit(budget.stride).cast("long"), F.col("lead") * 2)  # a stretch gives two windows at most
    span = F.floor(F.col("start") / stride)
    crosses = (F.col("start") + F.col("tokens") > (span + 1) * stride).cast("long")
    part = F.struct("number", "head", "body", "tokens")
    new = turns.withColumn("window", F.when(system, F.lit(0).cast("long")).otherwise(span * 2 + crosses))
    starts = new.filter(~system).groupBy(F.col("conv").alias("w_conv"), F.col("window").alias("w_window")).agg(F.min("start").alias("w_start"))
    first = starts.groupBy("w_conv").agg(F.min("w_window").alias("w_first"))
    # History: a turn serves the windows that begin at most ``history`` tokens after its start.
    cells = F.array(F.floor(F.col("start") / budget.history), F.floor(F.col("start") / budget.history) + 1)
    offered = turns.filter(~system).select("*", F.explode(cells).alias("cell"))
    begun = starts.withColumn("w_cell", F.floor(F.col("w_start") / budget.history))
    history = offered.join(begun, F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("cell") == F.col("w_cell"))).filter(
        (F.col("start") < F.col("w_start")) & (F.col("w_start") - F.col("start") <= budget.history)
    ).select("conv", F.col("w_window").alias("window"), part.alias("part"), F.lit(False).alias("is_new"), F.lit(False).alias("is_loss"))
    # The system turn goes to all windows; it is new in the first one, and alone where there is no other turn.
    systems = turns.filter(system).select(F.col("conv").alias("s_conv"), part.alias("part"))
    opened = starts.join(first.withColumnRenamed("w_conv", "f_conv"), F.col("w_conv").eqNullSafe(F.col("f_conv"))).drop("f_conv")
    leading = systems.join(opened, F.col("s_conv").eqNullSafe(F.col("w_conv")), "left").select(
        F.col("s_conv").alias("conv"), F.coalesce("w_window", F.lit(0)).alias("window"), "part", F.coalesce(F.col("w_window") == F.col("w_first"), F.lit(True)).alias("is_new"), F.lit(False).alias("is_loss"),
    )
    own = new.filter(~system).select("conv", "window", part.alias("part"), F.lit(True).alias("is_new"), (F.col("role") == "assistant").alias("is_loss"))
    parts = own.unionByName(history).unionByName(leading)
    # A window holds at most the budget, or a single longer turn.
    gathered = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("part.number", "part.head", "part.body", "part.tokens", "is_new", "is_loss"))).alias("parts"))
    step = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + step(p)))
    gathered = gathered.select("*", ends.alias("ends"))

    def loss(p: Column, i: Column) -> Column:
        at = F.get("ends", i) + F.length(p["head"])
        return F.when(p["is_loss"], F.struct(at.alias("start"), (at + F.length(p["body"])).alias("end")))

    return gathered.select(
        "conv", "window", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        F.filter(F.transform("parts", loss), lambda s: s.isNotNull()).alias("loss"), F.size(F.filter("parts", lambda p: ~p["is_new"])).alias("repeated"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"),
    )


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("a turn's marker is missing")
        head = _HEAD.match(text, at + len(OPEN))
        end = text.index(CLOSE, head.end())
        out.append((unescape(head.group(1)), unescape(text[head.end():end])))
        at = end + len(CLOSE)
    return out


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from its windows: turns, digests of all turns and of the text under the loss mask, sizes.

    A hash is sequential, so a conversation is streamed by one task; it keeps one window at a time.
    """
    kind = formatted.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        key, state, done = None, None, []

        def close() -> None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "text", "loss", "repeated"))):
                conv, text, loss, repeated = row
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"]:span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
                done.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(formatted.schema["conv"].dataType)
    rows = formatted.select("conv", "window", "text", "loss", "repeated").repartition("conv").sortWithinPartitions("conv", "window")
    return rows.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame, model_path: str, budget: Budget = Budget(), **columns: str) -> DataFrame:
    """Windows of all conversations; ``columns`` name the columns (conv_col, turn_col, role_col, text_col).

    The turns with their places are checkpointed, as every part of a window is taken from them.
    """
    return windows(checkpointed(with_places(with_tokens(formatted_turns(conversations, **columns), model_path))), budget)
