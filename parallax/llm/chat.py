"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut each conversation into sections of bounded
size, so that even a conversation that holds a third of all rows is dealt to
many tasks.  Inside a section, prefix sums choose turn-aligned windows that
fit the budget.  A window repeats the conversation's system turn and a
limited history; whatever is repeated is marked and stays outside the loss
mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ._common import bound_batches, save

#: tokens a window may hold, how many of them may be history, windows' worth of tokens in a section
BUDGET, HISTORY, SECTION = 2048, 256, 64
#: tokens that a turn's markers count as, characters of windows that a task hands back at once
MARKERS, CHARS = 4, 1 << 20

_SPECIAL = re.compile(r'[\\<"]')
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r'<turn role="((?:[^"\\]|\\.)*)"( repeat)?>\n(.*?)\n</turn>\n', re.S)


def escape(text: str) -> str:
    """A backslash before each backslash, ``<`` and ``"``: no control string can appear."""
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str, repeat: bool = False) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = f'<turn role="{escape(role)}"{" repeat" if repeat else ""}>\n'
    body = escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """The turns ``(role, text, repeat)`` of a formatted window."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[3]), m[2] is not None


def _sections(turns: DataFrame, budget: int, history: int, section: int) -> DataFrame:
    """``(conv, section, kind, turn, role, text, tokens)``: kind 0 system, 1 history, 2 own.

    Rows are dealt by range over (conversation, turn); the sums of each
    range's share of a conversation give every row its prefix sum without a
    window over a whole conversation (texts stay out of the range's key, whose
    sample goes to the driver)."""
    spark = turns.sparkSession
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"\S+")), F.lit(0)) + MARKERS
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = save(turns.withColumn("tokens", words.cast("long")).repartitionByRange(n, "conv", "turn")
                    .withColumn("chunk", F.spark_partition_id()), "turns")
    sums = dealt.groupBy("conv", "chunk").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = (dealt.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
              .join(sums, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
              .withColumn("start", F.col("own") + F.col("offset")))
    size = section * budget
    at = F.floor(F.col("start") / size)
    spots = F.array(F.struct(at.alias("section"), F.lit(2).alias("kind")),
                    F.when((at + 1) * size - F.col("start") <= history, F.struct((at + 1).alias("section"), F.lit(1).alias("kind"))))
    own = placed.select("conv", F.inline(F.array_compact(spots)), "turn", "role", "text", "tokens")
    first = dealt.groupBy("conv").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("f"),
                                      F.floor((F.sum("tokens") - 1) / size).alias("last")).where("f.role = 'system' and last > 0")
    system = first.select("conv", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("section"), F.lit(0).alias("kind"),
                          "f.turn", "f.role", "f.text", "f.tokens")
    return own.unionByName(system)


def _windows(turns: list[tuple], budget: int, history: int) -> Iterator[tuple]:
    """Windows of one section's turns ``(kind, role, text, tokens)`` in order."""
    system = [t for t in turns if t[0] == 0][:1]
    if not system and turns[0][0] == 2 and turns[0][1] == "system":
        system = turns[:1]
    rest = [t for t in turns if t[0]]
    ends = np.cumsum([t[3] for t in rest])
    starts = ends - np.array([t[3] for t in rest], np.int64)
    i = next((k for k, t in enumerate(rest) if t[0] == 2), len(rest))
    number = 0
    while i < len(rest):
        lead = system if system and not (rest[i] is system[0]) else []
        h = max(int(np.searchsorted(starts, starts[i] - history)), 0)
        while h < i and lead and rest[h] is system[0]:
            h += 1
        past = rest[h:i]
        room = budget - sum(t[3] for t in lead) - sum(t[3] for t in past)
        stop = max(int(np.searchsorted(ends, starts[i] + room, "right")), i + 1)
        parts, spans, length = [], [], 0
        for t, repeat in [*[(t, True) for t in lead + past], *[(t, False) for t in rest[i:stop]]]:
            text, a, b = turn_text(t[1], t[2], repeat)
            if not repeat and t[1] == "assistant":
                spans.append({"start": length + a, "end": length + b})
            parts.append(text)
            length += len(text)
        tokens = sum(t[3] for t in lead) + sum(t[3] for t in past) + int(ends[stop - 1] - starts[i])
        yield number, "".join(parts), spans, stop - i, tokens
        number, i = number + 1, stop


def _grouped(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns, one group in memory."""
    held, rows = None, []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            key = row[:keys]
            if rows and key != held:
                yield held, rows
                rows = []
            held = key
            rows.append(row)
    if rows:
        yield held, rows


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 budget: int = BUDGET, history: int = HISTORY, section: int = SECTION) -> DataFrame:
    """Windows ``(conv, section, window, formatted, loss, n_turns, tokens)``.

    ``loss`` lists the spans (code points) of ``formatted`` that are trained
    on: the text of each assistant turn in the one window that owns it.
    ``n_turns`` counts owned turns.  A window holds at most ``budget`` tokens
    (words plus markers) unless a single turn, with what is repeated, is
    larger.  Null roles and texts count as empty; rows are ordered by turn
    (null first), ties by role and text; repeated rows are turns of their
    own; rows with a null id form one conversation; no rows give no rows;
    other columns are ignored."""
    bound_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = _sections(rows, budget, history, section).repartition("conv", "section").sortWithinPartitions(
        "conv", "section", "kind", "turn", "role", "text")
    # ids travel through pandas as text, for a null among longs would turn them into floats
    parts = parts.select(F.col("conv").cast("string"), "section", "kind", "role", "text", "tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv", "section", "window", "formatted", "loss", "n_turns", "tokens"]
        done, chars = [], 0
        for (c, s), group in _grouped(batches, 2):
            found = _windows([x[2:] for x in group], budget, history)
            for number, formatted, loss, n, tokens in found:
                done.append((c, s, number, formatted, loss, n, tokens))
                chars += len(formatted)
                if chars > CHARS:
                    yield pd.DataFrame(done, columns=columns)
                    done, chars = [], 0
        if done:
            yield pd.DataFrame(done, columns=columns)

    kind = rows.schema["conv"].dataType.simpleString()
    out = parts.mapInPandas(run, "conv string, section long, window long, formatted string, "
                                 "loss array<struct<start:long,end:long>>, n_turns long, tokens long")
    return out.withColumn("conv", F.col("conv").cast(kind))


def digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation what its windows hold, read back from them in order.

    Digests are fed window by window, so memory does not grow with a
    conversation (a digest of one text is sequential by nature)."""
    kind = windows.schema["conv"].dataType.simpleString()
    ordered = windows.repartition("conv").sortWithinPartitions("conv", "section", "window").select(
        F.col("conv").cast("string"), "formatted", "loss")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_ = None
        for batch in batches:
            done = []
            for c, formatted, loss in zip(batch["conv"], batch["formatted"], batch["loss"]):
                if open_ is None or open_[0] != c:
                    if open_ is not None:
                        done.append((open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5]))
                    open_ = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, repeat in read_back(formatted):
                    if not repeat:
                        open_[1] += 1
                        open_[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = unescape(formatted[span["start"]:span["end"]])
                    open_[3] += len(text)
                    open_[4].update(text.encode("utf-8", "surrogatepass"))
                open_[5] += len(formatted)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if open_ is not None:
            yield pd.DataFrame([(open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5])], columns=columns)

    out = ordered.mapInPandas(run, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.col("conv").cast(kind).alias(conv), *out.columns[1:])
