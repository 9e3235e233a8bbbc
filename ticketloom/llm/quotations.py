"""Conversations without quotes, linked by what they quote.

Messages are parsed into their own text and quoted passages with nesting levels. Quoted passages and own texts are cut into
sentences, normalised and hashed; a join inside each conversation finds the message that first wrote a quoted sentence.
The outermost passage names the message that is answered. Following the answers gives threads, in which every message
stands after the one it answers, and conversations are built from the messages of a thread in that order, without quotes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.memory import tidy
from ticketloom.sources.sinks import stored

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"^.{0,200}\b(wrote|writes|schrieb|a écrit|escribió)\b.{0,40}:\s*$", re.IGNORECASE)
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n\s*\n")
_NOT_WORD = re.compile(r"[\W_]+")


def quote_level(line: str) -> tuple[int, str]:
    """How many quote marks a line begins with, and the line without them."""
    found = _MARKS.match(line)
    return (found.group(1).count(">"), line[found.end() :]) if found else (0, line)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]): lines of one level in a row form a passage; a line that only introduces the deeper
    passage after it belongs to neither."""
    blocks: list[tuple[int, list[str]]] = []
    for line in text.splitlines():
        level, rest = quote_level(line)
        if blocks and blocks[-1][0] == level:
            blocks[-1][1].append(rest)
        else:
            if blocks and level > blocks[-1][0]:
                _drop_intro(blocks[-1][1])
            blocks.append((level, [rest]))
    own = "\n".join("\n".join(lines).strip("\n") for level, lines in blocks if level == 0 and any(x.strip() for x in lines))
    quoted = [(level, "\n".join(lines).strip()) for level, lines in blocks if level > 0]
    return own.strip(), [(level, passage) for level, passage in quoted if passage]


def _drop_intro(lines: list[str]) -> None:
    at = len(lines) - 1
    while at >= 0 and not lines[at].strip():
        at -= 1
    if at >= 0 and _INTRO.match(lines[at]):
        del lines[at:]


def sentences(passage: str) -> list[str]:
    """Lower-case words of every sentence; line breaks inside a sentence don't matter."""
    found = (_NOT_WORD.sub(" ", s.lower()).strip() for s in _SENTENCE_END.split(passage))
    return [s for s in found if s]


_PARSED = (
    "body string, quotes array<struct<level:int,passage:string>>, own array<string>, "
    "cited array<struct<level:int,sentence:string>>"
)


def parsed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns, ``body`` (the text without quotes), ``quotes`` (level, passage) and the sentences of both."""
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    quote = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.string())]))
    cite = pa.list_(pa.struct([("level", pa.int32()), ("sentence", pa.string())]))

    def run(batches):
        for batch in batches:
            bodies, quotes, own, cited = [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                body, passages = parse(value.as_py() or "")
                bodies.append(body)
                quotes.append([{"level": n, "passage": p} for n, p in passages])
                own.append(sorted(set(sentences(body))))
                cited.append([{"level": n, "sentence": s} for n, p in passages for s in sentences(p)])
            columns = [
                pa.array(bodies, pa.string()), pa.array(quotes, quote),
                pa.array(own, pa.list_(pa.string())), pa.array(cited, cite),
            ]
            names = [*batch.schema.names[:-1], "body", "quotes", "own", "cited"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(tidy(run), f"{schema}, {_PARSED}")


def _answers(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): the earlier turn whose sentences the outermost quotes of a message hold most of.

    A quoted sentence belongs to the first turn of the conversation that wrote it outside quotes, so each has one origin
    and a frequent sentence multiplies nothing.
    """
    own = messages.select("conv", "turn", F.explode("own").alias("sentence"))
    own = own.select("conv", "turn", F.xxhash64("sentence").alias("h1"), F.xxhash64(F.lit(1), "sentence").alias("h2"))
    first = own.groupBy("conv", "h1", "h2").agg(F.min("turn").alias("origin"))
    cited = messages.select("conv", "turn", F.explode("cited").alias("c"))
    outer = cited.groupBy("conv", "turn").agg(F.min("c.level").alias("level"))
    cited = cited.join(outer, ["conv", "turn"]).where("c.level = level").select(
        "conv", "turn", F.xxhash64("c.sentence").alias("h1"), F.xxhash64(F.lit(1), "c.sentence").alias("h2"),
        F.length("c.sentence").alias("size"),
    )
    linked = cited.join(first, ["conv", "h1", "h2"]).where("origin < turn")
    weights = linked.groupBy("conv", "turn", "origin").agg(F.sum("size").alias("size"))
    return weights.groupBy("conv", "turn").agg(F.max(F.struct("size", "origin"))["origin"].alias("parent"))


def _roots(answers: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of every turn with a parent. The distance covered doubles each round."""
    known = stored(answers.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = known.select("conv", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = known.join(up, ["conv", "root"], "left")
        if moved.where("_root IS NOT NULL").isEmpty():
            return known
        known = stored(moved.select(
            "conv", "turn", F.coalesce("_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        ), "threads")


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``position``: how many rows of the group stand before, in the given order.

    Rows are sorted over range partitions and numbered where they lie, so a group that holds a third of all rows is numbered
    by many tasks. A task's numbers go on where those of the tasks before it ended; a row per task and group that reaches
    over several tasks tells where, at most two per task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    packed = placed.select(F.xxhash64(*group).alias("_group"), F.struct("*").alias("_row"))
    schema = packed.select("_row").schema.add("_group", "long").add("_task", "integer").add("_local", "long")

    def run(batches):
        task, open_group, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            local = np.arange(len(mine)) - np.repeat(edges, np.diff(np.append(edges, len(mine))))
            if mine[0] == open_group:
                first = edges[1] if len(edges) > 1 else len(mine)
                local[:first] += count
            open_group, count = mine[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(np.full(len(mine), task), pa.int32()), pa.array(local, pa.int64())],
                ["_row", "_group", "_task", "_local"],
            )

    found = stored(packed.mapInArrow(tidy(run), schema), "numbered")
    sizes = found.groupBy("_group", "_task").agg(F.count(F.lit(1)).alias("n"))
    wide = sizes.groupBy("_group").agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1").select("_group")
    before = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(wide, "_group").withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = found.join(F.broadcast(starts), ["_group", "_task"], "left")
    return joined.select("_row.*", (F.col("_local") + F.coalesce("_start", F.lit(0))).alias("position"))


#: Messages in a row of ``assembled``; a longer thread goes on in the next row.
MOST_MESSAGES = 500


def assembled(messages: DataFrame, conv: str, turn: str, most: int = MOST_MESSAGES) -> DataFrame:
    """(conv, root_turn, part, n_messages, messages, text): the threads of ``conversations`` as rows of at most ``most``
    messages (position, turn, role, body) in the order of their positions, and their formatted texts one after the other.
    A longer thread goes on in its next ``part``, so no row grows with a thread."""
    part = F.floor(F.col("position") / most).cast("int")
    entry = F.struct("position", F.col(turn).alias("turn"), "role", "body", "formatted")
    rows = messages.groupBy(conv, "root_turn", part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("m"))
    plain = F.transform("m", lambda e: F.struct(e["position"].alias("position"), e["turn"].alias("turn"), e["role"].alias("role"), e["body"].alias("body")))
    return rows.select(
        conv, "root_turn", "part", F.size("m").alias("n_messages"), plain.alias("messages"),
        F.array_join(F.transform("m", lambda e: e["formatted"]), "").alias("text"),
    )


def conversations(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, parent_turn, root_turn, depth, position, n_quotes, body, formatted) for every message.

    ``position`` counts the messages before it in its thread, in the order of turns, so each message follows the one it
    answers; messages of equal turns follow each other by role and body. ``parent_turn`` is NULL when nothing it
    quotes was written before in the conversation; such a message begins its own thread at depth 0. A NULL text is empty;
    messages with a NULL conversation or turn are kept as they are, without links, and those of a NULL conversation or root
    are numbered together. Rows with equal conversation and turn share their links. ``formatted`` is the body under its role.
    Other columns are not read.
    """
    plain = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    messages = stored(parsed(plain, "text", "conv", "turn", "role"), "messages")
    answers = stored(_answers(messages), "answers")
    roots = _roots(answers)
    out = messages.join(answers, ["conv", "turn"], "left").join(roots, ["conv", "turn"], "left")
    out = out.select("conv", F.coalesce("root", "turn").alias("root"), "turn", "role", "body", "parent", "depth", "quotes")
    out = _numbered(out, ["conv", "root"], ["turn", "role", "body"])
    label = F.coalesce("role", F.lit("unknown"))
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
        F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "position", F.size("quotes").alias("n_quotes"), "body",
        F.concat(F.lit("<|"), label, F.lit("|>\n"), "body", F.lit("\n")).alias("formatted"),
    )
