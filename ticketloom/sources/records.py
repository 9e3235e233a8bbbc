"""Records of text files that lie across lines: elements of JSON arrays and quoted CSV rows.

Spark splits a text file between lines, so a large file is read by many tasks. Whether a split begins inside a record
follows from the splits before it alone: for CSV from the parity of their quotes, for JSON from how far their brackets
leave the nesting open, as no string of JSON holds a line break. One pass counts that for every split; a second cuts the
records, of which those that span splits come out as fragments and are joined. Each file has its own kind and its own fate:
a file that does not end as it should is reported and leaves the others alone.
"""

from __future__ import annotations

import csv
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.sources import sinks

#: Files whose names are sent to the tasks together; more are read in several passes.
MOST_SENT_FILES = 100_000
LINES, ARRAY, OBJECT, BROKEN = "lines", "array", "object", "broken"
_STRUCTURE = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]]', re.DOTALL)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): every line with its file and the first byte of its split."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\ufeff"))


def _many(text: Column, *characters: str) -> Column:
    """How often the characters occur."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0)).cast("long")


def _starts(blocks: DataFrame, change: str) -> DataFrame:
    """(file, block, start): the state at the beginning of every split after a file's first."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file", "block", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("start")).where("block > 0")


def json_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every file with its kind (file, kind), and the nesting at which its later splits begin.

    A file that begins with ``[`` is an array, one whose first line is an object goes by lines, one that begins with an
    object over several lines holds objects one after the other; what does not close is broken, and a file that begins with
    anything else goes by lines too.
    """
    # Escaped characters go first, so that the strings that are left hold no quote.
    bare = F.regexp_replace(F.regexp_replace("value", r"\\[\s\S]", ""), '"[^"]*"', "")
    lines = _lines(spark, path).select(
        "file", "block", _stripped(F.col("value")).alias("text"),
        (_many(bare, "{", "[") - _many(bare, "}", "]")).alias("opened"), F.monotonically_increasing_id().alias("at"),
    )
    first = F.min_by(F.struct("text", "opened"), "at").alias("first")
    blocks = lines.where("text <> ''").groupBy("file", "block").agg(F.sum("opened").alias("change"), first)
    blocks = sinks.stored(blocks, "json-blocks")  # a row per split
    files = blocks.groupBy("file").agg(F.sum("change").alias("open"), F.min_by("first", "block").alias("first"))
    begins = F.col("first.text")
    whole = (F.col("first.opened") == 0) & F.coalesce(F.schema_of_variant(F.try_parse_json(begins)).startswith("OBJECT"), F.lit(False))
    nested = F.when(F.col("open") == 0, F.when(begins.startswith("["), ARRAY).otherwise(OBJECT)).otherwise(BROKEN)
    by_bracket = begins.startswith("[") | (begins.startswith("{") & (F.col("open") == 0))
    kind = F.when(whole, LINES).when(by_bracket, nested).otherwise(LINES)
    return files.select("file", kind.alias("kind")), _starts(blocks, "change")


class _JsonCutter:
    """Cuts the objects and arrays at a nesting of ``base`` from the lines of one split."""

    def __init__(self, base: int, start: int):
        self.base, self.depth = base, start
        self.inside = start > base
        self.kind, self.parts = ("middle" if self.inside else "tail"), []

    def feed(self, line: str):
        at = 0
        for found in _STRUCTURE.finditer(line):
            mark = found.group()
            if mark in "{[":
                if self.depth == self.base and not self.inside:
                    self.inside, at = True, found.start()
                self.depth += 1
            elif mark in "}]":
                self.depth -= 1
                if self.inside and self.depth == self.base:
                    self.parts.append(line[at : found.end()])
                    yield ("head" if self.kind == "middle" else "whole"), "".join(self.parts)
                    self.inside, self.kind, self.parts = False, "tail", []
        if self.inside:
            self.parts.append(line[at:] + "\n")

    def rest(self):
        if self.inside:
            yield self.kind, "".join(self.parts)


class _CsvCutter:
    """Cuts rows at line ends outside quotes."""

    def __init__(self, base: int, start: int):
        self.inside = start % 2 == 1
        self.kind, self.parts = ("middle" if self.inside else "tail"), []

    def feed(self, line: str):
        self.parts.append(line)
        self.inside ^= line.count('"') % 2 == 1
        if not self.inside:
            text = "\n".join(self.parts).removesuffix("\r")
            kind = "head" if self.kind == "middle" else "whole"
            self.kind, self.parts = "tail", []
            if kind == "head" or text:
                yield kind, text

    def rest(self):
        if self.inside:
            yield self.kind, "\n".join(self.parts) + "\n"


def _cut(lines: DataFrame, cutter, base: int, starts: DataFrame) -> DataFrame:
    """(file, text): the records of whole files, joined where they span splits.

    ``starts`` has a row per split after a file's first, one for about 100 MB of input, and is sent to the tasks.
    """
    sent: dict[str, dict[int, int]] = {}
    for file, block, start in starts.collect():
        sent.setdefault(file, {})[block] = start

    def run(batches):
        place, cut, out, number = None, None, [], 0

        def row(kind, text):
            nonlocal number
            number += 1
            return (*place, kind, number, text)

        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (file, block):
                    out.extend(row(*r) for r in (cut.rest() if cut else ()))
                    place, cut = (file, block), cutter(base, sent.get(file, {}).get(block, 0))
                out.extend(row(*r) for r in cut.feed(value))
            if out:
                yield _batch(out)
                out = []
        out = [row(*r) for r in (cut.rest() if cut else ())]
        if out:
            yield _batch(out)

    found = sinks.stored(lines.mapInArrow(run, "file string, block long, kind string, number long, text string"), "records")
    whole = found.where("kind = 'whole'").select("file", F.col("block").alias("at"), "number", "text")
    # At most two fragments per split: a head that ends a record, and a tail that begins one.
    pieces = found.where("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("block", "number")
    group = F.sum((F.col("kind") == "tail").cast("int")).over(order)
    joined = pieces.withColumn("record", group).groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "number", "text"))), lambda p: p["text"]), "").alias("text"),
        F.min("block").alias("at"), F.min_by("number", "block").alias("number"),
    )
    return whole.unionByName(joined.select("file", "at", "number", "text"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, ["file", "block", "kind", "number", "text"])


def _cut_files(spark: SparkSession, path: str, files: DataFrame, cutter, base: int, starts: DataFrame) -> DataFrame | None:
    """Records of the listed files; their lines stay in the order of the scan, so the list is sent, in bounded parts."""
    n = files.count()
    if not n:
        return None
    passes = -(-n // MOST_SENT_FILES)
    out = None
    for i in range(passes):
        some = files.where(F.pmod(F.xxhash64("file"), F.lit(passes)) == i).select("file")
        lines = _lines(spark, path).join(F.broadcast(some), "file", "left_semi").select("file", "block", "value")
        part = _cut(lines, cutter, base, starts.join(F.broadcast(some), "file", "left_semi"))
        out = part if out is None else out.unionByName(part)
    return out


def json_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, item) for every JSON object of the files below ``path``, as variants, and (file, error) for every file that
    gives none, because it holds no object or does not close. Files of no bytes are no error.

    A file is an array, one object or several, or one object per line, whatever the other files are. Lines that are not
    JSON and array elements that are not objects are skipped.
    """
    kinds, starts = json_files(spark, path)
    kinds = sinks.stored(kinds, "json-kinds")
    by_line = _lines(spark, path).join(kinds.where(F.col("kind") == LINES), "file", "left_semi").select("file", F.col("value").alias("text"))
    texts = by_line
    for kind, base in ((ARRAY, 1), (OBJECT, 0)):
        cut = _cut_files(spark, path, kinds.where(F.col("kind") == kind), _JsonCutter, base, starts)
        texts = texts if cut is None else texts.unionByName(cut.select("file", "text"))
    items = texts.select("file", F.try_parse_json("text").alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    return items, _silent(spark, path, items, kinds.where(F.col("kind") == BROKEN).select("file", F.lit("does not close").alias("error")))


def _silent(spark: SparkSession, path: str, records: DataFrame, known: DataFrame) -> DataFrame:
    """(file, error) of the files without records; ``known`` has the reason for some. Files of no bytes are not listed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = listed.select(F.col("_metadata.file_path").alias("file"))
    silent = listed.join(records.select("file").distinct(), "file", "left_anti").join(known, "file", "left")
    return silent.select("file", F.coalesce("error", F.lit("holds no record")).alias("error"))


def csv_records(spark: SparkSession, path: str) -> tuple[list[tuple[list[str], DataFrame]], DataFrame]:
    """Tables of the CSV rows below ``path``, one per distinct header as (names, (file, c0, c1 ...)), and (file, error) for
    every file that gives no row or whose last quote does not close.

    Quoted fields may hold commas, doubled quotes and line breaks. The first row of a file is its header.
    """
    quotes = F.sum(_many(F.col("value"), '"')).alias("quotes")
    blocks = sinks.stored(_lines(spark, path).groupBy("file", "block").agg(quotes), "csv-blocks")
    files = blocks.groupBy("file").agg((F.sum("quotes") % 2 == 1).alias("open"))
    files = sinks.stored(files, "csv-files")
    rows = _cut_files(spark, path, files.where(~F.col("open")), _CsvCutter, 0, _starts(blocks, "quotes"))
    broken = files.where("open").select("file", F.lit("has an open quote").alias("error"))
    if rows is None:
        none = spark.createDataFrame([], "file string")
        return [], _silent(spark, path, none, broken)
    rows = rows.withColumn("place", F.struct("at", "number"))
    heads = sinks.stored(rows.groupBy("file").agg(F.min("place").alias("first"), F.min_by("text", "place").alias("header")), "csv-headers")
    bodies = rows.join(heads, "file").where(F.col("place") != F.col("first"))
    tables, every = [], None
    for (header,) in heads.select("header").distinct().orderBy("header").collect():  # few: files of one export share it
        names = next(csv.reader(io.StringIO(header.removeprefix("\ufeff"))))
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = bodies.where(F.col("header") == header).select(
            "file", F.from_csv("text", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("r")
        )
        tables.append((names, parsed.select("file", "r.*")))
        every = parsed.select("file") if every is None else every.unionByName(parsed.select("file"))
    return tables, _silent(spark, path, every, broken)

