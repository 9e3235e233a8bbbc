"""Tables in buckets by key, of which a write replaces only the buckets that it touches.

A table is a folder of bucket folders and of manifests. A manifest is one small file that names the folders of every bucket
at one version. A write adds new folders for the buckets of its keys and then a manifest of the next version; buckets
without such keys keep their folders. Readers take the newest whole manifest, so a write that is killed leaves the table
as it was, and two writers of the same version cannot both succeed. Rows without a key lie in a bucket of their own.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketloom.functions import vectors as V
from ticketloom.sources import sinks

#: Buckets of a new table. A bucket should fit a task; a table of many terabytes takes some ten thousand.
BUCKETS = 32
_BUCKET = "_bucket"
_MANIFEST = "bucket int, path string, key string, buckets int, columns string, batch long"


@dataclass(frozen=True)
class Snapshot:
    """One version of a table: the folders of its buckets."""

    spark: SparkSession
    root: str
    version: int
    key: str
    buckets: int
    schema: StructType
    batch: int
    folders: dict[int, tuple[str, ...]]

    def paths(self, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.root}/{p}" for b in sorted(self.folders) if buckets is None or b in buckets for p in self.folders[b]]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of those named."""
        paths = self.paths(buckets)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows_of(self, keys: list) -> DataFrame:
        """The rows with one of the given keys, from their buckets alone."""
        one = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        buckets = [r[0] for r in one.select(_bucket_of(self.key, self.buckets)).distinct().collect()]
        return self.read(buckets).where(F.col(self.key).isin(*keys))


def _bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a row; that after the last for a row without a key."""
    return F.when(F.col(f"`{key}`").isNull(), buckets).otherwise(F.pmod(F.xxhash64(f"`{key}`"), F.lit(buckets))).cast("int")


def _written(df: DataFrame, root: str, name: str, key: str, buckets: int, *parts: str) -> DataFrame:
    """Writes the rows to folders by ``parts`` and bucket, a bucket in one task, and reads them back."""
    placed = df.withColumn(_BUCKET, _bucket_of(key, buckets))
    # Rows without a key may be many: they are dealt out, not gathered.
    deal = F.when(F.col(_BUCKET) == buckets, F.monotonically_increasing_id()).otherwise(F.col(_BUCKET))
    placed.repartition(deal).write.partitionBy(*parts, _BUCKET).parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(placed.schema).parquet(f"{root}/{name}")


def _folders(written: DataFrame, name: str) -> dict[int, tuple[str, ...]]:
    """The folders that have rows: at most one row per bucket, from the folders' names."""
    return {r[0]: (f"{name}/{_BUCKET}={r[0]}",) for r in written.select(_BUCKET).distinct().collect()}


def _write_buckets(df: DataFrame, root: str, key: str, buckets: int) -> dict[int, tuple[str, ...]]:
    """Writes the rows to new folders and returns those that have rows."""
    name = f"data/{uuid.uuid4().hex}"
    return _folders(_written(df, root, name, key, buckets), name)


def _write_manifest(spark: SparkSession, root: str, version: int, key: str, buckets: int, schema: StructType, batch: int, folders: dict) -> None:
    rows = [(None, None, key, buckets, schema.json(), batch)]
    rows += [(b, p, None, None, None, None) for b, paths in sorted(folders.items()) for p in paths]
    manifest = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
    manifest.write.mode("errorifexists").parquet(f"{root}/manifests/version={version}")


def create(df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> Snapshot:
    """A new table with the rows of ``df``."""
    if _BUCKET in df.columns:
        raise ValueError(f"the column name {_BUCKET} is taken")
    folders = _write_buckets(df, root, key, buckets)
    _write_manifest(df.sparkSession, root, 0, key, buckets, _nullable(df.schema), -1, folders)
    return latest(df.sparkSession, root)


def _nullable(schema: StructType) -> StructType:
    out = StructType.fromJson(schema.jsonValue())
    for field in out.fields:
        field.nullable = True
    return out


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The newest version of a table."""
    manifests = spark.read.schema(f"{_MANIFEST}, version long").parquet(f"{root}/manifests")
    newest = manifests.agg(F.max("version")).first()[0]
    return at_version(spark, root, newest)


def at_version(spark: SparkSession, root: str, version: int) -> Snapshot:
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/version={version}").collect()  # a row per bucket folder
    head = next(r for r in rows if r["bucket"] is None)
    folders: dict[int, tuple[str, ...]] = {}
    for r in sorted((r for r in rows if r["bucket"] is not None), key=lambda r: (r["bucket"], r["path"])):
        folders[r["bucket"]] = (*folders.get(r["bucket"], ()), r["path"])
    schema = StructType.fromJson(json.loads(head["columns"]))
    return Snapshot(spark, root, version, head["key"], head["buckets"], schema, head["batch"], folders)


def _touched(batch: DataFrame, table: Snapshot) -> list[int]:
    """The buckets of the batch's keys; at most one row per bucket comes back."""
    found = batch.where(F.col(f"`{table.key}`").isNotNull()).select(_bucket_of(table.key, table.buckets)).distinct()
    return sorted(r[0] for r in found.collect())


def _next(table: Snapshot, replaced: list[int], fresh: dict, batch_id: int | None) -> Snapshot:
    folders = {b: p for b, p in table.folders.items() if b not in replaced}
    for bucket, paths in fresh.items():
        folders[bucket] = (*folders.get(bucket, ()), *paths)
    number = table.batch if batch_id is None else batch_id
    _write_manifest(table.spark, table.root, table.version + 1, table.key, table.buckets, table.schema, number, folders)
    return at_version(table.spark, table.root, table.version + 1)


def upsert(table: Snapshot, batch: DataFrame, update: list[str], order: Column, batch_id: int | None = None) -> Snapshot:
    """The next version: new keys are added whole, known keys take only the ``update`` columns from the last batch row of
    that key, rows without a key are added.

    Only buckets with a key of the batch are read and written anew. ``batch_id`` numbers the batches of a stream: one that
    the table has seen already changes nothing.
    """
    if batch_id is not None and batch_id <= table.batch:
        return table
    batch = sinks.stored(batch.select(*table.schema.names), "upsert-batch")
    buckets = _touched(batch, table)
    keyed = F.col(f"`{table.key}`").isNotNull()
    merged = sinks.upsert(table.read(buckets), batch.where(keyed), table.key, update, order)
    return _next(table, buckets, _write_buckets(merged.unionByName(batch.where(~keyed)), table.root, table.key, table.buckets), batch_id)


def insert_new(table: Snapshot, batch: DataFrame, order: Column, batch_id: int | None = None) -> Snapshot:
    """The next version with the first batch row of every key that the table lacks, and all rows without a key. Nothing is
    rewritten: the rows go to additional folders; only the buckets of the batch's keys are read for their keys."""
    if batch_id is not None and batch_id <= table.batch:
        return table
    batch = sinks.stored(batch.select(*table.schema.names), "insert-batch")
    known = table.read(_touched(batch, table))
    fresh = sinks.insert_or_ignore(known, batch, table.key, order)
    return _next(table, [], _write_buckets(fresh, table.root, table.key, table.buckets), batch_id)


def insert_checked(table: Snapshot, batch: DataFrame, order: Column, rules: dict[str, Column]) -> tuple[Snapshot, dict[str, int]]:
    """``insert_new`` of the rows that meet every rule, and counts from the same write: total, inserted, skipped (known or
    repeated keys), errors (rows that break a rule), and the rows that break each rule.

    A rule that gives NULL is broken. Of a key's rows without errors the first counts. Skipped keys and errors are written
    beside the table, in folders that no manifest names, so that a task that runs again is counted once; the counts read
    marks alone.
    """
    key, names = table.key, table.schema.names
    broken = [(~F.coalesce(rule, F.lit(False))).alias(f"_broken_{i}") for i, rule in enumerate(rules.values())]
    marks = [f"_broken_{i}" for i in range(len(broken))]
    batch = sinks.stored(batch.select(*names, *broken), "insert-batch")
    wrong = functools.reduce(operator.or_, [F.col(m) for m in marks], F.lit(False))
    right = batch.where(~wrong)
    keyed = right.where(F.col(f"`{key}`").isNotNull())
    rest = [c for c in names if c != key]
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"), F.count(F.lit(1)).alias("_n"))
    known = table.read(_touched(batch, table)).select(key).distinct().withColumn("_known", F.lit(True))
    met = first.join(known, key, "left").select(
        key, *[F.col(f"_row.{c}").alias(c) for c in rest], "_n", F.col("_known").isNull().alias("_fresh")
    )
    loose = right.where(F.col(f"`{key}`").isNull()).select(*names, F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_fresh"))
    errors = batch.where(wrong).select(*names, F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_fresh"), *marks)
    rows = met.unionByName(loose).unionByName(errors, allowMissingColumns=True)
    name = f"data/{uuid.uuid4().hex}"
    written = _written(rows.withColumn("_fresh", F.col("_fresh").cast("int")), table.root, name, key, table.buckets, "_fresh")
    lost = functools.reduce(operator.or_, [F.coalesce(m, F.lit(False)) for m in marks], F.lit(False))
    counts = {
        "total": F.sum("_n"), "inserted": F.count_if(F.col("_fresh") == 1), "errors": F.count_if(lost),
        **{f"broken {name}": F.count_if(m) for name, m in zip(rules, marks)},
    }
    columns = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()]
    found = written.agg(*columns).first().asDict()
    after = _next(table, [], _folders(written.where("_fresh = 1"), f"{name}/_fresh=1"), None)
    found["skipped"] = found["total"] - found["inserted"] - found["errors"]
    return after, found


def replace_children(table: Snapshot, fresh: DataFrame, batch_id: int | None = None) -> Snapshot:
    """The next version with all rows of the touched keys replaced by the fresh ones; other buckets stay."""
    if batch_id is not None and batch_id <= table.batch:
        return table
    fresh = sinks.stored(fresh.select(*table.schema.names), "fresh-children")
    buckets = _touched(fresh, table)
    merged = sinks.replace_children(table.read(buckets), fresh, table.key)
    return _next(table, buckets, _write_buckets(merged, table.root, table.key, table.buckets), batch_id)


def apply_changes(table: Snapshot, fresh: DataFrame, gone: DataFrame, batch_id: int | None = None) -> Snapshot:
    """The next version with the ``fresh`` rows in place of those with their keys, and without the keys in ``gone``. Keys are
    not NULL and fresh ones not repeated; buckets without any of them stay."""
    if batch_id is not None and batch_id <= table.batch:
        return table
    key = table.key
    fresh = sinks.stored(fresh.select(*table.schema.names), "fresh-rows")
    gone = sinks.stored(gone.select(key), "gone-keys")
    changed = fresh.select(key).unionByName(gone)
    buckets = _touched(changed, table)
    merged = table.read(buckets).join(changed, key, "left_anti").select(*table.schema.names).unionByName(fresh)
    return _next(table, buckets, _write_buckets(merged, table.root, key, table.buckets), batch_id)


def compact(table: Snapshot) -> Snapshot:
    """The next version with one folder per bucket, where inserts have left several."""
    many = sorted(b for b, paths in table.folders.items() if len(paths) > 1)
    return _next(table, many, _write_buckets(table.read(many), table.root, table.key, table.buckets), None) if many else table


def upsert_articles(table: Snapshot, batch: DataFrame, order: Column) -> Snapshot:
    """Articles by external id: category, tags, author and source keep their old values."""
    return upsert(table, batch, [c for c in sinks.ARTICLE_UPDATES if c in table.schema.names], order)


def upsert_predictions(table: Snapshot, batch: DataFrame, order: Column, batch_id: int | None = None) -> Snapshot:
    """Predictions by ticket id; a ticket seen for the first time is open."""
    opened = batch if "status" in batch.columns else batch.withColumn("status", F.lit("open"))
    return upsert(table, opened, [c for c in sinks.PREDICTION_UPDATES if c in table.schema.names], order, batch_id)


def upsert_vectors(table: Snapshot, batch: DataFrame, order: Column) -> Snapshot:
    """Vectors by point id, the original id kept: (id, original_id, embedding)."""
    points = batch.withColumn("id", V.point_id(F.col("original_id").cast("string")))
    return upsert(table, points, ["original_id", "embedding"], order)
