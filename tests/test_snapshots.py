"""Bucketed tables against their batch rules, and what a write leaves alone."""

import uuid

import pytest
from pyspark.sql import functions as F

from ticketloom.session import shared_folder
from ticketloom.sources import sinks, snapshots

SCHEMA = "k string, a string, n int"


@pytest.fixture()
def root(spark):
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


STORED = [(f"k{i}", "old", i) for i in range(200)] + [(None, "old", -1), (None, "old", -1)]
BATCH = [("k7", "new", 1), ("k7", "newer", 2), ("k8", "new", 3), ("x", "new", 4), (None, "new", 5)]


def test_upsert_rewrites_only_touched_buckets(spark, root):
    table = snapshots.create(frame(spark, STORED), root, "k", 16)
    assert rows(table.read()) == sorted(STORED, key=repr) and table.version == 0
    batch = frame(spark, BATCH)
    after = snapshots.upsert(table, batch, ["a"], F.col("n"))
    want = sinks.upsert(frame(spark, STORED), batch, "k", ["a"], F.col("n"))
    assert rows(after.read()) == rows(want) and after.version == 1
    assert ("k7", "newer", 7) in rows(after.read())
    touched = {b for b in table.folders if after.folders[b] != table.folders[b]}
    assert len(touched) <= 4 and 16 in touched  # the buckets of k7, k8 and x, and that of rows without a key
    assert set(after.folders[16]) > set(table.folders[16])  # which were added, not rewritten
    assert rows(table.read()) == sorted(STORED, key=repr)  # the old version is still whole


def test_inserts_add_folders(spark, root):
    table = snapshots.create(frame(spark, STORED), root, "k", 8)
    after = snapshots.insert_new(table, frame(spark, BATCH), F.col("n"))
    assert rows(after.read()) == sorted([*STORED, ("x", "new", 4), (None, "new", 5)], key=repr)
    assert all(set(table.folders[b]) <= set(after.folders[b]) for b in table.folders)
    packed = snapshots.compact(after)
    assert rows(packed.read()) == rows(after.read()) and all(len(p) == 1 for p in packed.folders.values())


def test_children_are_replaced(spark, root):
    table = snapshots.create(frame(spark, [("a", "x", 1), ("a", "x", 2), ("b", "x", 1), (None, "x", 0)]), root, "k", 4)
    after = snapshots.replace_children(table, frame(spark, [("a", "y", 9), ("c", "y", 1)]))
    assert rows(after.read()) == sorted([("a", "y", 9), ("b", "x", 1), ("c", "y", 1), (None, "x", 0)], key=repr)


def test_rows_of_reads_their_buckets(spark, root):
    table = snapshots.create(frame(spark, STORED), root, "k", 16)
    found = table.rows_of(["k7", "nobody"])
    assert rows(found) == [("k7", "old", 7)]
    assert len({f.rsplit("/", 2)[-2] for f in found.inputFiles()}) <= 2


def test_a_killed_write_leaves_the_table(spark, root):
    table = snapshots.create(frame(spark, STORED), root, "k", 4)
    snapshots._write_buckets(frame(spark, BATCH), root, "k", 4)  # new folders, no manifest
    assert rows(snapshots.latest(spark, root).read()) == sorted(STORED, key=repr)
    snapshots.upsert(table, frame(spark, BATCH[:1]), ["a"], F.col("n"))
    with pytest.raises(Exception, match="(?i)exists"):  # a second writer of the same version
        snapshots.upsert(table, frame(spark, BATCH[2:3]), ["a"], F.col("n"))
    assert ("k7", "new", 7) in rows(snapshots.latest(spark, root).read())
    assert ("k8", "old", 8) in rows(snapshots.latest(spark, root).read())


def test_a_repeated_batch_changes_nothing(spark, root):
    table = snapshots.create(frame(spark, STORED), root, "k", 4)
    once = snapshots.upsert(table, frame(spark, BATCH), ["a"], F.col("n"), batch_id=0)
    assert snapshots.upsert(once, frame(spark, BATCH), ["a"], F.col("n"), batch_id=0) is once
    assert snapshots.latest(spark, root).batch == 0


def test_empty_table_and_taken_name(spark, root):
    table = snapshots.create(frame(spark, []), root, "k", 4)
    assert rows(table.read()) == []
    after = snapshots.upsert(table, frame(spark, BATCH), ["a"], F.col("n"))
    assert rows(after.read()) == sorted([("k7", "newer", 2), ("k8", "new", 3), ("x", "new", 4), (None, "new", 5)], key=repr)
    same = snapshots.upsert(after, frame(spark, []), ["a"], F.col("n"))
    assert same.folders == after.folders
    with pytest.raises(ValueError):
        snapshots.create(frame(spark, []).withColumn("_bucket", F.lit(1)), root + "x", "k")


def test_counts_while_writing(spark, root):
    table = snapshots.create(frame(spark, STORED), root, "k", 8)
    batch = [*BATCH, ("k9", "bad", 900), ("y", None, 5), ("y", "good", 6), (None, "bad", 901), ("z", "bad", None)]
    rules = {"small": F.col("n") < 100, "named": F.col("a").isNotNull()}
    after, counts = snapshots.insert_checked(table, frame(spark, batch), F.col("n"), rules)
    assert rows(after.read()) == sorted([*STORED, ("x", "new", 4), ("y", "good", 6), (None, "new", 5)], key=repr)
    # Skipped are both rows of k7 and that of k8.
    assert counts == {"total": 10, "inserted": 3, "skipped": 3, "errors": 4, "broken small": 3, "broken named": 1}
    _, none = snapshots.insert_checked(after, frame(spark, []), F.col("n"), rules)
    assert set(none.values()) == {0}


def test_changes_are_applied(spark, root):
    table = snapshots.create(frame(spark, STORED[:200]), root, "k", 16)
    gone = spark.createDataFrame([("k3",), ("nobody",)], "k string")
    after = snapshots.apply_changes(table, frame(spark, [("k7", "new", 1), ("x", "new", 2)]), gone)
    kept = [r for r in STORED[:200] if r[0] not in ("k3", "k7")]
    assert rows(after.read()) == sorted([*kept, ("k7", "new", 1), ("x", "new", 2)], key=repr)
    assert sum(after.folders.get(b) == p for b, p in table.folders.items()) >= 12


def test_refresh_encodes_only_changes(spark, root):
    from ticketloom.operators import chunk_index, dense

    texts = {f"c{i}": f"chunk number {i} of words" for i in range(120)} | {"empty": ""}
    chunks = lambda given: spark.createDataFrame(list(given.items()), "chunk_id string, content string")
    table = chunk_index.build(chunks(texts), root, buckets=16)
    now = {k: (t + " changed" if k in ("c5", "c50") else t) for k, t in texts.items() if k not in ("c7", "empty")} | {"new": "fresh", "none": None}
    seen = spark.sparkContext.accumulator(0)

    def counting(tokens):
        seen.add(len(tokens))
        return dense.hashed_tf_encoder()(tokens)

    after, counts = chunk_index.refresh(table, chunks(now), encoder=counting)
    assert counts == {"encoded": 4, "removed": 2, "kept": 117} and seen.value == 4
    whole = chunk_index.build(chunks(now), root + "-whole", buckets=16)
    plain = lambda t: sorted((r["chunk_id"], r["content_hash"], list(r["embedding"])) for r in t.read().collect())
    assert plain(after) == plain(whole)
    assert {r["chunk_id"] for r in after.read().where("refresh = 1").collect()} == {"c5", "c50", "new", "none"}
    assert sum(after.folders.get(b) == p for b, p in table.folders.items()) >= 8
    same, counts = chunk_index.refresh(after, chunks(now))
    assert same is after and counts == {"encoded": 0, "removed": 0, "kept": 121}
