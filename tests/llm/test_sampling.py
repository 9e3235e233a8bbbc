from pyspark.sql import functions as F

from ticketloom.llm import sampling


def drawn(spark, rows, limit, weigh=True):
    df = spark.createDataFrame([(k, c, "x" * n) for k, c, n in rows], "key string, label string, text string")
    out = sampling.per_class(df, "label", "key", limit, F.octet_length("text") if weigh else None).collect()
    found = {}
    for r in out:
        found.setdefault(r["label"], []).append(len(r["text"]))
    return found


def test_no_class_is_lost(spark):
    """One text of 2 MB, three of 400 KB, thirty small ones beside one of 2 MB: whatever the keys, each class is drawn."""
    for salt in range(6):
        rows = [(f"{salt}e{i}", "en", 1_000) for i in range(400)] + [(f"{salt}d", "de", 2_000_000)]
        rows += [(f"{salt}f{i}", "fr", 400_000) for i in range(3)] + [(f"{salt}s{i}", "es", 3_000) for i in range(30)] + [(f"{salt}S", "es", 2_000_000)]
        got = drawn(spark, rows, 100_000)
        assert got["de"] == [2_000_000] and got["fr"] == [400_000] * 3
        assert len(got["es"]) >= 20 and 50 <= len(got["en"]) <= 160


def test_counts(spark):
    rows = [(f"k{i}", "a" if i % 10 else "b", 1) for i in range(5_000)] + [("one", "c", 1), ("none", None, 1)]
    got = drawn(spark, rows, 600, weigh=False)
    assert 500 <= len(got["a"]) <= 700 and len(got["b"]) == 500 and len(got["c"]) == 1 and None not in got
