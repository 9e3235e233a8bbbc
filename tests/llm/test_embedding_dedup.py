import numpy as np
import pytest

from ticketloom.llm import embedding_dedup, tiles
from ticketloom.llm.queries import op1_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, component long, n string"


def brute(rows, threshold=0.93):
    usable = {}
    for i, (key, vector, label, *_) in enumerate(rows):
        if key is None or label is None or not vector or any(v is None or not np.isfinite(v) for v in vector):
            continue
        x = np.array(vector, dtype=np.float32).astype(np.float64)
        if np.linalg.norm(x) > 0:
            usable[i] = (x / np.linalg.norm(x), label)
    links = {i: set() for i in range(len(rows))}
    for i, (x, a) in usable.items():
        for j, (y, b) in usable.items():
            if i != j and a == b and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
    out = []
    for i, (key, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = None if key is None else min(rows[j][0] for j in seen)
        out.append((key, len(links[i]), low, key is not None and key == low))
    return sorted(out, key=repr)


def answer(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, embedding_dedup.linked_vectors(df, "vec_id", "embedding", "label").collect()), key=repr)


def vectors(rng, n, size, labels):
    centres = rng.normal(size=(max(1, n // 6), size))
    for i in range(n):
        x = centres[rng.integers(len(centres))] + rng.normal(size=size) * rng.choice([0.05, 0.2, 0.35, 2])
        yield (int(i * 3 % n if i % 2 else i * 7 + 1000), [float(v) for v in x.astype(np.float32)], int(rng.integers(labels)))


@pytest.mark.parametrize("size, labels", [(64, 2), (5, 1), (24, 3)])
def test_against_all_pairs(spark, size, labels):
    rows = list({r[0]: r for r in vectors(np.random.default_rng(size), 220, size, labels)}.values())
    assert answer(spark, rows) == brute(rows)


def test_chunked_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_CHUNK", 15)
    rows = list({r[0]: r for r in vectors(np.random.default_rng(1), 150, 16, 1)}.values())
    assert answer(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    one, near = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    rows = [
        (5, one, 1), (4, near, 1), (3, one, None), (2, None, 1), (1, [0.0, 0.0, 0.0], 1), (6, [], 1), (7, [1.0, None, 0.0], 1),
        (8, [float("nan"), 1.0, 0.0], 1), (9, [float("inf"), 1.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, one, 2), (None, one, 1),
        (12, [3.0, 0.0, 0.0], 1), (13, [-1.0, 0.0, 0.0], 1), (14, one, 1),
    ]
    assert answer(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, op1_embedding_dedup(spark, folder).collect()), key=repr) == brute(rows)


def test_every_pair_meets_once(spark):
    rows = [(i, "g", i % 3) for i in range(40)]
    dealt = tiles.tiled(spark.createDataFrame(rows, "id long, g string, cell long"), ["g"], "id", 7).collect()
    met = {}
    for x in dealt:
        for y in dealt:
            same = (x.cell, x.low, x.high) == (y.cell, y.low, y.high)
            if same and x.id < y.id and (x.own or y.own) and (x.low == x.high or x.chunk != y.chunk):
                met[x.id, y.id] = met.get((x.id, y.id), 0) + 1
    cells = {i: c for i, _, c in rows}
    want = {(i, j) for i in cells for j in cells if i < j and abs(cells[i] - cells[j]) <= 1}
    assert set(met) == want and set(met.values()) == {1}


def test_extreme_sizes(spark):
    rows = [(1, [1e-170, 2e-170], 0), (2, [1e-170, 2e-170], 0), (3, [1e200, 2e200], 0), (4, [2e200, 4e200], 0), (5, [1.0, 2.0], 0),
            (6, [5e-324, 0.0], 0), (7, [1.7e308, 1e-300], 0), (8, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.linked_vectors(df, "vec_id", "embedding", "label").collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (1, 6), 7: (1, 6), 8: (0, 8)}
