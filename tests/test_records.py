"""Records that lie across lines and splits, and files that cannot be read."""

import csv
import io
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticketloom.sources import readers, records

TICKETS = [
    {"id": f"t{i}", "subject": f'say "{i}" {{[', "body": "line\nbreak, " * (i % 5) + "]}" + "ü" * (i % 3), "meta": {"a": [1, {"b": i}]}}
    for i in range(300)
]


@pytest.fixture()
def small_splits(spark):
    """Splits of 700 bytes, so that records span them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("700", "0")):
        spark.conf.set(n, value)
    yield
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def ids(tickets):
    return sorted((r["external_id"], r["subject"], r["body"]) for r in tickets.collect())


def want(rows):
    return sorted((t["id"], t["subject"], t["body"].strip()) for t in rows)


def test_json_kinds_side_by_side(spark, tmp_path, small_splits):
    parts = [TICKETS[i::5] for i in range(5)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text(json.dumps(parts[0], indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, parts[1])) + "\n{not json\n[1]\n")
    (tmp_path / "deep" / "c.json").write_text("\r\n\n" + "\n".join(json.dumps(t, indent=1) for t in parts[2]))
    (tmp_path / "d.json").write_text(json.dumps(parts[3]))
    (tmp_path / "e.json").write_text("[\n" + ",\n".join(map(json.dumps, parts[4])) + ", 5, [1], null\n]\n")
    (tmp_path / "open.json").write_text('[{"id": "lost", "subject": "x"},\n{"id": "lost"')
    (tmp_path / "text.json").write_text("no json at all\n")
    (tmp_path / "none.json").write_text("")
    tickets, errors = readers.scan_ticket_json(spark, str(tmp_path))
    assert ids(tickets) == want(TICKETS)
    found = {r["file"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()}
    assert found == {"open.json": "does not close", "text.json": "holds no record"}


def test_samples_and_relevance_decide_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"samples": [{"q": "1"}, {"q": "2"}]}, indent=2))
    (tmp_path / "b.json").write_text('{"samples": [{"q": "3"}]}\n{"samples": [{"q": "4"}]}\n')
    assert sorted(r["q"] for r in readers.read_samples(spark, str(tmp_path), "samples").collect()) == ["1", "2", "3", "4"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps([{"query": "x", "relevant_docs": ["1"]}], indent=1))
    (tmp_path / "r" / "b.json").write_text('{"query": "y", "relevant_docs": ["2", "3"]}')
    got = readers.read_relevance(spark, str(tmp_path / "r")).collect()
    assert sorted(map(tuple, got)) == [("x", "1"), ("y", "2"), ("y", "3")]


def written(rows, names):
    out = io.StringIO()
    writer = csv.DictWriter(out, names, lineterminator="\r\n", extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def test_csv_files(spark, tmp_path, small_splits):
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        f.write(written(TICKETS[:200], ["id", "subject", "body"]))
    with open(tmp_path / "b.csv", "w", newline="", encoding="utf-8") as f:
        f.write(written([{"Body": t["body"], "ID": t["id"], "Subject": t["subject"], "id": ""} for t in TICKETS[200:]], ["Body", "ID", "id", "Subject"]))
    (tmp_path / "open.csv").write_text('id,subject\nlost,"never closed\nlost,too\n')
    (tmp_path / "head.csv").write_text("id,subject\n")
    (tmp_path / "none.csv").write_text("")
    tickets, errors = readers.scan_ticket_csv(spark, str(tmp_path))
    assert ids(tickets) == want(TICKETS)
    found = {r["file"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()}
    assert found == {"open.csv": "has an open quote", "head.csv": "holds no record"}


def test_nothing_to_read(spark, tmp_path):
    for scan, name in ((readers.scan_ticket_json, "x.json"), (readers.scan_ticket_csv, "x.csv")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_text("")
        tickets, errors = scan(spark, str(folder))
        assert tickets.collect() == [] and errors.count() == 0
        (folder / "blank").write_text("\n \n")
        tickets, errors = scan(spark, str(folder))
        assert tickets.collect() == [] and errors.count() == 1


def pieces(cutter, base, lines, cuts):
    """Records of the lines, dealt to splits that begin at ``cuts``, stitched as the scan does."""
    out, held, state = [], "", 0
    for a, b in zip([0, *cuts], [*cuts, len(lines)]):
        cut = cutter(base, state)
        found = [r for line in lines[a:b] for r in cut.feed(line)] + list(cut.rest())
        for kind, text in found:
            if kind == "whole":
                out.append(text)
            else:
                held += text
                if kind == "head":
                    out.append(held)
                    held = ""
        for line in lines[a:b]:
            state += line.count('"') if cutter is records._CsvCutter else sum(
                (m in "{[") - (m in "}]") for m in records._STRUCTURE.findall(line)
            )
    assert held == ""
    return out


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.recursive(st.text(max_size=6) | st.integers(), lambda x: st.dictionaries(st.text(max_size=3), x, max_size=3) | st.lists(x, max_size=3), max_leaves=6), max_size=6), st.integers(0, 2**32))
def test_json_cuts_anywhere(items, seed):
    lines = json.dumps(items, indent=1).split("\n")
    cuts = sorted(random.Random(seed).sample(range(1, len(lines)), k=min(4, len(lines) - 1))) if len(lines) > 1 else []
    got = [json.loads(t) for t in pieces(records._JsonCutter, 1, lines, cuts)]
    assert got == [i for i in items if isinstance(i, (dict, list))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a",\n ', max_size=6), min_size=2, max_size=3), max_size=8), st.integers(0, 2**32))
def test_csv_cuts_anywhere(rows, seed):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    lines = out.getvalue().removesuffix("\n").split("\n") if rows else []
    cuts = sorted(random.Random(seed).sample(range(1, len(lines)), k=min(4, len(lines) - 1))) if len(lines) > 1 else []
    got = [next(csv.reader(io.StringIO(t))) for t in pieces(records._CsvCutter, 0, lines, cuts)]
    assert got == rows


def test_articles_below_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.md").write_text("---\ncategory: x\n---\n# First\n\nText ü", encoding="utf-8")
    (tmp_path / "a" / "b" / "two-words.md").write_text("plain")
    (tmp_path / "a" / "latin.md").write_bytes("schön".encode("latin-1"))
    (tmp_path / "a" / "b" / "blank.md").write_text(" ")
    (tmp_path / "a" / "note.txt").write_text("# no")
    articles, errors = readers.scan_articles(spark, str(tmp_path))
    assert sorted((r["title"], r["category"]) for r in articles.collect()) == [("First", "x"), ("Two Words", None)]
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()} == {"latin.md": "is not UTF-8", "blank.md": "is empty"}
