import random

import pytest

from tests import oracle
from ticketloom.llm import quotations
from ticketloom.llm.queries import OP7_SQL, op7_quotations

SCHEMA = "conv_id long, turn long, role string, text string, parent string"


def answer(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return quotations.conversations(df, "conv_id", "turn", "role", "text").collect()


@pytest.mark.parametrize("line, level, rest", [
    ("> a", 1, "a"), (">> b", 2, "b"), ("> > c > d", 2, "c > d"), ("e > f", 0, "e > f"), ("  > g", 1, "g"), (">", 1, ""),
])
def test_levels(line, level, rest):
    assert quotations.quote_level(line) == (level, rest)


def test_parse():
    text = "Hello.\n\nOn Monday, Ann wrote:\n> Sure.\n> Ben wrote:\n>> Can we\n>> meet?\n> Fine.\nSee you."
    assert quotations.parse(text) == ("Hello.\nSee you.", [(1, "Sure."), (2, "Can we\nmeet?"), (1, "Fine.")])
    assert quotations.parse("> only") == ("", [(1, "only")])
    assert quotations.parse("") == ("", [])


def test_nested_replies_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the station? I am lost here."),
        (1, 1, "assistant", "It is north of you. Take bus nine."),
        (1, 2, "user", "A wrote:\n> It is north of\n> you. Take bus\n> nine.\n>> Where is the station?\nThank you, I will."),
        (1, 3, "user", "> I am lost here.\nAnother thought on that."),
        (1, 4, "assistant", "> Thank you, I will.\nWelcome."),
        (2, 7, "user", "> It is north of you.\nNot said in this conversation."),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in answer(spark, rows)}
    links = {k: (r["parent_turn"], r["root_turn"], r["depth"], r["body"]) for k, r in got.items()}
    assert links == {
        (1, 0): (None, 0, 0, rows[0][3]),
        (1, 1): (None, 1, 0, rows[1][3]),
        (1, 2): (1, 1, 1, "Thank you, I will."),
        (1, 3): (0, 0, 1, "Another thought on that."),
        (1, 4): (2, 1, 2, "Welcome."),
        (2, 7): (None, 7, 0, "Not said in this conversation."),
    }
    assert got[1, 4]["formatted"] == "<|assistant|>\nWelcome.\n" and got[1, 2]["n_quotes"] == 2


def test_derived_threads(spark, folder):
    """Messages of the given table, each quoting a random earlier one of its conversation and all that one quotes."""
    rng, rows, parents, depth = random.Random(4), [], {}, {}
    given = spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect()
    texts, firsts = {}, {}
    for m in given:
        own = f"{m['text']} Message {m['conv_id']} {m['turn']}."
        for sentence in quotations.sentences(own):
            firsts.setdefault((m["conv_id"], sentence), m["turn"])
        earlier = [t for c, t in texts if c == m["conv_id"]]
        text, parent = own, None
        if earlier and rng.random() < 0.8:
            parent = rng.choice(earlier)
            quoted = "\n".join(f"> {line}" for line in texts[m["conv_id"], parent].split("\n"))
            text = f"Someone wrote:\n{quoted}\n{own}"
        texts[m["conv_id"], m["turn"]] = text
        key = (m["conv_id"], m["turn"])
        parents[key], depth[key] = parent, 0 if parent is None else depth[m["conv_id"], parent] + 1
        rows.append((*key, m["role"], text))
    got = {(r["conv_id"], r["turn"]): r for r in answer(spark, rows)}
    assert {k: r["parent_turn"] for k, r in got.items()} == parents
    assert {k: r["depth"] for k, r in got.items()} == depth
    assert max(depth.values()) >= 3


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "Same line."), (1, 0, "user", "Same line."), (1, 1, None, "> Same line.\nYes."), (1, 2, "user", None), (1, 3, "user", ""),
        (None, 4, "user", "> Same line."), (1, None, "user", "> Same line."), (1, 5, "user", "> " * 3_000 + "deep\nok"),
        (1, 6, "user", "> Same line.\n" * 20_000), (1, 7, "user", "> Same line.\nSame line."), (1, 8, "user", "> \n>\nfine"),
    ]
    got = answer(spark, rows)
    assert len(got) == len(rows)
    parents = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in got}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): None, (None, 4): None, (1, None): None, (1, 5): None, (1, 6): 0, (1, 7): 0, (1, 8): None}
    assert answer(spark, []) == []


def test_query(spark, folder):
    found = op7_quotations(spark, folder)
    assert oracle.difference(found, oracle.connect(folder), OP7_SQL) is None
    depths = [r["depth"] for r in found.collect()]
    assert max(depths) >= 2 and sum(d > 0 for d in depths) > len(depths) / 3


def test_plain_messages_stay_as_they_are(spark, folder):
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = quotations.conversations(given, "conv_id", "turn", "role", "text").collect()
    assert sorted((r["conv_id"], r["turn"], r["body"]) for r in rows) == sorted((m["conv_id"], m["turn"], m["text"].strip()) for m in given.collect())


def brute_assembled(rows, most):
    """(conv, root, part) -> turns and text, from per-message rows."""
    threads = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["root_turn"], r["turn"], r["role"] or "", r["body"])):
        threads.setdefault((r["conv_id"], r["root_turn"]), []).append(r)
    return {
        (*key, at // most): ([m["turn"] for m in t[at : at + most]], "".join(m["formatted"] for m in t[at : at + most]))
        for key, t in threads.items()
        for at in range(0, len(t), most)
    }


def test_positions_and_assembled_conversations(spark):
    """One conversation holds most messages, in a long thread over many partitions."""
    rng, rows, said = random.Random(5), [], {}
    for conv, n in ((1, 400), *((c, 6) for c in range(2, 20))):
        for turn in range(n):
            own = f"Words {conv} {turn} here."
            parent = rng.randrange(turn) if turn and rng.random() < 0.97 else None
            rows.append((conv, turn, rng.choice(["user", "assistant"]), own if parent is None else f"> {said[conv, parent]}\n{own}"))
            said[conv, turn] = own
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        messages = quotations.conversations(df, "conv_id", "turn", "role", "text").cache()
        got = messages.collect()
        built = quotations.assembled(messages, "conv_id", "turn", most=25).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    threads = {}
    for r in got:
        threads.setdefault((r["conv_id"], r["root_turn"]), []).append((r["position"], r["turn"]))
        assert r["body"] == said[r["conv_id"], r["turn"]]
    for t in threads.values():
        assert sorted(t) == list(enumerate(sorted(turn for _, turn in t)))
    assert max(map(len, threads.values())) > 100
    want = brute_assembled(got, 25)
    assert {(r["conv_id"], r["root_turn"], r["part"]): ([m["turn"] for m in r["messages"]], r["text"]) for r in built} == want
    assert all(r["n_messages"] == len(r["messages"]) <= 25 for r in built)
    place = {(r["conv_id"], r["turn"]): r["position"] for r in got}
    assert all(place[r["conv_id"], r["parent_turn"]] < r["position"] for r in got if r["parent_turn"] is not None)
