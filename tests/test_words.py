"""Stems and edit distances."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketloom.functions import edits, normalize, stemming

# Pairs of the published sample vocabulary.
PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
generate generat generously generous communication communic community communiti arsenal arsenal skies sky dying die
succeed succeed herrings herring hopping hop hoping hope happily happili cries cri ties tie gas gas gaps gap kiwis kiwi
bed bed shed shed luxuriating luxuri rational ration relational relat vietnamization vietnam hopefulness hope sky sky
youth youth boyish boyish say say enjoy enjoy flying fli it it 's 's o'neill's o'neil
""".split()


@pytest.mark.parametrize("word, stem", list(zip(PAIRS[::2], PAIRS[1::2])))
def test_stems(word, stem):
    assert stemming.stem(word) == stem


def test_stemmed_tokens(spark):
    rows = [(1, ["running", "Ünder", "naïvely", "running", "x1s", ""]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "i int, tokens array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", stemming.stems(F.col("tokens")).alias("s")).collect()}
    assert got == {1: ["run", "Ünder", "naïvely", "run", "x1s", ""], 2: [], 3: None}


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abü日\U0001f600", max_size=14), st.text(alphabet="abü日\U0001f600", max_size=14))
def test_edit_distance(a, b):
    assert edits.distance(a, b) == table_distance(a, b)


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="abcdefgh ", min_size=60, max_size=200), st.text(alphabet="abcdefgh ", min_size=60, max_size=200))
def test_edit_distance_beyond_a_word(a, b):
    assert edits.distance(a, b) == table_distance(a, b)


def test_distance_columns(spark):
    rows = [("kitten", "sitting"), ("", "äöü"), ("same", "same"), (None, "x"), ("x", None), ("日本語", "日本"), ("a" * 3_000, "b" * 2_000)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in df.select(edits.edit_distance(F.col("a"), F.col("b")), normalize.modification_share(F.col("a"), F.col("b"))).collect()]
    assert [d for d, _ in got] == [3, 3, 0, None, None, 1, 3_000]
    assert [None if s is None else round(s, 6) for _, s in got] == [0.428571, 1.0, 0.0, None, None, 0.333333, 1.0]
