import zlib

import numpy as np

from ticketloom.llm import language_id
from ticketloom.llm.queries import op2_language_id

LINES = {
    "en": "the quick brown fox jumps over the lazy dog and then this one thinks that those were there",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann sagt er nichts mehr dazu",
    "fr": "le renard brun saute par-dessus le chien paresseux et puis il ne dit plus rien à propos de ça",
}


def teaching(documents):
    rows = [(n, " ".join(np.random.default_rng(n).permutation(LINES[lang].split())), lang)
            for n, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34", "fr"), (903, LINES["en"], None), (None, LINES["de"], "fr")]
    return documents(rows, extra=True)


def test_windows_cover_whole_texts():
    text = "Ab1é" * 400
    windows = language_id.windows_of(text)
    flat = windows.reshape(-1)
    raw = "ab é".encode() * 400
    assert flat[: len(raw)].tobytes() == raw and not flat[len(raw) :].any()


def test_learned_languages(documents):
    net = language_id.learn(teaching(documents), epochs=60)
    assert net.languages == ["de", "en", "fr"]
    rows = [(1, LINES["en"]), (2, LINES["de"].upper()), (3, LINES["fr"]), (4, None), (5, ""), (6, "12 !? 34 ²½"), (None, LINES["fr"]),
            (7, (LINES["de"] + " ") * 3_000), (7, LINES["en"])]
    got = language_id.predict(documents(rows, extra=True), "doc_id", "text", net).collect()
    want = [(1, "en"), (2, "de"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (None, "fr"), (7, "de"), (7, "en")]
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") for r in got)


def test_batched_votes_match_single_texts(documents):
    net = language_id.learn(teaching(documents), epochs=2)
    rows = [(i, LINES["en"] * (1 + i % 5)) for i in range(60)]
    for r in language_id.predict(documents(rows), "doc_id", "text", net).collect():
        names, scores = ["und"], [0.0]
        language_id._vote(net, [0], [language_id.windows_of(rows[r["doc_id"]][1])], names, scores)
        assert r["lang_pred"] == names[0] and abs(r["score"] - scores[0]) < 1e-5


def test_nothing_to_learn(documents):
    assert language_id.learn(documents([])) is None
    got = language_id.predict(documents([(1, "text")]), "doc_id", "text", None).collect()
    assert [tuple(r) for r in got] == [(1, "und", 0.0)]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op2_language_id(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_short_and_single_texts_teach(documents):
    """A language of short texts, and one of a single long text, beside languages of long ones."""
    rows = [(n, " ".join(np.random.default_rng(n).permutation((LINES["en"] + " ") .split() * 20)), "en") for n in range(60)]
    rows += [(1_000 + n, " ".join(LINES["fr"].split()[n % 8 : n % 8 + 4]), "fr") for n in range(200)]
    rows += [(5_000, (LINES["de"] + " ") * 20_000, "de")]
    net = language_id.learn(documents(rows), epochs=12)
    assert net.languages == ["de", "en", "fr"]
    asked = [(1, LINES["en"]), (2, LINES["de"]), (3, "chien paresseux et puis")]
    got = language_id.predict(documents(asked), "doc_id", "text", net).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "en", 2: "de", 3: "fr"}


def plain(net, text):
    """(language, score, none) of a text, window by window and place by place."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, 1.0
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode("utf-8", "replace"))
    total, known, none = 0.0, np.zeros(len(net.languages)), 0.0
    for at in range(0, len(raw), 256):
        window = raw[at : at + 256].ljust(256, b"\0")
        weight = sum(b not in (0, 32) for b in window) + 1e-9
        best = []
        for table in net.tables:
            width = len(table)
            places = [sum(table[k][window[p + k]] for k in range(width)) for p in range(256 - width + 1)]
            best.append(np.max(places, axis=0))
        logits = (np.maximum(np.concatenate(best) + net.bias, 0) @ net.weights + net.offset).astype(float)
        e = np.exp(logits - logits.max())
        total, none, known = total + weight, none + weight * e[-1] / e.sum(), known + weight * e[:-1] / e[:-1].sum()
    return net.languages[int(known.argmax())], known.max() / total, none / total


def test_query_against_a_plain_version(spark, folder):
    from ticketloom.llm.queries import language_network, table

    documents = table(spark, folder, "documents")
    net = language_network(documents)
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["text"] is None or len(r["text"]) < 4_000}
    rows = {r["doc_id"]: r for r in op2_language_id(spark, folder).collect()}
    again = {r["doc_id"]: r for r in language_id.predict(documents, "doc_id", "text", net, with_strange=True).collect()}
    assert len(texts) > 100
    for key, text in texts.items():
        name, score, none = plain(net, text)
        assert rows[key]["lang_pred"] == again[key]["lang_pred"] == name
        assert abs(rows[key]["score"] - score) < 1e-4 and abs(again[key]["strange"] - none) < 1e-4


def test_ties_go_to_the_first_language(documents):
    """Equal texts under two names: the network cannot tell them, and equal outputs name the first."""
    net = language_id.Network(["a", "b"], [np.zeros((2, 256, 12), np.float32)] * 4, np.zeros(48, np.float32), np.zeros((48, 3), np.float32), np.zeros(3, np.float32))
    net.tables = [np.zeros((w, 256, 12), np.float32) for w in language_id.WIDTHS]
    got = language_id.predict(documents([(1, "any text")]), "doc_id", "text", net, with_strange=True).collect()
    assert [tuple(r)[:3] for r in got] == [(1, "a", 0.5)] and abs(got[0]["strange"] - 1 / 3) < 1e-6
