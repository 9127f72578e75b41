import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import privacy as P
from skein.llm.boosting import BoostedTrees

pytest.importorskip("public_tokenizers")
GIVEN = frozenset(P.plain(n) for n in ["Alexander", "Bruno", "Celia", "Delia", "Grace", "Mark", "Rose", "Joy", "Helga", "Viktor", "Zoran", "Lucia", "Mateo", "Hana", "Ivo", "Bill", "Margaret", "Peggy", "Olaf", "Selma"])


@pytest.fixture(scope="module")
def found():
    path = P.tokenizer_path()
    return P.Detector(P.Finder(GIVEN, frozenset({"farid"}), path), P.train(GIVEN, path, texts=2500))


def test_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees(rounds=30).fit(x[:1200], y[:1200]).calibrate(x[1200:1600], y[1200:1600])
    p = model.probability(x[1600:])
    assert ((p >= model.threshold) == y[1600:]).mean() > 0.93
    again = BoostedTrees(rounds=30).fit(x[:1200], y[:1200])
    assert np.array_equal(model.score(x), again.score(x))


def test_held_out_accuracy(found):
    writer = P.Writer(sorted(GIVEN), seed=123)
    hit, wrong, missed = Counter(), Counter(), Counter()
    for _ in range(500):
        text, truth = writer.text()
        got = {(k, a) for k, a, _ in next(found.mentions([text]))}
        hit.update(k for k, _ in got & truth)
        wrong.update(k for k, _ in got - truth)
        missed.update(k for k, _ in truth - got)
    for kind in P.KINDS:
        assert hit[kind] > 30 and wrong[kind] <= 0.03 * hit[kind] and missed[kind] <= 0.03 * hit[kind], (kind, hit, wrong, missed)


KNOWN = [
    ("Ask Prof. Quibramel or mail bruno.quibramel+x@mail.example.", {("name", "Quibramel"), ("email", "bruno.quibramel+x@mail.example")}),
    ("write to h.v (at) post (dot) example or call (617) 555-0148 now", {("email", "h.v (at) post (dot) example"), ("phone", "(617) 555-0148")}),
    ("Passport ZZ5327896 belongs to Vreskomun, Lucia.", {("id_number", "ZZ5327896"), ("name", "Vreskomun, Lucia")}),
    ("Lives at 2033 Larkfield Street, Dunmere.", {("address", "2033 Larkfield Street, Dunmere")}),
    ("Mark the parser as done. Bill the 24 tokens. Batch 2024-0555-0142 has 12 files. Server 192.0.2.14 answered.", set()),
    ("", set()),
]


@pytest.mark.parametrize("text, want", KNOWN)
def test_known_sentences(found, text, want):
    assert {(k, text[a:b]) for k, a, b in next(found.mentions([text]))} == want


def test_redaction_keeps_the_rest(spark, found, rows):
    df = spark.createDataFrame([(1, "Thanks, Celia! Call +1 617 555 0123.", "a"), (2, None, "b"), (3, "", "c"), (4, "nothing here", "d"), (4, "nothing here", "d")], "k INT, text STRING, kind STRING")
    got = rows(P.redacted(df, "text", found))
    assert got == [(1, "Thanks, [NAME]! Call [PHONE].", "a"), (2, None, "b"), (3, "", "c"), (4, "nothing here", "d"), (4, "nothing here", "d")]
    assert P.redacted(df.limit(0), "text", found).count() == 0
    spans = rows(P.mentions(df.withColumnRenamed("kind", "other"), F.col("text"), ["k"], found))
    assert spans == [(1, "name", 8, 13), (1, "phone", 20, 35)]


def test_long_texts_take_linear_time(found):
    for unit in ("a", "1", "1 (", "ab-", "a.b@", "Ab ", "五", "x@", "C/ "):
        began = time.time()
        found.finder.spans(unit * (120_000 // len(unit)))
        assert time.time() - began < 5, unit


def test_learnt_given(spark):
    texts = [(f"Farid {w} said so. Try Kestrelbox {w}.",) for w in ("Ombrevak", "Zukritol", "Plivander", "Skoruntha")] + [("Text Celia Ombrevak now",)] * 4 + [(None,)]
    df = spark.createDataFrame(texts, "text STRING")
    got = {r.word for r in P.learnt_given(df, "text", GIVEN, P.tokenizer_path()).collect()}
    assert "farid" in got and "text" not in got
    copied = df.unionByName(df.where("text like 'Farid%'").limit(1).select(F.explode(F.array_repeat("text", 500)).alias("text")))
    assert {r.word for r in P.learnt_given(copied, "text", GIVEN, P.tokenizer_path()).collect()} == got


def test_many_learnt_names_are_joined(spark, found, rows):
    texts = [(i, f"We met Farid {w} and Ivo Plen.") for i, w in enumerate(("Ombrevak", "Zukritol", "Plivander", "Skoruntha"))] + [(9, None), (10, ""), (11, "no one")]
    df = spark.createDataFrame([*texts, texts[0]], "k INT, text STRING")
    learnt = spark.createDataFrame([("farid",), ("unused",)], "word STRING")
    bare = P.Detector(P.Finder(GIVEN, frozenset(), P.tokenizer_path()), found.models)
    want = rows(P.mentions(df, F.col("text"), ["k"], found))
    assert len(want) == 10
    assert rows(P.mentions(df, F.col("text"), ["k"], bare, learnt)) == want
    assert rows(P.redacted(df, "text", bare, learnt)) == rows(P.redacted(df, "text", found))


PIECES = ["jo { at } mail.org", "jo (\xa0at\xa0) mail.org", "jo <at > mail.org", "jo (AT) mail (DOT) org", "jo at mail dot org", "x@y.zz", "12 rue\xa0de la Paix", "12 bis rue\tX", "P.O. Box 12", "BP\xa07", "Apartado de correos 8", "Postal Box 3", "5 Old Mill Rd.", "9, High St", "Quillstr. 7", "Amring 3", "C/ Mayor 3, 4", "Avda. Sol\xa09", "one two three", "ONE-two nine", "oh\u017fix seven \u017even eight", "\u017eix \u017fix zero one", "٠١٢٣٤٥٦", "12 345 6", "1 ext 23456", "(617) 5550123", "Anna", "Mr Bruno Zok", "plain words", "\n", ", ", "é", "(", "at", "dot", "7"]


def test_sifting_loses_nothing(found):
    r = random.Random(4)
    writer = P.Writer(sorted(GIVEN), seed=9)
    texts = PIECES + ["".join(r.choice([p, p + " ", " " + p]) for p in r.choices(PIECES, k=r.randint(2, 4))) for _ in range(4000)] + [writer.text()[0] for _ in range(800)]
    plain = lambda spans: [(s.kind, s.start, s.end) for s in spans]
    for text in texts:
        assert plain(found.finder.spans(text)) == plain(found.finder.spans(text, sift=False)), text
    for text, kind in zip(PIECES, ["email"] * 6 + ["address"] * 12):
        assert kind in {s.kind for s in found.finder.spans(text)}, text


def test_all_texts(spark, rows):
    messages = spark.createDataFrame([("m", "hello"), ("n", None), ("o", "")], "id STRING, content STRING")
    lines = ['{"payload":{"content":[{"text":"x"},{"type":"img"},"y"],"output":{"a":1}}}', '{"payload":{"content":"bare","output":"out"}}', '{"payload":', None]
    codex = spark.createDataFrame(list(enumerate(lines)), "rec_id BIGINT, line STRING")
    want = [("codex_output", "1", 0, "out"), ("codex_text", "0", 0, "x"), ("codex_text", "0", 2, "y"), ("codex_text", "1", 0, "bare"), ("message", "m", 0, "hello")]
    assert rows(P.all_texts(messages, codex)) == want
