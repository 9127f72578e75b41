import random

import pytest

from skein.llm import names as N
from skein.llm import tries

LEXICON = [("Alexander", "given", None), ("Bruno", "given", None), ("Celia", "given", None), ("Delia", "given", None), ("Sasha", "nickname", "Alexander"), ("Ted", "nickname", "Edward")]


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.fixture(scope="module")
def words():
    r = random.Random(0)
    return sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(300)})


@pytest.mark.parametrize("bound", [1, 2])
def test_automaton(words, bound):
    root = tries.trie(words)
    for w in words[::5]:
        assert set(tries.near(root, w, bound)) == {x for x in words if osa(w, x) <= bound}


@pytest.mark.parametrize("size", [1, 20_000])
def test_trie_join(spark, words, size, monkeypatch):
    monkeypatch.setattr(tries, "TRIE_WORDS", size)
    df = spark.createDataFrame([("g", w, 1) for w in words] + [("g", words[0], 1), ("h", words[0], 1), ("g", None, 1), ("g", "", 1), (None, "abc", 1)], "kind STRING, w STRING, near INT")
    got = {(r.group, r.word, r.near) for r in tries.neighbours(df, "kind", "w").collect()}
    assert got == {("g", a, b) for a in words for b in words if a != b and osa(a, b) <= 1}
    assert tries.neighbours(df.limit(0), "kind", "w").count() == 0


def test_readings():
    given = {"alexander", "bruno", "celia", "sasha"}
    assert N.person("Dr. Bruno K. Vandorp Jr.", given) == [("vandorp", "bruno", "full", "")]
    assert N.person("Vandorp, Bruno", given) == [("vandorp", "bruno", "full", "")]
    assert N.person("Vandorp B.K.", given) == [("vandorp", "b", "initial", "")]
    assert N.person("Bru. Vandorp", given) == [("vandorp", "bru", "short", "")]
    assert N.person("bruno.vandorp", given) == [("vandorp", "bruno", "full", "")]
    assert ("vandorp", "b", "glued", "") in N.person("bvandorp", given)
    assert N.person("  Bruno  Vandorp - PM", given) == N.person("Bruno Vandorp (she)", given) == [("vandorp", "bruno", "full", "")]
    assert N.organisation("The Vandorp Foods Gesellschaft mbH", given)[1] == ("vandorp", "foods", "full", "")
    assert N.organisation("VandorpFoods GmbH", given)[1] == ("vandorp", "foods", "full", "")
    assert N.organisation("Vandorp GmbH", given) == [("vandorp", "", "none", "")]
    assert N.organisation("Acme North Logistics Ltd", given)[0] == ("logistics", "acme", "full", "north")
    assert N.person("Bruno Lopez Vandorp", given) == [("lopez", "bruno", "full", "vandorp"), ("vandorp", "bruno", "full", "lopez")]
    assert N.person("", given) == [] and N.organisation("- &", given) == []


PEOPLE = {
    "bruno": ["Bruno Vandorpel", "Bruno Vandorpel", "BRUNO VANDORPEL", "Vandorpel, Bruno", "Bru. Vandorpel", "Bruno Vandropel", "Bruuno Vandorpel", "bvandorpel", "Brúno Vandörpel", "Vandorpel Bruno"],
    "celia": ["Celia Vandorpel", "C. Vandorpel", "celia_vandorpel"],
    "alex": ["Alexander Okrimusta", "Sasha Okrimusta", "A. Okrimusta", "Mr. Alexander Okrimsta"],
    "delia": ["Delia Okrimusta"],
}
MORE = {"maria": ["Celia Maria Opplefrutz", "Opplefrutz Celia Maria", "Celia Maria Oplefrutz", "Opplefrutz, Maria Celia"], "lopez": ["Celia Lopez Opplefrutz"], "lone": ["Delia Sabine Ukkermoltz", "Delia Ukkermoltz"]}
PEOPLE |= MORE
FIRMS = {"north": ["Acme North Logistics", "Logistics Acme North", "ACME NORTH LOGISTICS LTD"], "south": ["Acme South Logistics"], "foods": ["Trivenka Foods Inc.", "Foods Trivenka", "Trivenka & Fodos", "trivenka-foods", "Trivenka Fds", "TrivenkaFoods Inc."], "press": ["Trivenka Press Ltd", "The Trivenka Press Limited"]}


def test_linking(spark):
    data = [(f"{k}{i}", t, n, None) for t, group in (("Person", PEOPLE), ("organization", FIRMS)) for k, ns in group.items() for i, n in enumerate(ns)]
    data += [data[0], ("nobody", "person", None, None), ("void", "person", " ", []), (None, "person", "Bruno Vandorpel", None), ("tool", "tool", "Bruno Vandorpel", None), ("aka", "person", "Zz Q", ["Delia Okrimusta", None])]
    df = spark.createDataFrame(data, "id STRING, entity_type STRING, name STRING, aliases ARRAY<STRING>")
    lexicon = spark.createDataFrame(LEXICON, "name STRING, kind STRING, formal STRING")
    got = {(r.id_a, r.id_b) for r in N.same_pairs(df, lexicon).collect()}
    groups = [[f"{k}{i}" for i in range(len(v))] for k, v in (PEOPLE | FIRMS).items()]
    next(g for g in groups if g[0] == "delia0").append("aka")
    assert got == {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id STRING, entity_type STRING, name STRING, aliases ARRAY<STRING>")
    lexicon = spark.createDataFrame([], "name STRING, kind STRING, formal STRING")
    assert N.same_pairs(df, lexicon).count() == 0
    one = spark.createDataFrame([("a", "person", "Xa Okrimusta", None), ("b", "person", "Okrimusta Xa", None)], df.schema)
    assert [tuple(r) for r in N.same_pairs(one, lexicon).collect()] == [("a", "b")]
