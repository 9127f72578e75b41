import json

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators.nested import CHATGPT, Shredder, chatgpt_tables, codex_tables, nested_links, pivot, related_tables, shred

EXPORTS = "rec_id BIGINT, export_file STRING, payload STRING"
LINES = "rec_id BIGINT, session_file STRING, line_no INT, line STRING"


def conversation(**nodes):
    return {"id": "c", "mapping": nodes}


def node(parent=None, children=(), parts=None):
    out = {"parent": parent, "children": list(children)}
    if parts is not None:
        out["message"] = {"author": {"role": "user"}, "content": {"content_type": "text", "parts": parts}}
    return out


def test_chatgpt_links(spark, rows):
    whole = conversation(a=node(None, ["b"]), b=node("a", ["d"], ["x", None, {"y": 1}]), d=node("gone", [], "bare"), e=node("gone"), f=None)
    listed = {"id": None, "mapping": [{"id": "n", "parent": None}, {"parent": "n"}]}
    payloads = [json.dumps(whole), json.dumps(whole), json.dumps([whole]), json.dumps({"conversations": [listed]}), "", None, "<html>", json.dumps(whole)[:40]]
    exports = spark.createDataFrame([(1 if i == 1 else i, "f", p) for i, p in enumerate(payloads)], EXPORTS)
    got = rows(nested_links(exports, spark.createDataFrame([], LINES)))
    links = [("node", "c", "a"), ("node", "a", "b"), ("node", "b", "d"), ("node", "c", "e"), ("node", "c", "f"), ("part", "b", "0"), ("part", "b", "1"), ("part", "b", "2"), ("part", "d", "0")]
    want = [("chatgpt", r, *x) for r in (0, 1, 2) for x in links] + [("chatgpt", 3, "node", "", "n"), ("chatgpt", 3, "node", "n", "1")]
    assert got == sorted(want, key=repr)


def test_codex_links(spark, rows):
    def line(payload):
        return json.dumps({"type": "response_item", "payload": payload})

    lines = [
        line({"content": [{"type": "input_text", "text": "x"}, {"text": "y"}, "z", None]}),
        line({"content": "bare"}),
        line({"call_id": "k", "arguments": json.dumps({"a": {"b": [1, {"c": []}]}, "d": ""})}),
        line({"arguments": json.dumps(json.dumps({"q": None}))}),
        line({"call_id": "w", "arguments": "{broken"}),
        line({"call_id": "v", "arguments": {}}),
        line({"call_id": "u", "arguments": None}),
        line({"call_id": "t", "arguments": "[1]"}),
        '{"payload":',
    ]
    df = spark.createDataFrame([(i, "s", i, x) for i, x in enumerate([*lines, lines[0]])], LINES)
    got = [r[1:] for r in rows(nested_links(spark.createDataFrame([], EXPORTS), df)) if r[1] != 9]
    want = [
        (0, "block", "0", "0:input_text"), (0, "block", "0", "1:"), (0, "block", "0", "2:"), (0, "block", "0", "3:"), (1, "block", "1", "0:"),
        (2, "argument", "k", "a.b[0]"), (2, "argument", "k", "a.b[1].c"), (2, "argument", "k", "d"), (3, "argument", "", "q"), (4, "argument", "w", ""), (5, "argument", "v", ""), (7, "argument", "t", "[0]"),
    ]
    assert got == sorted(want, key=repr)


def test_empty_tables(spark):
    assert nested_links(spark.createDataFrame([], EXPORTS), spark.createDataFrame([], LINES)).count() == 0
    assert chatgpt_tables(spark.createDataFrame([], EXPORTS), CHATGPT)["parts"].count() == 0
    assert codex_tables(spark.createDataFrame([], LINES))["arguments"].count() == 0


def test_pivot_keeps_parent_keys(spark, rows):
    record = json.dumps({"orders": [{"id": 7, "lines": [{"sku": "a"}, {"sku": "b", "n": 2}]}, {"id": 8, "lines": []}]})
    df = spark.createDataFrame([(1, record), (1, record)], "k INT, j STRING")
    triples = shred(df, "j", ["k"], Shredder())
    got = rows(pivot(triples, ["k"], "orders[].lines[]", {"sku": "sku", "n": "n"}).select("k", "ord", "sku", "n"))
    assert got == [(1, ["0", "0"], "a", None), (1, ["0", "1"], "b", "2")]


def test_deep_records_are_walked(spark):
    deep = '{"id": "c", "deep": ' + '{"x": [' * 30_000 + "1" + "]}" * 30_000 + ', "mapping": {"a": {"parent": null, "message": {"content": {"parts": ["p"]}}}}}'
    exports = spark.createDataFrame([(1, "f", deep), (2, "f", deep[:-1]), (3, "f", deep.replace("1]", "1", 1))], EXPORTS)
    assert sorted(map(tuple, nested_links(exports, spark.createDataFrame([], LINES)).collect())) == [("chatgpt", 1, "node", "c", "a"), ("chatgpt", 1, "part", "a", "0")]
    assert sum(1 for _ in Shredder().triples('{"x":' * 3000 + "1" + "}" * 3000)) == 3001
    argument = json.dumps({"payload": {"call_id": "k", "arguments": "[" * 3000 + "]" * 3000}})
    lines = spark.createDataFrame([(1, "s", 1, argument)], LINES)
    assert [r.child_key for r in nested_links(spark.createDataFrame([], EXPORTS), lines).collect()] == ["[0]" * 2999]


def test_what_is_no_json():
    for text in ("", "{", "[1,]", '{"a":1,}', '{"a" 1}', "01", "1 2", "nul", '"\n"', "[1 2]", '{"a":1}}', "{1:2}", "-", "1.", '{"mapping": {"a": [}}', '[{"id": tru}]', '{"x": {"y": [1,,2]}}'):
        for shredder in (Shredder(), CHATGPT, Shredder(keep=("a",))):
            try:
                json.loads(text)
            except ValueError:
                pass
            else:
                raise AssertionError(text)
            try:
                shredder.triples(text)
            except ValueError:
                continue
            raise AssertionError(text)


def test_roots_and_equal_keys():
    found = lambda text, s: [(t[0], t[1], t[5]) for t in s.triples(text)]
    s = Shredder(roots=("conversations[]", "[]", ""), keep=("id",))
    assert found('{"id": 1, "conversations": [{"id": "a"}, 7, {"id": "b"}], "x": {"id": 2}}', s) == [(0, "id", "a"), (2, "id", "b")]
    assert found('{"id": 1, "conversations": {"id": "a"}}', s) == [(0, "id", "a")]
    assert found('{"id": 1, "conversations": 3}', s) == [(0, "id", "1")] == found('\ufeff {"id": 9, "id": 1}', s)
    assert found('[{"id": null}]', s) == [(0, "id", None)] and found("[]", s) == found("7", s) == []
    whole = Shredder()
    assert [t[1:] for t in whole.triples('{"a": {"b": 1}, "a": [2.50, true]}')] == [("", [], "", "object", "1", 0), ("a", [], "a", "array", "2", 1), ("a[]", ["0"], "a[0]", "number", "2.5", 2), ("a[]", ["1"], "a[1]", "boolean", "true", 3)]


def test_related_tables(spark, rows):
    record = json.dumps({"shop": "s", "orders": [{"id": 7, "lines": [{"sku": "a", "size": {"w": 1}}, {"sku": "b"}]}, {"id": 8, "lines": []}]})
    triples = shred(spark.createDataFrame([(1, record), (1, record), (2, None), (3, "x")], "k INT, j STRING"), "j", ["k"], Shredder())
    tables = related_tables(triples, ["k"], ["shop", "orders[]", "orders[].id", "orders[].lines[]", "orders[].lines[].sku", "orders[].lines[].size.w"])
    assert rows(tables[""].select("k", "shop")) == [(1, "s")]
    assert rows(tables["orders[]"].select("ord", "id")) == [(["0"], "7"), (["1"], "8")]
    assert rows(tables["orders[].lines[]"].select("ord", "sku", "size_w")) == [(["0", "0"], "a", "1"), (["0", "1"], "b", None)]


def test_half_characters_become_replacements(spark):
    df = spark.createDataFrame([(1, '{"a": "x\\ud83d", "\\ude00": "\\ud83d\\ude00"}')], "k INT, j STRING")
    assert sorted(r.value for r in shred(df, "j", ["k"], Shredder(keep=("a", "b*", "\ude00"))).collect()) == sorted(["x\ufffd", "😀"])


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(JSON)
def test_triples_hold_every_value(value):
    count = lambda v: 1 + (sum(map(count, v.values())) if isinstance(v, dict) else sum(map(count, v)) if isinstance(v, list) else 0)
    got = list(Shredder().triples(json.dumps(value)))
    assert len(got) == count(value)
    assert [t[-1] for t in got] == list(range(len(got)))


def test_strings_that_hold_json():
    s = Shredder(embedded=("a",), keep=("a*",))
    found = lambda value: [(t[1], t[4], t[5]) for t in s.triples(json.dumps({"a": value}))]
    assert found('{"b": 1}') == [("a", "object", "1"), ("a.b", "number", "1")]
    assert found('"[1]"') == [("a", "array", "1"), ("a[]", "number", "1")]
    for bare in ("7", "x", '"x', '{"b": 1', "[1] 2", json.dumps(json.dumps(json.dumps([1])))):
        assert found(bare) == [("a", "string", bare)]
