"""Operators 2 and 10: tool calls and URL rules."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from layerkit.llm import queries, tool_calls, url_filter
from layerkit.llm.common import table

URLS = [
    (1, "https://www.example.com/en/1?x#y"), (2, "http://EXAMPLE.com/en/1"), (3, "http://a.b.example.com/en/"), (4, "http://example.com"),
    (5, None), (6, "no scheme"), (7, ""), (8, "http://x.net/es/#/fr/"), (9, "http://net/fr/a"), (10, "http://badnet/fr/a"), (11, "x://y://www.example.com/en/"),
    (12, "http://com/"), (13, "http:///en/"), (14, "http://É.Com/ä/../"), (15, "http://" + "a." * 3000 + "com/" + "p" * 20_000), (15, "http://x.net/es/"), (None, "http://x.net/es/"),
    (16, "http://example.com:80/en/"), (17, "http://example.com?/en/"), (18, "http://www.example.com/en"), (19, "http://..com//"),
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    best = None
    for rule, verdict in rules:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            key = (len(rule), len(rule_host))
            if best is None or key > best[0]:
                best = (key, rule, verdict)
    return (host, path, *(best[1:] if best else (None, "allow")))


@pytest.mark.parametrize("rules", [queries.URL_RULES, [], [("b.com/xy", "block"), ("a.b.com/", "allow"), ("com/x", "block"), ("b.com/xyé", "allow")]])
def test_urls_against_brute_force(spark, rules):
    urls = [*URLS, (30, "http://a.b.com/xyz"), (31, "http://q.b.com/xyé/"), (32, "http://b.com/x")]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in urls], "page_id long, url string, rule string, Verdict string").repartition(3)
    found = url_filter.judge_urls(pages, rules).collect()
    want = sorted((str(i), *map(str, brute(u, rules))) for i, u in urls)
    assert sorted(tuple(map(str, r)) for r in found) == want
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda key: 42)
    path = tmp_path / "rules"
    path.write_bytes(url_filter.digest_file([("a.com/", "block"), ("b.com/", "allow")]))
    array = url_filter.DigestArray(str(path))
    places = array.probe([b"b.com/", b"c.com/", b"a.com/"])
    assert places[1] == -1 and [array.text(int(places[i])) for i in (0, 2)] == [b"b.com/", b"a.com/"]


@pytest.mark.parametrize("rules", [[("example.com", "block")], [("/x", "block")], [("a.com/", "drop")], [("a.com/", "block"), ("a.com/", "allow")]])
def test_bad_rules_raise(spark, rules):
    with pytest.raises(ValueError):
        url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules)


def test_canonical_json():
    value = json.loads('{"b": [1.0, 2.50, -0.0, 1e3, null, true], "a": {"é\\n": "\\u00e9\\"", "A": 12345678901234567890}}')
    assert tool_calls.canonical(value) == '{"a":{"A":12345678901234567890,"é\\n":"é\\""},"b":[1,2.5,0,1000,null,true]}'
    with pytest.raises(ValueError):
        tool_calls.canonical(float("nan"))
    # One form for equal numbers, however they are written.
    forms = {"1e20": "1" + "0" * 20, "1E+2": "100", "-0.0": "0", "1e-7": "1e-7", "0.00001": "0.00001", "1.5e300": "15" + "0" * 299, "123456789012345680000.0": "123456789012345680000", "0.1e1": "1", "2.50": "2.5", "-12.5e-9": "-1.25e-8"}
    for written, form in forms.items():
        assert tool_calls.canonical(json.loads(written)) == form and float(json.loads(form)) == json.loads(written)


def test_schema_faults():
    schema = {
        "type": "object", "required": ["q", "n"], "additionalProperties": False,
        "properties": {"q": {"type": "string", "minLength": 2, "pattern": "^a"}, "n": {"type": "integer", "minimum": 1}, "l": {"type": "array", "items": {"enum": [1, "x"]}, "maxItems": 2}},
    }
    faults = lambda v: tool_calls.schema_faults(v, schema)
    assert faults({"q": "ab", "n": 2.0, "l": [1, "x"]}) == []
    assert faults({"q": "b", "n": True, "z": 1}) == ["/z: unknown", "/n: not integer", "/q: length", "/q: pattern"]
    assert faults({"n": 0, "l": [1, 2, 3]}) == ["/q: missing", "/l: number of items", "/l/1: not listed", "/l/2: not listed", "/n: range"]
    assert faults([]) == ["/: not object"]


def call(id_, name="f", arguments="{}", after=None):
    body = {"id": id_, "name": name} | ({"after": after} if after is not None else {})
    return "<tool_call>" + json.dumps(body)[:-1] + f', "arguments": {arguments}}}</tool_call>'


def result(id_, content="ok"):
    return f"<tool_response>{json.dumps({'id': id_, 'content': content})}</tool_response>"


def messages(spark, rows):
    kind = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("text", T.StringType()), T.StructField("status", T.StringType()), T.StructField("Json", T.StringType())])
    return spark.createDataFrame([(*r, "own", "own") for r in rows], kind).repartition(3)


def test_links_by_identifier(spark):
    rows = [
        (1, 0, "hi " + call("a") + "\n" + call("b")), (1, 1, result("b", "B") + result("zz")), (1, 2, call("a", "again")), (1, 3, result("a", "A") + result("a", "later")),
        (2, 0, result("a", "too early")), (2, 1, call("a")), (2, 2, "<tool_call>not json</tool_call><tool_call>{\"id\": \"x\"}</tool_call>"), (2, 3, None), (2, 4, ""),
        (None, 0, call("a")), (3, None, call("a")), (1, 2, call("a", "again")), (4, 0, call("only") * 1 + "x" * 50_000),
    ]
    found = tool_calls.link_calls(messages(spark, rows)).collect()
    got = sorted((r.conv_id, r.turn, r.place, r.call_id, r.status, r.result_turn, r.content) for r in found)
    assert got == sorted([
        (1, 0, 0, "a", "linked", 3, "A"), (1, 0, 1, "b", "linked", 1, "B"), (1, 2, 0, "a", "repeated", None, None), (2, 1, 0, "a", "no_result", None, None),
        (2, 2, 0, None, "malformed", None, None), (2, 2, 1, "x", "malformed", None, None), (4, 0, 0, "only", "no_result", None, None),
    ], key=lambda r: r[:3])
    assert tool_calls.link_calls(messages(spark, [])).count() == 0


def test_calls_of_one_turn_that_share_an_id(spark):
    rows = [(1, 0, call("a", "one")), (1, 0, call("a", "two")), (1, 1, result("a", "A")), (1, 1, result("a", "B")), (1, 1, result("a", "A"))]
    found = tool_calls.order_calls(tool_calls.link_calls(messages(spark, rows))).collect()
    assert sorted((r.status, r.content) for r in found if r.status == "linked") == [("linked", "A")]
    assert sorted(r.status for r in found) == ["linked", "repeated"] and {r.name for r in found} == {"one", "two"}


def test_tags_inside_json_strings():
    inner = '{"id": "a", "name": "f", "arguments": {"q": "x</tool_call><tool_call>{\\"y\\"} <tool_response>"}}'
    text = f"say <tool_call> {inner} </tool_call> and <tool_call>{{broken</tool_call><tool_call>{{}} more</tool_call><tool_call>[1]"
    found = tool_calls.blocks_of(text, "tool_call")
    assert [f.strip() for f in found] == [inner, "{broken", "{} more"] and json.loads(found[0])
    assert tool_calls.blocks_of("<tool_call>" * 3, "tool_call") == [] and tool_calls.blocks_of("", "tool_call") == []
    assert tool_calls.blocks_of("<tool_call>" + "[" * 100_000 + "</tool_call>", "tool_call") == ["[" * 100_000]


def brute_order(calls):
    """(step, depth) by identifier from all that a call reaches; depth from within its step."""
    own = {c: at for c, at, _ in calls}
    needs = {c: [n for n in after if n in own] for c, _, after in calls}

    def reach(c):
        seen, todo = {c}, [c]
        while todo:
            for n in needs[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    step = {c: max(own[n] for n in reach(c)) for c in own}
    depth, moved = {}, True
    while moved:
        moved = False
        for c in own:
            inner = [n for n in needs[c] if step[n] == step[c]]
            if c not in depth and all(n in depth for n in inner):
                depth[c] = max((depth[n] + 1 for n in inner), default=0)
                moved = True
    return {c: (step[c], depth.get(c, -1)) for c in own}


@pytest.mark.parametrize("one_task", [50_000, 0])
def test_order_against_brute_force_over_whole_conversations(spark, one_task):
    import random

    draw = random.Random(4)
    convs = {}
    for conv in range(12 if one_task else 4):
        n = draw.randint(1, 14)
        convs[conv] = [(f"c{i}", i << 20, [f"c{draw.randrange(n + 1)}" for _ in range(draw.choice((0, 1, 1, 2)))]) for i in range(n)]
    convs[99] = [(f"c{i}", i << 20, [f"c{i + 1}"] if i < 8 else []) for i in range(9)]
    rows = [(conv, at >> 20, call(c, after=after)) for conv, calls in convs.items() for c, at, after in calls]
    found = tool_calls.order_calls(tool_calls.link_calls(messages(spark, rows)), one_task).collect()
    got = {conv: {r.call_id: (r.step, r.depth) for r in found if r.conv_id == conv} for conv in convs}
    assert got == {conv: brute_order(calls) for conv, calls in convs.items()}
    assert len(found) == len(rows)


def test_a_chain_of_any_length_keeps_its_order(spark):
    chain = [(1, i, call(f"c{i}", after=[f"c{i - 1}", "last"] if i else ["last"])) for i in range(300)] + [(1, 300, call("last"))]
    back = [(2, i, call(f"c{i}", after=[f"c{i + 1}"])) for i in range(300)]
    found = tool_calls.order_calls(tool_calls.link_calls(messages(spark, chain + back))).collect()
    depth = {(r.conv_id, r.call_id): r.depth for r in found}
    assert all(depth[1, f"c{i}"] == i + 1 for i in range(300)) and depth[1, "last"] == 0
    assert all(depth[2, f"c{i}"] == 299 - i for i in range(300))
    assert {(r.conv_id, r.step) for r in found} == {(1, 300 << 20), (2, 299 << 20)}


def test_order_is_topological(spark):
    after = {"c0": ["c5"], "c1": ["c0"], "c2": ["c1", "gone"], "c3": ["c3x"], "c4": ["c3"], "c5": [], "c6": ["c2", "c5"], "p": ["q"], "q": ["p"], "r": ["q"], "s": ["s"]}
    rows = [(1, i, call(c, after=needs)) for i, (c, needs) in enumerate(after.items())] + [(2, 0, call("c0", after=["c1"]) + call("c1", after=["c2"]) + call("c2"))]
    found = tool_calls.order_calls(tool_calls.link_calls(messages(spark, rows))).collect()
    for conv, needs in ((1, after), (2, {"c0": ["c1"], "c1": ["c2"], "c2": []})):
        own = [r for r in found if r.conv_id == conv]
        assert len(own) == len(needs)
        order = {r.call_id: n for n, r in enumerate(sorted(own, key=lambda r: (r.step, r.depth, r.turn, r.place)))}
        cyclic = {r.call_id for r in own if r.depth < 0}
        assert cyclic == ({"p", "q", "s"} if conv == 1 else set())
        assert all(order[n] < order[c] for c, ns in needs.items() if c not in cyclic for n in ns if n in order)


def test_arguments_are_checked(spark):
    rows = [(1, 0, call("a", "f", '{"n": 3, "a": 1.0}') + call("b", "g") + call("c", "f", '{"n": "x"}') + call("d", "f", "[1, 2"))]
    found = {r.call_id: r for r in tool_calls.tool_calls(messages(spark, rows), {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}}).collect()}
    assert found["a"].canonical == '{"a":1,"n":3}' and found["a"].faults == []
    assert found["b"].faults == ["/: unknown tool"] and found["c"].faults == ["/n: not integer"]


def test_derived_calls_link_to_the_next_answer(spark):
    folder = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): r for r in table(spark, folder, "conversations").collect()}
    found = queries.QUERIES["op2_tool_calls"](spark, folder).collect()
    assert {(r.conv_id, r.turn) for r in found} == {k for k, r in turns.items() if r.role == "user"}
    for r in found:
        answer = turns.get((r.conv_id, r.turn + 1))
        there = answer is not None and answer.role == "assistant"
        assert (r.status, r.result_turn, r.content_chars) == (("linked", r.turn + 1, len(answer.text)) if there else ("no_result", None, None))
        assert r.step_turn >= r.turn and r.depth >= 0
    assert any(r.depth > 0 for r in found) and any("range" in r.faults for r in found)
