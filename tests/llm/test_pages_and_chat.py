import json
import random

import pytest

from quintil.llm import html, toolcalls

# HTML


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<nav><a>menu</a></nav><article><h1>Title</h1><p>One &amp; two&nbsp;three<br>four</article><footer>f</footer>", ["Title", "One & two three four"]),
        ("<main><header><h1>T</h1>by me</header><p>text</p><aside>s</aside><section id=comments><article class=comment>c</article></section>tail</main>", ["T", "text", "tail"]),
        ("<div class='cookie-notice'>x</div><div>keep <b>me</b></div><form>y</form><p class=ad>no<p>yes", ["keep me", "yes"]),
        ("<p>a</p><script>if (a<b) '</p>'</script><!-- <p>no</p> --><p hidden>h</p><p>b &eacute; &#x41;", ["a", "b é A"]),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", ["x", "y", "1 2", "3"]),
        ("<article><p>cut off &am", ["cut off &am"]),
        ("a < b > c", ["a < b > c"]),
        ("<article><p>one</p><svg/><p>two</p><math /><p>three</p></article>", ["one", "two", "three"]),
        ("<article><p>one</p><svg><path><p>two</p><script>x = 1<p>three</p><svg><g><p>four</p></article>", ["one", "two", "three", "four"]),
        ("<article><p>\u0130one</p><SCRIPT>'</scripted>'</Script ><p>two</p></article>", ["\u0130one", "two"]),
        ("<article><p class=ad>no</p><p class='x ad'>no</p><p id=related>no</p><p class='related-work' hidden>no</p><p>yes</p></article>", ["yes"]),
    ],
)
def test_blocks(markup, expected):
    found = html.blocks(page(markup))
    main = [t for t, z in found if z == html.MAIN] or [t for t, z in found if z == html.NEUTRAL]
    assert main == expected


def test_common_subsequence_is_longest():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html.common(a, b)) == best[-1][-1]


def test_pages_lose_what_the_nearest_page_shares(spark):
    shared = "<div>Welcome to the site</div>"
    rows = [
        (1, "http://a.x/en/1", page(f"{shared}<p>first text</p><div>All rights</div>"), 0),
        (2, "https://A.x/en/2?q=1", page(f"{shared}<p>second text</p><div>All rights</div>"), 0),
        (3, "http://b.x/en/3", page(f"{shared}<p>alone</p>"), 0),
        (4, "http://c.x/1", page("<article><p>copied</p></article>"), 0),
        (5, "http://c.x/2", page("<article><p>copied</p></article>"), 0),
        (6, None, None, 0),
        (7, "no address", "", 0),
        (None, "http://d.x/", page("<p>x</p>"), 0),
        (3, "http://b.x/en/3", page(f"{shared}<p>alone</p>"), 0),
    ]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    texts = sorted(((r.page_id, r.text) for r in got), key=repr)
    expected = [(1, "first text"), (2, "second text"), (3, "Welcome to the site\n\nalone"), (3, "Welcome to the site\n\nalone"), (4, "copied"), (5, "copied"), (6, ""), (7, ""), (None, "x")]
    assert texts == sorted(expected, key=repr)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment_decides_on_names_in_part(spark):
    share = "<p class='share-line'>Share this</p>"
    texts = {1: f"<p>one</p>{share}<p class='related-work'>Earlier studies</p>", 2: f"<p>two</p>{share}"}
    rows = [(i, f"http://a.x/{i}", page(f"<article>{t}</article>")) for i, t in texts.items()] + [(3, "http://b.x/", page(f"<article>{share}</article>"))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one\n\nEarlier studies", 2: "two", 3: "Share this"}


def test_long_and_null_pages_with_clashing_columns(spark):
    long = "".join(f"<p>block {i}</p><svg>" for i in range(30_000))
    rows = [(1, "http://a.x/1", page(f"<article>{long}</article>"), "r", "k", 1), (2, None, None, None, None, None), (3, "http://a.x/2", "", "", "", 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, row string, k string, rank long")
    got = {r.page_id: r.text for r in html.extract(frame).collect()}
    assert got == {1: "\n\n".join(f"block {i}" for i in range(30_000)), 2: "", 3: ""}


# Tool calls

SCHEMA = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True)]


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame(SCHEMA, "name string, argument string, kind string, required boolean")


def call(i, name, arguments):
    return {"id": i, "name": name, "arguments": arguments}


def ask(*calls):
    return json.dumps({"tool_calls": list(calls)})


def answer(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def chat(spark, rows, schemas):
    frame = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, json string")
    return toolcalls.format_chat(frame, schemas).collect()


def test_calls_are_linked_checked_and_canonical(spark, schemas):
    rows = [
        (1, 0, "user", "plain \"text\""),
        (1, 1, "assistant", ask(call("x", "add", {"b": 2.5, "a": 1}), call("y", "say", '{"text": "$x"}'))),
        (1, 2, "tool", answer("x", {"z": 1, "a": [None, "é"]})),
        (1, 3, "tool", answer("x", "second")),
        (1, 4, "tool", answer("nobody", "lost")),
        (1, 5, "assistant", ask(call("x", "add", {"a": 1}), {"name": "add", "arguments": 3}, call("w", "add", {"a": "one", "c": 1}))),
        (1, 6, "assistant", ask(call("v", "else", {}), call("u", "say", {}), call("t", "say", {"text": "$gone"}), call("s", "say", "not json"))),
        (1, 7, "assistant", "{not json"),
        (None, 0, None, None),
    ]
    got = chat(spark, rows, schemas)
    calls = {r.call_id: r for r in got if r.kind == "call" and "repeated_id" not in r.errors}
    assert json.loads(calls["x"].json) == {"arguments": {"a": 1, "b": 2.5}, "id": "x", "name": "add", "result": {"a": [None, "é"], "z": 1}}
    assert calls["x"].json.startswith('{"arguments":{"a":1,"b":2.5},"id":"x"')
    assert calls["y"].errors == [] and calls["y"].place > calls["x"].place
    assert calls["w"].errors == ["kind:a", "unknown:c"]
    assert calls["v"].errors == ["no_schema"] and calls["u"].errors == ["missing:text"]
    assert calls["t"].errors == ["reference:gone"] and calls["s"].errors == ["no_object"] and calls[None].errors == ["no_id"]
    assert sum("repeated_id" in r.errors for r in got) == 1
    messages = [r.json for r in got if r.kind == "message"]
    assert '{"content":"plain \\"text\\"","role":"user"}' in messages and '{"content":null,"role":""}' in messages
    assert len(messages) == 5


def test_calls_stand_behind_those_they_refer_to(spark, schemas):
    needs = {"a": ["$c"], "b": ["$a"], "c": [], "d": ["$e"], "e": ["$d"], "f": ["$d"], "g": ["$g"]}
    rows = [(7, t, "assistant", ask(call(i, "say", {"text": (n or ["x"])[0]}))) for t, (i, n) in enumerate(needs.items())]
    rows += [(8, t, "assistant", ask(call(i, "say", {"text": "x"}))) for t, i in enumerate("ab")]
    got = {(r.conv_id, r.call_id): r for r in chat(spark, rows, schemas)}
    at = {i: got[7, i].place for i in "abc"}
    assert at["c"] < at["a"] < at["b"]
    assert all(got[7, i].errors == ["circle"] and got[7, i].place is None for i in "def")
    assert got[7, "g"].errors == ["reference:g"] and got[8, "a"].errors == []


def test_chat_of_repeated_and_no_rows(spark, schemas):
    rows = [(1, 0, "assistant", ask(call("x", "say", {"text": "t"})))] * 2 + [(1, 1, "user", "u")] * 2
    assert sorted(r.kind for r in chat(spark, rows, schemas)) == ["call", "message", "message"]
    assert chat(spark, [], schemas) == []


def test_turns_and_calls_of_any_number(spark, schemas):
    """Turns near the largest long, a null turn, more than 2^20 steps apart, a very long text, extra columns."""
    far = 2**62
    rows = [
        (1, far, "assistant", ask(call("a", "say", {"text": "$b"}), call("c", "say", {"text": "x" * 500_000}))),
        (1, far + 1, "assistant", ask(call("b", "say", {"text": "t"}))),
        (1, far + 1, "user", "later"),
        (1, None, "assistant", ask(call("n", "say", {"text": "$c"}))),
    ]
    got = {(r.kind, r.call_id): r for r in chat(spark, rows, schemas)}
    at = {i: tuple(got["call", i].place) for i in "abcn"}
    assert at == {"c": (far, 1), "b": (far + 1, 0), "a": (far + 1, 1), "n": (far, 2)}
    assert all(got["call", i].errors == [] for i in "abcn")
    assert tuple(got["message", None].place) == (far + 1, 0)
