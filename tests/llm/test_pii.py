import random
import re
import time

import pytest

from gazelark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out[kind].append(m.span())
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    bits = ["a.b", "@", ".", "x-1", "+1 (555) 555-0123", "4111 1111 1111 1111", "10.0.0.255", "1.2.3.4.5.6.7.8", "300.1.1.1", " ", "é", "\n", "%", "+", "0", "12345678901234567", "(", ")", "@mail.example.com", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.detect(text) == plain(text), text


@pytest.mark.parametrize(
    "text,kind,inner",
    [
        ("write to john.doe [at] mail3 [dot] example [dot] com today", "email", "john.doe [at] mail3 [dot] example [dot] com"),
        ("write to jane(at)example.com today", "email", "jane(at)example.com"),
        ("mail jane at example dot com please", "email", "jane at example dot com"),
        ("mail jane_at_example_dot_com please", "email", "jane_at_example_dot_com"),
        ("mail jane @ example.com please", "email", "jane @ example.com"),
        ("Адрес: jоhn@ехample.com.", "email", "jоhn@ехample.com"),
        ("zero​width a​b@exam​ple.com", "email", "a​b@exam​ple.com"),
        ("ring five five five, zero one two, three four six seven now", "phone", "five five five, zero one two, three four six seven"),
        ("ring plus one five five five zero one two three four six seven now", "phone", "plus one five five five zero one two three four six seven"),
        ("ring ＋１ （５５５） ５５５-０１２３ now", "phone", "＋１ （５５５） ５５５-０１２３"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("host 192[.]168[.]10[.]7 is", "ip", "192[.]168[.]10[.]7"),
        ("host 192 dot 168 dot 10 dot 7 is", "ip", "192 dot 168 dot 10 dot 7"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, inner):
    base, spans = pii.find(text)
    assert spans[kind] == [(text.index(inner), text.index(inner) + len(inner))]
    assert sum(len(x) for x in spans.values()) == 1
    assert pii.redacted(text) == text.replace(inner, f"[{kind}]")


@pytest.mark.parametrize(
    "text,kind,inner",
    [
        ("write jоhn@example.com now", "email", "jоhn@example.com"),
        ("write john@example.cоm now", "email", "john@example.cоm"),
        ("write john(dot)doe@example.com now", "email", "john(dot)doe@example.com"),
        ("ring five five five 123 4567 now", "phone", "five five five 123 4567"),
        ("host one nine two dot one six eight dot one dot seven is", "ip", "one nine two dot one six eight dot one dot seven"),
        ("host 192.one six eight.1.seven is", "ip", "192.one six eight.1.seven"),
    ],
)
def test_disguises_that_leave_part_of_a_base_span_are_whole(text, kind, inner):
    _, spans = pii.find(text)
    assert spans == {k: [(text.index(inner), text.index(inner) + len(inner))] if k == kind else [] for k in pii.KINDS}
    assert pii.redacted(text) == text.replace(inner, f"[{kind}]")


def test_sql_of_queries_is_text():
    from gazelark.llm import catalogue

    assert all(isinstance(x, str) for x in catalogue.oracle_sql().values())


@pytest.mark.parametrize("text", ["", "look at the dot on the map", "one two three", "in 1914–1918 and 1939–1945, at one", "Der Überfluß (at) und çela", "see at (dot) here", "a" * 200000, "1" * 200000, "+" * 50000, "@" * 50000])
def test_clean_texts_stay_clean(text):
    base, spans = pii.find(text)
    assert not any(spans.values())


def test_query_shape(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "x@y.z é +1 555 555 0123", 6), (2, "x@y.z é +1 555 555 0123", 6)], "doc_id long, text string, spans int")
    rows = sorted(tuple(r) for r in pii.pii_spans(docs).collect())
    assert rows[1] == rows[2] and rows[1][:5] == (2, 1, 0, 0, 1) and rows[1][6] == "email:0:5,phone:8:23"
    assert rows[0][6] == "" and rows[0][5] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert [tuple(r) for r in pii.redact(docs.where("doc_id = 2").limit(1)).collect()] == [(2, "[email] é [phone]", 6)]


@pytest.mark.parametrize(
    "text",
    [" " * 1_000_000, "( " * 300_000, "(" + " " * 500_000 + "x", "a dot " * 100_000, "a at " * 100_000, "at dot " * 100_000, "at a dot " * 100_000, "a @ b" * 100_000, "one two " * 100_000, "1 dot " * 100_000, "a_dot_" * 100_000, "x at y dot com " * 50_000, "one two three four five six seven eight nine; " * 20_000, "jоhn@example.com " * 30_000],
)
def test_long_texts_take_linear_time(text):
    def seconds(t):
        began = time.thread_time()
        pii.find(t)
        return time.thread_time() - began

    seconds(text[:1000])
    part, whole = seconds(text[: len(text) // 8]), seconds(text)
    assert whole < 30 * part + 1  # a square would be 64 times


def test_spelled_addresses_of_many_dots_and_labels_named_at():
    for text, inner in (("mail a dot b dot c at x dot y dot co dot uk now", "a dot b dot c at x dot y dot co dot uk"), ("see foo_at_bar_dot_com ok", "foo_at_bar_dot_com"), ("we met at noon dot com", "met at noon dot com")):
        _, spans = pii.find(text)
        assert spans["email"] == [(text.index(inner), text.index(inner) + len(inner))]


def test_spans_that_overlap_become_one():
    spans = pii.Spans([(0, 3), (5, 9), (20, 22)])
    assert spans.holds(5, 9) and not spans.holds(2, 4) and spans.meets(2, 4) and not spans.meets(3, 5)
    spans.add(2, 6)
    spans.add(10, 12)
    assert spans.listed() == [(0, 9), (10, 12), (20, 22)]


def test_no_rows_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_email"] for r in pii.pii_spans(docs).collect()) == [0, 1]
    assert pii.pii_spans(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []
