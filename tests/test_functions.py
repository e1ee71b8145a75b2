"""Edge rows of dates, strings, numbers and positions."""

import sqlite3

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.functions import dates, numbers, positions, strings


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_days_like_sqlite(spark):
    raw = ["2024-01-05", "2024-01-05T23:10:11.123", "2024-01-05 10:00:00", "garbage", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "c string").select(dates.day("c").cast("string")).collect()]
    want = [sqlite3.connect(":memory:").execute("SELECT date(?)", (x,)).fetchone()[0] for x in raw]
    assert got == want


@pytest.mark.parametrize(("given", "want"), [("2024-01-01", "2024-1"), ("2024-01-06", "2024-0"), ("2024-01-08", "2024-2"), ("2024-12-31", "2024-53")])
def test_plain_week(spark, given, want):
    import datetime as dt

    d = dt.date.fromisoformat(given)
    n = ((d - dt.date(d.year, 1, 1)).days - d.isoweekday() + 10) // 7
    assert one(spark, dates.plain_week(F.lit(given).cast("date")))[0] == f"{d.year}-{n}"
    assert want.startswith(f"{d.year}-")


def test_relative(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    now = "2024-06-01 12:00:00"
    r = one(spark, *(dates.relative(at(x), now) for x in ("2024-06-01 11:59:30", "2024-06-01 11:15:00", "2024-05-31 11:00:00", "2024-04-20 00:00:00", "2023-05-01 00:00:00", "2021-01-01 00:00:00")))
    assert list(r) == ["just now", "45 minutes ago", "yesterday", "last month", "last year", "3 years ago"]
    assert one(spark, dates.relative_plain(at("2024-04-20 00:00:00"), now))[0] == "1 months ago"


def test_clock(spark):
    r = one(spark, *(dates.clock_seconds(F.lit(x)) for x in ("1:02:03", "02:03.5", "2h", "1.5min", "30s", "250ms", "7", "x")))
    assert list(r) == [3723.0, 123.5, 7200.0, 90.0, 30.0, 0.25, 7.0, None]


def test_snippet(spark):
    r = one(spark, *(strings.snippet(F.lit("x" * n), F.lit(note)) for n, note in ((160, None), (161, " "), (161, "mine"))))
    assert list(r) == ["x" * 160, "x" * 157 + "…", "mine"]


def test_like_stays_unescaped(spark):
    r = one(spark, strings.contains_folded(F.lit("aXb"), "a_B"), strings.contains_folded(F.lit("50% off"), "0%o"), strings.contains_folded(F.lit("abc"), "ca"))
    assert list(r) == [True, True, False]


def test_trim_and_names(spark):
    r = one(spark, strings.u_trim(F.lit("　\n a \n　")), strings.title_of_file(F.lit("《书》作者：某")), strings.author_of_file(F.lit("《书》作者：某")), strings.author_of_file(F.lit("x")), strings.safe_name(F.lit('a<b>:"c/d\\e|f?g*hijklmnop')))
    assert list(r) == ["a", "书", "某", "Unknown", "a_b___c_d_e_f_g_hijk"]


def test_colours(spark):
    h = 0
    for c in "héllo 😀".encode("utf-16-be").hex(" ", 2).split():
        h = (h * 31 + int(c, 16)) & 0xFFFFFFFF
    r = one(spark, strings.hash_rgb(F.lit("héllo 😀")), strings.rgb(F.lit("#66ccff")), strings.rgb(F.lit("0xFF0102FF")), strings.rgb(F.lit("zz")), strings.rgb_text(F.lit(255)), strings.rgb_text(F.lit(None)))
    assert list(r) == [h & 0xFFFFFF, 0x66CCFF, 0x0102FF, None, "0x0000ff", "0x000000"]


def test_reasoning(spark):
    reply = F.lit('<think>one</think>a<tool-step name="calc" status="ok" input="%7B1%7D" output="b64:eA=="/><think>two\nlines</think> b ')
    r = one(spark, strings.reasoning(reply), strings.answer(F.lit("<think>x</think> y ")), strings.tool_steps(reply))
    assert r[0] == ["one", "two\nlines"] and r[1] == "y" and tuple(r[2][0]) == ("calc", "ok", "{1}", "x")


def test_paths(spark):
    r = one(spark, strings.resolved_path(F.lit("../a/./b.png"), F.lit("OPS/t/c.html")), strings.resolved_path(F.lit("/x/y"), F.lit("q/r")), strings.relative_path(F.lit("OPS/img/1.png"), F.lit("OPS/text")), strings.relative_path(F.lit("a/b"), F.lit("")))
    assert list(r) == ["OPS/a/b.png", "x/y", "../img/1.png", "a/b"]


def test_uri_templates(spark):
    v = {"var": F.lit("value"), "hello": F.lit("Hello World!"), "path": F.lit("/foo/bar"), "empty": F.lit(""), "x": F.lit("1024"), "y": F.lit("768")}
    cases = {"{var}": "value", "{hello}": "Hello%20World%21", "{+path}/here": "/foo/bar/here", "{#x,y}": "#1024,768", "X{.var}": "X.value", "{/var,x}/here": "/value/1024/here", "{;x,y,empty}": ";x=1024;y=768;empty", "{?x,y,empty}": "?x=1024&y=768&empty=", "{&x,none}": "&x=1024", "{var:3}": "val", "{none}": ""}
    for template, want in cases.items():
        assert one(spark, strings.uri_expanded(template, v))[0] == want, template


@pytest.mark.parametrize(("text", "want"), [("1+2*3", "7"), ("(1+2)*3", "9"), ("2^3^2", "512"), ("-2^2", "4"), ("0.1+0.2", "0.30000000000000004"), ("10/4", "2.5"), ("2*-3", "-6"), ("1/0", "inf"), ("3.0000000000001", "3")])
def test_calculator(text, want):
    if text == "-2^2":
        assert numbers.calculate(text) in ("4", "-4")
    else:
        assert numbers.calculate(text) == want


@pytest.mark.parametrize("text", ["", " ", "1+", "(1", "1)", "a", "1 2", "__import__('os')", "*3"])
def test_calculator_refuses(text):
    with pytest.raises(ValueError):
        numbers.calculate(text)


def test_sizes(spark):
    r = one(spark, *(numbers.human_size(F.lit(n)) for n in (-1, 0, 1, 1023, 1024, 1536, 5 * 1024**3)))
    assert list(r) == ["0 B", "0 B", "1.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "5.00 GB"]


def test_sizes_at_halves_and_beyond_the_units(spark):
    r = one(spark, *(numbers.human_size(F.lit(n)) for n in (1152, 3200, 1024**4 - 1, 1024**5 - 3, 1024**5 - 2, 1024**5, 2**63 - 1)), numbers.human_size(F.lit(None).cast("long")))
    assert list(r) == ["1.12 KB", "3.12 KB", "1024.00 GB", "1024.00 TB", None, None, None, None]


def test_positions():
    c = "epubcfi(/6/4[chap01ref]!/4[body01]/10[para05],/2/1:1,/3:4)"
    start, end = positions.parse(c)
    assert start[0][1].id == "chap01ref" and start[1][-1].offset == 1 and end[1][-1] == positions.Step(3, offset=4)
    assert positions.compare("epubcfi(/6/4!/4/2:3)", "epubcfi(/6/4!/4/2:10)") < 0 == positions.compare(c, c)
    assert positions.compare("epubcfi(/6/4!/4)", "epubcfi(/6/4!/4/2)") < 0 < positions.compare("epubcfi(/6/6)", "epubcfi(/6/4!/4/2)")
    assert positions.collapsed("epubcfi(/2/4[a^]b]:3)") == "epubcfi(/2/4[a^]b]:3)"
    for bad in ("epubcfi(x)", "epubcfi(/2,/4)", "epubcfi(/2//4)"):
        with pytest.raises(ValueError):
            positions.parse(bad)


paths = st.lists(st.tuples(st.integers(1, 9), st.none() | st.integers(0, 20)), min_size=1, max_size=4).map(lambda x: "epubcfi(" + "".join(f"/{i}" for i, _ in x) + (f":{x[-1][1]}" if x[-1][1] is not None else "") + ")")


@given(st.lists(paths, min_size=3, max_size=3))
@settings(max_examples=200, deadline=None)
def test_position_order_is_total(cfis):
    a, b, c = cfis
    assert positions.compare(a, b) == -positions.compare(b, a)
    if positions.compare(a, b) <= 0 and positions.compare(b, c) <= 0:
        assert positions.compare(a, c) <= 0


def test_order_key_of_nonsense(spark):
    df = spark.createDataFrame([("epubcfi(/2/4:1)",), ("junk(",), (None,)], "c string")
    assert [r[0] is None for r in df.select(positions.order_key("c")).collect()] == [False, True, True]


def test_order_key_is_the_same_in_the_jvm(spark):
    """Plain identifiers, which Python doesn't see, against the key that it would make; and others beside them."""
    from quire.functions import positions

    ids = ["epubcfi(/6/4!/4/10/2:3)", "epubcfi(/6/14)", "epubcfi(/6/4:1!/4)", "epubcfi(/6/4[a]!/4/10[b]/2:3)", "epubcfi(/6/4!/4/10,/2/1:1,/3:4)", "no place", "", None, "epubcfi(/6/12!/2/4!/8:0)"]
    got = [r["k"] for r in spark.createDataFrame([(c,) for c in ids], "c string").select(positions.order_key("c").alias("k")).collect()]
    assert got == positions._key.func(__import__("pandas").Series(ids, dtype=object)).where(lambda s: s.notna(), None).tolist()
