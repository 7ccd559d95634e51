import pytest

from logspark.errors import PatternError, QueryError
from logspark.plans.nodes import Both, Call, Compare, Field, Literal, Not, Sum, render
from logspark.plans.parser import parse
from logspark.sources.patterns import Pattern


@pytest.mark.parametrize(
    "text,label",
    [
        ("select length(x)", "len(x)"), ("select mean(x)", "avg(x)"), ("select bucket(ts, 5m)", "bucket(ts, 300s)"), ("select 1.0", "1"),
        ("select 'it'", '"it"'), ("select a - (b - c)", "a - (b - c)"), ("select a - b - c", "a - b - c"), ("select SUBSTRING(a, 1)", "substr(a, 1)"),
        ("select count(*)", "count(*)"), ("select user.id", "user.id"), ("select NULL", "null"), ("select 250ms", "0.25s"),
    ],
)
def test_canonical_text(text, label):
    assert parse(text).items[0].label == label


def test_precedence():
    q = parse("select a where not a = 1 and b = 2")
    assert q.where == Both(Not(Compare("=", Field("a"), Literal("num", 1.0))), Compare("=", Field("b"), Literal("num", 2.0)))


def test_signs_and_comments():
    assert parse("select a -1").items[0].value == Sum("-", Field("a"), Literal("num", 1.0))
    assert parse("select -1 + .5").items[0].value == Sum("+", Literal("num", -1.0), Literal("num", 0.5))
    assert parse("select 5 --3").items[0].value == Literal("num", 5.0)
    assert parse("select a-b/c").items[0].value == Field("a-b/c")
    assert parse("select 'a\\%b'").items[0].value == Literal("str", "a\\%b")


def test_parenthesis_may_open_a_sum():
    assert isinstance(parse("select a where (a + b) > 5").where, Compare)
    assert isinstance(parse("select a where (a = 1 or b = 2) and c").where, Both)


@pytest.mark.parametrize(
    "text,column",
    [
        ("select level msg", 14), ('select msg where level == "erro', 27), ("select a where a = b = c", 22), ("select x where count(*) > 1", 16),
        ("select foo(1)", 8), ("select lower()", 8), ("select round(1, 2, 3)", 8), ("select sum(count(*))", 8), ("select sum(*)", 8),
        ("select msg, count(*) group by level", 8), ("select * group by a", 8), ("select a group by count(*)", 19), ("select a limit 1.5", 16),
        ("select a limit -1", 16), ("select a limit 5m", 16), ("select -5m", 8), ("select 1e3s", 8), ("select a where a ! b", 18), ("select", 7),
        ("select a as", 12), ("where a", 1), ("select a order", 15), ("select a where a not b", 22), ("select a limit 2 where b", 18),
    ],
)
def test_errors_have_a_column(text, column):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.column == column
    assert e.value.render().splitlines()[-1].index("^") == 1 + column


def test_group_keys_are_compared_by_structure():
    parse("select bucket(ts, 300s) group by bucket(ts, 5m)")
    parse("select format_time(bucket(ts, 5m)), concat(level, '!'), 5, now() group by bucket(ts, 5m), level")
    with pytest.raises(QueryError):
        parse("select bucket(ts, 300) group by bucket(ts, 5m)")


def test_grouped():
    assert parse("select count(*)").grouped and parse("select 1 having 1").grouped
    assert parse("select 1 order by count(*)").grouped
    assert not parse("select a order by b").grouped
    assert render(Call("now", ())) == "now()"


def test_pattern_translation():
    p = Pattern.compile(r"^(?<ip>\S+) (?P<n>\d{1,3}) (?'rest'.*)$")
    assert p.names == (("ip", 1), ("n", 2), ("rest", 3))
    assert p.java == r"^([^\s\x{85}\x{A0}\p{Z}]+) ([0-9]{1,3}) ([^\n]*)\z"


@pytest.mark.parametrize("text", ["(?<a>x", "x)", "(?<a>[x", "(?<a>x)**", "*(?<a>x)", "(?=x)(?<a>x)", "(?<a>x)(?<a>y)", "abc", r"(?<a>\q)", "(?<a>x{3,1})", "(?<1>x)", r"(?<a>\x4)"])
def test_pattern_errors(text):
    with pytest.raises(PatternError):
        Pattern.compile(text)
