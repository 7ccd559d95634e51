"""Expressions over one record, many at a time: what each one gives, or that it is missing (None)."""

import json

import pytest

from logspark.engine import query
from logspark.sinks.writers import rows_of

RECORD = {
    "t": True, "f": False, "one": 1, "zero": 0, "s": "text", "empty": "", "arr": [1, {"id": 7}], "arr0": [], "obj": {"k": 1, "0": "z"}, "obj0": {},
    "nil": None, "code": "500", "pad": " 42 ", "inf": "inf", "unit": "120ms", "clock": "12:30", "day": "2026-07-27", "exp": "1e5x", "flt": 1.0,
    "big": 1300, "neg": -2.5, "uni": "ÀÉÎ", "pct": "100%", "under": "a_b", "when": "2026-07-27T09:14:02Z", "east": "2026-07-27T09:14:02.5+02:00",
    "ms": 1785143642000, "roll": "2026-02-31", "badoff": "2026-07-27T09:14:02+02:0", "dots": "a.b", "a.b": "flat", "a": {"b": "nested"}, "word": "true",
}

VALUES = {
    "lower(uni)": "àéî", "upper(s)": "TEXT", "upper(one)": "1", "upper(nil)": None, "len(s)": 4, "len(arr)": 2, "len(obj)": 2, "len(one)": None, "len(nil)": None,
    "substr(s, 1)": "ext", "substr(s, -3, 2)": "ex", "substr(s, -99, 2)": "te", "substr(s, 9)": "", "substr(s, 1, 0)": "", "substr(s, nope)": None, "substr(s, 1.9, 1)": "e",
    'trim(" \\tx ")': "x", 'contains(s, "ex")': True, 'contains(s, "")': True, 'starts_with(code, 5)': True, 'ends_with(s, "x")': False, "contains(nope, s)": None,
    'replace(s, "t", "-")': "-ex-", 'replace(s, "", "-")': "text", "concat(s, nil, one, nope, t)": "text1true", "concat(nil, nope)": None,
    "coalesce(nope, nil, code)": "500", "coalesce(nope, one, s)": 1, "coalesce(nil)": None, "num(code)": 500, "num(pad)": 42, "num(t)": 1, "num(unit)": 120,
    "num(clock)": 12, "num(day)": None, "num(exp)": 1, "num(inf)": None, "num(arr)": None, "abs(neg)": 2.5, "floor(neg)": -3, "ceil(neg)": -2,
    "round(neg)": -3, "round(1.005, 2)": 1, "round(1234.5, -2)": 1235, "round(2.345, 2)": 2.35, "duration_ms(one)": 1, 'duration_ms("1.5s")': 1500, 'duration_ms("2m")': 120000,
    'duration_ms("300")': 300, 'duration_ms("-5s")': None, "duration_ms(t)": None, 'duration_ms("junk")': None, "ts(when)": 1785143642, "ts(east)": 1785136442.5, "ts(ms)": 1785143642,
    "ts(roll)": 1772496000, "ts(badoff)": None, "ts(s)": None, "ts(t)": None, "format_time(when)": "2026-07-27T09:14:02Z", "format_time(east)": "2026-07-27T07:14:02.500Z",
    'format_time(when, "+02:00")': "2026-07-27T11:14:02+02:00", 'format_time(when, "-0330")': "2026-07-27T05:44:02-03:30", 'format_time(when, "mars")': None, "bucket(when, 5m)": 1785143400,
    "bucket(when, 0)": None, "one + unit": 121, "one - s": None, "one + t": 2, "arr.1.id": 7, "arr.9": None, "obj.0": "z", "obj.k": 1, "s.x": None, "5m": 300, "a.b": "flat",
    "format_time(0)": "1970-01-01T00:00:00Z", "flt": 1.0, "concat(flt)": "1.0", "concat(big + 0.5)": "1300.5", "nil": "null", "lower(nope)": None, "5": 5,
}

CONDITIONS = {
    'level != 1': False, 'not (level = 1)': True, "code = 500": True, "code > 499.5": True, 'code = "500"': True, '"10" < "9"': True, "pad = 42": True, "inf > 0": False, "inf != 1": True,
    "s = 5": False, "s != 5": True, "s < 5": False, "t = 1": True, "t > f": True, 't = "TRUE"': True, 'word = true': True, "nil = null": True, "nil <= null": False, "nil >= null": False,
    "nil != null": False, "nil = 0": False, "nil != 0": True, "nope != null": False, "arr = arr": True, "arr <= arr": False, "arr != obj": True, "obj = s": False, "flt = 1": True,
    "t": True, "f": False, "one": True, "zero": False, "s": True, "empty": False, "arr": True, "arr0": False, "obj": True, "obj0": False, "nil": False, "nope": False, "not nope": True,
    's like "te%"': True, 's like "ext"': False, 's like "%ex%"': True, 'pct like "100\\%"': True, 's like "%\\%"': False, 'under like "a_b"': True, 's like "t__t"': False, 'one like "1"': True,
    'nil like "%"': False, 'nil not like "%"': False, 'nope not like "x"': False, 's not like "x%"': True, "s like concat('t', '%', 't')": True, 's like "t%x%t"': True, 's like "text%text"': False,
    "not t and f": False, "f or t and t": True, "one = one": True, "code = one": False, "one < code": True, "one <> zero": True, "big == 1300": True, "(one + one) = 2": True,
    "day > ts(0)": False, "exp = 1": False, 'uni > "z"': True,
}


def test_values(lines):
    exprs, row, source = list(VALUES), [], lines([json.dumps(RECORD)])
    for at in range(0, len(exprs), 12):
        some = exprs[at : at + 12]
        row += next(rows_of(query("select " + ", ".join(f"{e} as c{i}" for i, e in enumerate(some)), source)))
    got = {e: None if x is None else ("null" if x == "null" else json.loads(x)) for e, x in zip(exprs, row, strict=True)}
    assert {e: (got[e], VALUES[e]) for e in exprs if got[e] != VALUES[e] or isinstance(got[e], bool) != isinstance(VALUES[e], bool)} == {}


def test_conditions(lines):
    source = lines([json.dumps(RECORD)])
    wrong = {}
    texts = list(CONDITIONS)
    # Each in positive place, and under `not`, where it has to be the opposite.
    from logspark.plans.compiler import Compiler, Fields, Scope
    from logspark.plans.parser import parse

    df = source.records()
    compiler = Compiler(parse("select a"))
    cols, fields = [], Fields(source.field)
    for i, c in enumerate(texts):
        for sign in ("", "not "):
            where = parse(f"select a where {sign}({c})").where
            cols.append(compiler.condition(where, Scope(df.schema, fields)).alias(f"{sign.strip()}{i}"))
    row = fields.attach(df).select(*cols).first()
    for i, c in enumerate(texts):
        if bool(row[f"{i}"]) != CONDITIONS[c] or bool(row[f"not{i}"]) == CONDITIONS[c]:
            wrong[c] = (row[f"{i}"], row[f"not{i}"])
    assert wrong == {}


def run(source, text):
    df = query(text, source, ordered=True)
    return [[None if x is None else x for x in row] for row in rows_of(df)]


def test_grouping(lines):
    source = lines(['{"k":1,"v":3}', '{"k":"1","v":"2"}', '{"v":1}', '{"k":null,"v":7}', '{"k":1.0}', '{"k":1,"v":null}', '{"k":1,"v":"x"}'])
    assert run(source, "select k, count(*), count(v), sum(v), first(v), last(v) group by k") == [
        ["1", "3", "3", "3", "3", '"x"'], ['"1"', "1", "1", "2", '"2"', '"2"'], [None, "1", "1", "1", "1", "1"], ["null", "1", "1", "7", "7", "7"], ["1.0", "1", "0", None, None, None],
    ]
    assert run(source, "select count_distinct(v), count_distinct(k)") == [["6", "4"]]
    assert run(source, "select k, count(*) as n group by k limit 2") == [["1", "3"], ['"1"', "1"]]
    assert run(source, "select count(*) where v = 99") == []
    assert run(source, "select k, count(*) as n group by k having n > 1") == []  # a select alias is not seen there
    assert run(source, "select k group by k as key having key = 1 and count(*) > 1") == [["1"]]


def test_mixed_extremes(lines):
    assert run(lines(['{"v":10}', '{"v":"9"}', '{"v":"x"}']), "select min(v), max(v)") == [['"9"', "10"]]
    assert run(lines(['{"v":"b"}', '{"v":"a"}', '{"v":"10"}']), "select min(v), max(v)") == [['"10"', '"b"']]
    assert run(lines(['{"v":null}', '{"v":1}']), "select min(v), max(v)") == [["null", "null"]]


def test_order(lines):
    source = lines(['{"id":1,"v":2}', '{"id":2}', '{"id":3,"v":1}', '{"id":4,"v":2}', '{"id":5,"v":10}'])
    assert run(source, "select id order by v") == [["3"], ["1"], ["4"], ["5"], ["2"]]
    assert run(source, "select id order by v desc") == [["5"], ["1"], ["4"], ["3"], ["2"]]
    assert run(source, "select id as x order by x desc limit 2") == [["5"], ["4"]]
    assert run(source, "select v as id, id order by id limit 1") == [["1"]]


@pytest.mark.parametrize("text,want", [("select a.b, a", ["a.b", "a"]), ("select count(*) as n, count(*)", ["n", "count(*)"])])
def test_labels(lines, text, want):
    assert query(text, lines(["{}"])).columns == want


def test_scan_gets_filters_and_columns(spark, tmp_path):
    spark.range(10).selectExpr("id as value", "id as other", "cast(id as string) as text").write.parquet(str(tmp_path / "t"))
    df = query('select text where value > 5 and text like "a%" order by value limit 3', spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,5)" in plan and "StringStartsWith(text,a)" in plan and "TakeOrderedAndProject" in plan and "other" not in plan


def test_mixed_kinds(lines):
    cells = lambda values: lines([json.dumps({"v": v}) for v in values])
    for values, low, high in (
        ([5, "NaN", "7"], "5", '"7"'), (["10", 50], '"10"', "50"), (["10", 5], "5", '"10"'), (["b", "a", 3], '"a"', '"b"'), ([True, 0, 7], "0", "7"),
        ([None, 3], "null", "null"), (["10", "9"], '"10"', '"9"'), ([" 7 ", 6.5], "6.5", '" 7 "'),
    ):
        assert run(cells(values), "select min(v) as lo, max(v) as hi") == [[low, high]], values


def test_duplicate_labels_of_two_kinds(lines):
    source = lines(['{"a":"X","b":3}', '{"a":"Y"}'])
    assert run(source, "select lower(a) as x, b as x") == [["3"], ['"y"']]


def test_odd_keys(lines):
    odd = {'a"b': 1, "it's": 2, "what?": 3, "a\\b": 4, "": 5, "x.y": 6, "both'\"": 7, "[0]": 8}
    source = lines([json.dumps(odd), '="v" q"k=1 k=2'])
    got = query("select *", source)
    assert got.columns == [*odd, '"v"', 'q"k', "k"]
    rows = [dict(zip(got.columns, r, strict=True)) for r in rows_of(got)]
    assert [rows[0][k] for k in odd] == [str(v) for v in odd.values()] and rows[1]["k"] == "2" and rows[1]['q"k'] == "1"


def test_numbers_as_written(lines):
    source = lines(['{"v":1e400}', '{"v":"1e400"}', '{"v":1.0}', '{"v":1}', '{"v":-2e3}', '{"v":"\\"1e999"}', '{"v":-1e999}'])
    assert run(source, "select v") == [['"1e400"'], ["1.0"], ["1"], ["-2000.0"], ['"\\"1e999"']]
    assert source.skipped() == 2
