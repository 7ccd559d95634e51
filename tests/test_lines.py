"""Line formats, writers, the command line and following."""

import io
import threading
import time

import pytest

from logspark import cli
from logspark.engine import query
from logspark.sinks import writers
from logspark.sources.lines import from_files

LOG = [
    '{"at":"2026-03-01T10:01:00Z","level":"info","msg":"up","http":{"status":200}}',
    'level=warn msg="disk \\"a|b\\" at 91%" free=1e3 ok dev=/dev/sda v=1.2.3 n=007 none= q=""',
    "nothing of any kind here",
    '{"at":"2026-03-01T10:07:00Z","level":"error","msg":"down\\nhard","err":null,"cached":true}',
    "",
    '{"broken": ',
    "[1, 2]",
    'level=info msg="open',
    "=x k=1 k=2\r",
]


def cells(df):
    return [list(r) for r in writers.rows_of(df)]


def test_lines(lines):
    source = lines(LOG)
    assert source.skipped() == 4
    assert cells(query("select level, msg, err, cached, http.status", source)) == [
        ['"info"', '"up"', None, None, "200"], ['"warn"', '"disk \\"a|b\\" at 91%"', None, None, None], ['"error"', '"down\\nhard"', "null", "true", None], [None] * 5,
    ]
    assert cells(query("select free, ok, dev, v, n, none, q, k where ok or k", source)) == [
        ["1000.0", "true", '"/dev/sda"', '"1.2.3"', "7", "null", '""', None], [None] * 7 + ["2"],
    ]
    assert cells(query("select num(free) where ok", source)) == [["1000"]]


def test_pattern(lines):
    source = lines(["10.0.0.1 GET /a 200", "10.0.0.2 PUT /b -", "x"], r"^(?<ip>[\d.]+) (?<verb>[A-Z]+) (?<path>\S+) (?:(?<status>\d+)|-)$")
    assert source.skipped() == 1
    assert cells(query("select ip, verb, path, status", source)) == [['"10.0.0.1"', '"GET"', '"/a"', "200"], ['"10.0.0.2"', '"PUT"', '"/b"', None]]


def test_star_keeps_the_order_of_keys(lines):
    assert query("select *", lines(['{"b":1,"a":2}', '{"c":3,"a":4}'])).columns == ["b", "a", "c"]


def write(fmt, columns, rows):
    out = io.StringIO()
    writers.WRITERS[fmt](columns, rows, out)
    return out.getvalue()


def test_writers():
    rows = [['"x|y"', "1"], [None, '{"a":[1,2]}'], ['"a,\\"b\\"\\nc"', "null"]]
    assert write("json", ["k", "n"], rows) == '{"k":"x|y","n":1}\n{"n":{"a":[1,2]}}\n{"k":"a,\\"b\\"\\nc","n":null}\n'
    assert write("csv", ["k", "n"], rows) == 'k,n\nx|y,1\n,"{""a"":[1,2]}"\n"a,""b""\nc",null\n'
    assert write("csv", ["k"], []) == ""
    assert write("markdown", ["k", "n"], rows[:1]) == "| k | n |\n| --- | --- |\n| x\\|y | 1 |\n"
    assert write("markdown", ["k"], [['"a\\nb\\\\"']]) == "| k |\n| --- |\n| a<br>b\\\\ |\n"
    assert write("table", ["k", "name"], [['"long value"', None], ['"a\\nb"', "2"]]) == "k           name\n----------  ----\nlong value\na\\nb        2\n"
    assert write("table", ["k"], []) == "k\n-\n"
    out = io.StringIO()
    table = writers.GrowingTable(out)
    table.write(["k"], [['"a"']])
    table.write(["k"], [['"abc"'], ['"b"']])
    assert out.getvalue() == "k\n-\na\nk\n---\nabc\nb\n"


def test_arguments():
    o = cli.parse_args(["-f", "JSON", "select a", "x.log", "--pattern=(?<a>.)", "-q", "-"])
    assert (o.format, o.query, o.files, o.pattern, o.quiet) == ("json", "select a", ["x.log", "-"], "(?<a>.)", True)
    assert cli.parse_args(["--", "-q", "f"]).query == "-q"
    assert cli.parse_args(["-V"]).info.startswith("logspark ")
    for bad in (["-x", "q"], [], ["-f"], ["-f", "xml", "q"], ["-F", "q"], ["-F", "q", "a", "b"], ["-F", "q", "-"]):
        with pytest.raises(cli.UsageError):
            cli.parse_args(bad)


def test_command_line(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("\n".join(LOG[:4]) + "\n")
    b.write_text('{"level":"fatal"}')
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["select level, count(*) as n group by level", str(a), str(b)], out, err) == 0
    assert out.getvalue() == "level  n\n-----  -\ninfo   1\nwarn   1\nerror  1\nfatal  1\n"
    assert err.getvalue() == "logspark: skipped 1 malformed line\n"
    assert cli.main(["select level msg", str(a)], out, err) == 2
    assert "column 14" in err.getvalue()
    assert cli.main(["select level", str(tmp_path / "none.log")], out, err) == 1


def test_limit_reads_once(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("no record\n" + '{"a":1}\n' * 5)
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["-f", "json", "select a limit 2", str(path)], out, err) == 0
    assert out.getvalue() == '{"a":1}\n' * 2 and err.getvalue() in ("", "logspark: skipped 1 malformed line\n")


def test_files_keep_their_order(spark, tmp_path):
    paths = []
    for i, n in enumerate((3, 500, 2)):
        p = tmp_path / f"{9 - i}.log"
        p.write_text("".join(f"f={i} n={k}\n" for k in range(n)))
        paths.append(str(p))
    got = cells(query("select f, count(*), first(n), last(n) group by f", from_files(spark, paths), ordered=True))
    assert got == [["0", "3", "0", "2"], ["1", "500", "0", "499"], ["2", "2", "0", "1"]]


def test_bulk_files(spark, lines, tmp_path):
    df = query("select level, err, http where level", lines(LOG))
    writers.write_files(df.coalesce(1), "json", str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert text.splitlines() == ['{"level":"info","http":{"status":200}}', '{"level":"warn"}', '{"level":"error","err":null}']


def test_follow(spark, tmp_path):
    from logspark.streaming.follow import check, follow

    for bad in ("select count(*)", "select a order by a"):
        with pytest.raises(ValueError):
            check(bad)
    path = tmp_path / "grow.log"
    path.write_text('{"level":"error","n":1}\n{"level":"info","n":2}\n{"level":"err')
    got, ready = [], threading.Event()

    def sink(columns, rows):
        got.extend(r[0] for r in rows)
        ready.set()

    stream = follow(spark, 'select n where level = "error" limit 3', str(path), sink, checkpoint=str(tmp_path / "cp"))
    try:
        assert ready.wait(60)
        with path.open("a") as f:
            f.write('or","n":3}\n')
        deadline = time.time() + 60
        while len(got) < 2 and time.time() < deadline:
            time.sleep(0.1)
        path.write_text('{"level":"error","n":4}\n')  # shorter: read anew
        assert stream.limit_reached.wait(60)
    finally:
        stream.stop()
    assert got == ["1", "3", "4"]


def test_many_files_keep_their_order(spark, tmp_path):
    from logspark.engine import query
    from logspark.sources.lines import from_files

    paths = []
    for i in range(70):
        path = tmp_path / f"{(i * 37) % 70:02d}.log"
        path.write_text("".join(f"n={i} pad={'x' * (100 * (i % 7))}\n" for _ in range(1 + i % 3)))
        paths.append(str(path))
    got = [r[0] for r in query("select n", from_files(spark, paths), ordered=True).collect()]
    assert [x.toPython() for x in got] == [i for i in range(70) for _ in range(1 + i % 3)]
