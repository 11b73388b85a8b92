import random
import time

import pytest

from siftwarden.operators import logparse

CASES = [
    ("Jan  2 03:04:05 host app[7]: hi", ("--01-02T03:04:05", "", "app", "hi")),
    ("<34>Oct 11 22:14:15 host su: x", ("--10-11T22:14:15", "critical", "su", "x")),
    ('<165>1 2025-08-24T05:14:15.000003-07:00 h app 10 ID47 [a@1 b="]\\""] msg', ("2025-08-24T12:14:15", "info", "app", "msg")),
    ("<0>1 - h - - - -", ("", "critical", "", "")),
    ("[Wed Jan 01 13:18:04.620298 2025] [core:warn] [pid 4] retry", ("2025-01-01T13:18:04", "warn", "core", "retry")),
    ('ts=2025-01-01T18:22:33.171Z level=trace component=c msg="a b"', ("2025-01-01T18:22:33", "debug", "c", "a b")),
    ('logger=v lvl=err time="2025-01-01 18:22:33" msg="x=1 \\"q\\""', ("2025-01-01T18:22:33", "error", "v", 'x=1 "q"')),
    ("02.01.2025 09:51:07 vpn-gw/CRT: x", ("2025-01-02T09:51:07", "critical", "vpn-gw", "x")),
    ("W0103 19:59:29.134777      82 node_lease.go:6] retry", ("--01-03T19:59:29", "warn", "node_lease.go", "retry")),
    ("2025-01-04 16:26:22,330 ERROR [http-3] net.x.Loader - x", ("2025-01-04T16:26:22", "error", "net.x.Loader", "x")),
    ("2025-01-04 16:28:48,112 - ops.metrics - NOTICE - y", ("2025-01-04T16:28:48", "info", "ops.metrics", "y")),
    ("01/05/2025 12:06:28 AM | Level=Warning | Provider=Service Control Manager | EventID=7 | Message=m | n", ("2025-01-05T00:06:28", "warn", "Service Control Manager", "m | n")),
    ('{"time": 1735840771, "lvl": "FATAL", "service": "s", "msg": "m"}', ("2025-01-02T17:59:31", "critical", "s", "m")),
    ('{"@timestamp":1735840771999,"severity":"info","logger":"l"}', ("2025-01-02T17:59:31", "info", "l", "")),
]


@pytest.mark.parametrize(("line", "want"), CASES)
def test_layouts(line, want):
    assert logparse.parse(line) == [(1, 1, *want)]
    assert logparse.parse(f"\n{line}\r\n\r\n") == [(2, 2, *want)]


def test_continuations_and_blank_lines():
    text = "2025-01-04 16:28:48,112 - a - ERROR - x\nTraceback (most recent call last):\n  File \"a\", line 1\n\nValueError: y\n\nJan  2 03:04:05 h app: z\n    > 2025-01-04 16:28:48 ERROR quoted\n\n"
    assert [e[:2] for e in logparse.parse(text)] == [(1, 5), (7, 8)]


def test_pretty_json_is_one_entry():
    text = '{\n  "time": "2025-01-01 13:50:26",\n  "lvl": "info",\n  "ctx": {\n    "a": "}"\n  }\n}\n{"ts": "2025-01-01T00:00:00+02:00", "level": "warn"}'
    assert [e[:5] for e in logparse.parse(text)] == [(1, 7, "2025-01-01T13:50:26", "info", ""), (8, 8, "2024-12-31T22:00:00", "warn", "")]


def test_texts_without_header_and_without_content():
    assert logparse.parse("EventID: 1 | x\nPORT 3 open\n") == [(1, 2, "", "", "", "EventID: 1 | x\nPORT 3 open")]
    for empty in (None, "", " \n\t\r\n"):
        assert logparse.parse(empty) == []
    assert logparse.parse("{" * 5000)[0][:2] == (1, 1)
    assert logparse.parse('{"a": 1,\n')[0][:2] == (1, 1)


def test_impossible_dates_have_no_time():
    assert logparse.parse("Feb 31 03:04:05 h app: x")[0][2] == ""
    assert logparse.parse("31.02.2025 03:04:05 a/ERR: x")[0][2:5] == ("", "error", "a")


OTHER_HEADERS = [
    ("2025/01/02 03:04:05 ERROR db: lost", ("2025-01-02T03:04:05", "error", "db", "lost")),
    ("2025/01/02 03:04:05 server.go:33: up", ("2025-01-02T03:04:05", "", "server.go", "up")),
    ("2025-01-02T03:04:05.5+02:00 net.x.Loader - done", ("2025-01-02T01:04:05", "", "net.x.Loader", "done")),
    ("[2025-01-02 03:04:05,123] [main] WARN net.x.Y - m", ("2025-01-02T03:04:05", "warn", "net.x.Y", "m")),
    ("[2025-01-02T03:04:05Z] app.INFO: m", ("2025-01-02T03:04:05", "info", "app", "m")),
    ("2025/01/02 03:04:05 [error] 31#31: *1 open", ("2025-01-02T03:04:05", "error", "", "*1 open")),
    ("2025-01-02T03:04:05.1Z 140 [Warning] [MY-010] [Server] m", ("2025-01-02T03:04:05", "warn", "Server", "m")),
    ("2025-01-02T03:04:05+00:00 web-01 sshd[99]: m", ("2025-01-02T03:04:05", "", "sshd", "m")),
    ("2025-01-02 03:04:05.1 | INFO     | app.mod:run:12 - m", ("2025-01-02T03:04:05", "info", "app.mod", "m")),
    ("02-Jan-2025 03:04:05.1 SEVERE [main] org.x.Y m", ("2025-01-02T03:04:05", "error", "org.x.Y", "m")),
    ("Jan 02, 2025 03:04:05 PM org.x.Y m", ("2025-01-02T15:04:05", "", "org.x.Y", "m")),
    ("ERROR 2025-01-02 03:04:05,1 svc: m", ("2025-01-02T03:04:05", "error", "svc", "m")),
    ("2025-01-02 03:04:05 UTC [12] LOG:  m", ("2025-01-02T03:04:05", "", "", "LOG:  m")),
    ("2025-01-02 03:04:05 error reading file", ("2025-01-02T03:04:05", "", "", "error reading file")),
    ("1735840771.123 INFO x: y", ("2025-01-02T17:59:31", "info", "x", "y")),
]


@pytest.mark.parametrize(("line", "want"), OTHER_HEADERS)
def test_headers_without_a_layout_are_entries(line, want):
    known = "Jan  2 03:04:05 h app: z"
    assert logparse.parse(f"{known}\n{line}\n  more\n\n{known}") == [(1, 1, "--01-02T03:04:05", "", "app", "z"), (2, 3, *want[:3], want[3] + "\n  more"), (5, 5, "--01-02T03:04:05", "", "app", "z")]


@pytest.mark.parametrize("line", ["1735840771 items found", "Error: x 2025", "2025-01-02 report", "PORT 3 open", "[main] x", "java.io.IOException: at 10:00:00"])
def test_lines_without_a_time_in_front_continue(line):
    assert [e[:2] for e in logparse.parse(f"2025/01/02 03:04:05 ERROR db: lost\n{line}")] == [(1, 2)]


def test_result_does_not_depend_on_lines_seen_before():
    rng = random.Random(1)
    lines = [line for line, _ in CASES] + [f"Jan  2 03:04:05 host{c} {c}: hi" for c in "abcdef"]
    tree = logparse.TemplateTree()
    for _ in range(300):
        line = rng.choice(lines)
        assert logparse.parse(line, tree) == logparse.parse(line)
    assert not tree.counts


PROGRAMS = [
    ('2025/01/02 03:04:05 [error] 31#31: *1 open() "/x" failed, client: 10.0.0.1', ("2025-01-02T03:04:05", "error", "", '*1 open() "/x" failed, client: 10.0.0.1')),
    ('10.0.0.1 - frank [10/Oct/2025:13:55:36 -0700] "GET /a HTTP/1.1" 200 2326', ("2025-10-10T20:55:36", "", "", '"GET /a HTTP/1.1" 200 2326')),
    ("01-02 03:04:05.678  1234  5678 I ActivityManager: Start proc", ("--01-02T03:04:05", "info", "ActivityManager", "Start proc")),
    ("W/Zygote( 123): slow", ("", "warn", "Zygote", "slow")),
    ("INFO:root:started", ("", "info", "root", "started")),
    ("2025-01-02T03:04:05Z app[12]: m", ("2025-01-02T03:04:05", "", "app", "m")),
    ("[2025-01-02T03:04:05Z] app.ERROR: m", ("2025-01-02T03:04:05", "error", "app", "m")),
    ("Jan  2 03:04:05 2025 app: m", ("--01-02T03:04:05", "", "app", "m")),
    ("[Wed Jan 01 13:18:04 2025] [core:warn] [pid 4] [client 10.0.0.1:80] retry: x", ("2025-01-01T13:18:04", "warn", "core", "retry: x")),
]


@pytest.mark.parametrize(("line", "want"), PROGRAMS)
def test_lines_of_other_programs(line, want):
    known = "Jan  2 03:04:05 h app: z"
    assert logparse.parse(line) == [(1, 1, *want)]
    assert [e[2:5] for e in logparse.parse(f"{known}\n{line}\n more")] == [("--01-02T03:04:05", "", "app"), want[:3]]


def test_counts_tell_levels_without_case_or_punctuation():
    levels = "info error warning info debug".split()
    often = logparse.parse("\n".join(f"2025-01-02 03:04:05 {levels[i % 5]} line {i}" for i in range(40)))
    assert {e[3] for e in often} == {"info", "error", "warn", "debug"} and often[1][5] == "line 1"
    mixed = logparse.parse("\n".join(f"2025-01-02 03:04:05 {'error' if i % 3 else 'reading'} line {i}" for i in range(40)))
    assert {e[3] for e in mixed} == {""} and mixed[1][5] == "error line 1"


def test_leaves_that_agree_up_to_the_message_are_one_template():
    tree = logparse.TemplateTree()
    for line in ("2025-01-02 03:04:05 ERROR db: lost", "2025-01-02 03:04:05 INFO db: 5 found", "2025-01-02 03:04:05 INFO web: [x] found", "no header"):
        for key in logparse.keys_of(line):
            tree.learn(key)
    assert len(tree.counts) == 3 and tree.merged() == {"<time> <level> <name> <*>": 3}


def test_templates_are_shared_by_all_partitions(spark):
    rows = [(i, f"2025-01-02 03:04:05 {'info' if i % 2 else 'error'} line {i}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, raw string, text int").repartition(40)
    got = logparse.log_entries(df, "t", "k", "raw").select("entry_level", "template").distinct().collect()
    assert {tuple(r) for r in got} == {("info", "<time> <weak-level> line <*>"), ("error", "<time> <weak-level> line <*>")}


def test_long_lines_take_time_with_their_length():
    began = time.perf_counter()
    for line in ("2025-01-02 03:04:05 " + "a" * 500_000, "[" * 300_000, "a." * 200_000, "a=" + "b" * 400_000, "2025-01-02 03:04:05 a=\"" + "\\\"" * 200_000, "Jan  2 03:04:05 " + "h" * 400_000, "{" * 300_000, "9" * 400_000):
        assert len(logparse.parse(line + "\n" + line)) >= 1
    assert time.perf_counter() - began < 20


def test_frame(spark):
    rows = [(1, "Jan  2 03:04:05 h app: x", 5), (1, "Jan  2 03:04:05 h app: x", 5), (None, "y", 5), (2, None, 5), (3, "", 5)]
    df = spark.createDataFrame(rows, "k bigint, raw string, row_key bigint")
    got = logparse.log_entries(df, "t", "k", "raw").select("row_key", "first_line", "component").collect()
    assert sorted(map(tuple, got), key=str) == [("1", 1, "app"), ("1", 1, "app"), (None, 1, "")]
    assert logparse.log_entries(df.limit(0), "t", "k", "raw").count() == 0
