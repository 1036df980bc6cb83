import re
from datetime import datetime

import pytest

from tessera.operators.loglines import EarleyTrie, GRAMMAR, entries, header, log_entries, read_grammar

SEEN = datetime(2026, 8, 13, 20, 0, 0)
LINES = [
    ('192.0.2.5 - - [14/Jun/2026:23:15:07 +0530] "GET /x HTTP/1.1" 200 1 "m"', ("2026-06-14 17:45:07", "", "")),
    ('{"level": 30, "time": 1773248625727, "name": "a.b", "msg": "x"}', ("2026-03-11 17:03:45", "INFO", "a.b")),
    ('{"ts": "2026-04-24T19:11:01Z", "level": "debug", "logger": "replica", "msg": "a \\"q\\" {"}', ("2026-04-24 19:11:01", "DEBUG", "replica")),
    ('{"severity": "CRITICAL", "component": "c", "message": "name", "@timestamp": "2026-04-29T19:09:46.079896+02:00"}', ("2026-04-29 17:09:46", "FATAL", "c")),
    ('time="2026-05-20T09:05:05Z" level=warning component=sensor msg="a b"', ("2026-05-20 09:05:05", "WARN", "sensor")),
    ("2026-04-24 19:07:29,692 - domain.handler - ERROR - m", ("2026-04-24 19:07:29", "ERROR", "domain.handler")),
    ("2026-04-24 21:39:25 -08:00 | info | tonorid | m", ("2026-04-25 05:39:25", "INFO", "tonorid")),
    ("2026/06/14 18:13:25 [emerg] 2060#0: *514 m", ("2026-06-14 18:13:25", "FATAL", "")),
    ("2026-06-02T12:35:34.519Z WARN  [notify.panel] m", ("2026-06-02 12:35:34", "WARN", "notify.panel")),
    ("I0813 08:07:10.428023   2330 ReportLoader.cc:316] m", ("2026-08-13 08:07:10", "INFO", "ReportLoader.cc")),
    ("04-Mar-2026 22:33:57.175 FINE template - m", ("2026-03-04 22:33:57", "DEBUG", "template")),
    ("04-08 05:18:28.634  2000  2100 V tipelad: m", ("2026-04-08 05:18:28", "TRACE", "tipelad")),
    ("1772193342.150 DEBUG perezod: m", ("2026-02-27 11:55:42", "DEBUG", "perezod")),
    ("May  9 13:23:32 web-02 CatalogRouter[2330]: m", ("2026-05-09 13:23:32", "", "CatalogRouter")),
    ("16:29:26  WARN (domain.widget) m", ("2026-08-13 16:29:26", "WARN", "domain.widget")),
    ("[INFO]  m", ("", "INFO", "")),
    ("ERROR:    m", ("", "ERROR", "")),
]
OTHERS = ["Traceback (most recent call last):", '  File "x.py", line 3, in f', "ValueError: bad", "{", '  "level": 3', '("rows": 9, "name": "x")', '{"rows": 9, "name": "x"}', "SELECT id, token", "collecting 7 items", "", "    ERROR: indented", "error: lower case compiler note", "12 more"]


@pytest.mark.parametrize(("line", "want"), LINES)
def test_layouts(line, want):
    assert header(EarleyTrie(), line, SEEN)[:3] == want


@pytest.mark.parametrize("line", OTHERS)
def test_continuations(line):
    assert header(EarleyTrie(), line, SEEN) is None


def test_shared_charts_don_t_change_the_result():
    shared = EarleyTrie()
    for _ in range(2):
        for line in [x for x, _ in LINES] + OTHERS:
            assert header(shared, line, SEEN) == header(EarleyTrie(), line, SEEN)


def test_earley_against_all_derivations():
    """On a small ambiguous grammar: the best of all derivations, by brute force."""
    grammar = "S = A A 1 | A B 5 | B 2\nA = x 1 | x x 4\n@f = x 0\nB = @f x 1 | x 0\n"
    rules, by = read_grammar(grammar)

    def every(symbol, n):
        if symbol not in by:
            return [0.0] if n == 1 else []
        out = []
        for r in by[symbol]:
            _, right, weight = rules[r]

            def split(k, left, score, right=right, weight=weight):
                if k == len(right):
                    if left == 0:
                        out.append(score + weight)
                    return
                for take in range(1, left + 1):
                    for s in every(right[k], take):
                        split(k + 1, left - take, score + s)

            split(0, n, 0.0)
        return out

    for n in range(1, 5):
        trie = EarleyTrie(grammar)
        node, sets = trie.root, [trie.root.items]
        for _ in range(n):
            node = trie.step(node, "x", sets) if node else None
            sets.append(node.items if node else {})
        all_ = every("S", n)
        assert (max(all_) if all_ else None) == (node.accept[0] if node and node.accept else None), n


def test_grammar_has_all_its_parts():
    rules, by = read_grammar(GRAMMAR)
    names = {w for _, right, _ in rules for w in right}
    assert not [w for w in names if w.startswith("@") and w not in by]


def test_entries_cover_lines():
    text = "noise\n" + LINES[5][0] + "\r\nTraceback\n  more\r\n\x1b[32m[INFO]\x1b[0m  next\n"
    got = entries(EarleyTrie(), "r", text, SEEN, True)
    assert [(e[1], e[2], e[7]) for e in got] == [(1, 1, True), (2, 4, False), (5, 6, False)]
    assert got[1][6] == "m\nTraceback\n  more" and got[2][4] == "INFO"
    assert "\x1b" not in got[2][6]


def test_table(spark):
    rows = [(1, None, SEEN), (2, "", SEEN), (3, "[INFO] a\n[WARN] b", None), (3, "[INFO] a\n[WARN] b", None), (4, "x" * 300_000, SEEN), (5, "10:00:00 INFO (a) b", None)]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "run_id bigint, stdout string, captured_at timestamp_ntz, level string, first_line int")
    got = {(r.record_id, r.first_line, r.last_line, r.entry_ts, r.level) for r in log_entries(df, "run_id", "stdout", "captured_at", message=False).collect()}
    assert got == {("3", 1, 1, "", "INFO"), ("3", 2, 2, "", "WARN"), ("5", 1, 1, "", "INFO")}
    assert log_entries(df.limit(0), "run_id", "stdout", "captured_at").count() == 0


def test_plain_words_are_not_time():
    assert not re.search(r"\d", header(EarleyTrie(), "[INFO]  12:00", SEEN)[0])


def test_any_key_may_come_first():
    lines = ["host=web1 level=error ts=2026-01-02T03:04:05Z msg=x", "pid=7 level=info time=2026-01-02T03:04:06Z", "request_id=a1 env=prod level=warn", "_k=v level=debug", "Zone=eu level=info", "env=prod host=web1"]
    got = entries(EarleyTrie(), "r", "\n".join(lines), None, False)
    assert [(e[1], e[2], e[3], e[4]) for e in got] == [(1, 1, "2026-01-02 03:04:05", "ERROR"), (2, 2, "2026-01-02 03:04:06", "INFO"), (3, 3, "", "WARN"), (4, 4, "", "DEBUG"), (5, 6, "", "INFO")]


def test_messages_of_every_origin(spark):
    from tessera.operators.loglines import entry_messages

    at = datetime(2026, 1, 2)
    runs = spark.createDataFrame([(1, "ERROR: one\nmore", "lead\nWARNING: two", at)] * 2, "run_id bigint, stdout string, stderr string, captured_at timestamp")
    logs = spark.createDataFrame([("e", "log", "INFO: three", at), ("f", "code", "INFO: four", at)], "evidence_id string, evidence_type string, content string, collected_at timestamp")
    got = {(r.origin, r.record_id, r.first_line, r.last_line, r.message, r.unparsed) for r in entry_messages(logs, runs).collect()}
    assert got == {("stdout", "1", 1, 2, "one\nmore", False), ("stderr", "1", 1, 1, "lead", True), ("stderr", "1", 2, 2, "two", False), ("evidence", "e", 1, 1, "three", False)}


def test_continuations_are_rules():
    trie = EarleyTrie()
    for line in ("    at a.b.C(D.java:5)", "Caused by: x.Y: z", "plain text", "  2026-04-24 19:07:29,692 - a - ERROR - m"):
        assert trie.parse(line)[1][0][0] == "more" and header(trie, line, SEEN) is None, line
    assert trie.parse("2026-04-24 19:07:29,692 - a - ERROR - m")[1][0][0] == "when"


def test_memory_has_a_bound(monkeypatch):
    from tessera.operators import loglines

    monkeypatch.setattr(loglines, "MOST", 50)
    trie = EarleyTrie()
    for line, want in LINES * 3:
        assert header(trie, line, SEEN)[:3] == want
    assert trie.nodes <= 50 + loglines.SHARED
    long = "{" + ", ".join(f'"k{i}": {i}' for i in range(20_000)) + ', "level": "error", "ts": "2026-04-24T19:11:01Z"}'
    assert header(trie, long, SEEN)[:3] == ("2026-04-24 19:11:01", "ERROR", "")
    assert trie.nodes <= 50 + 2 * loglines.SHARED


def test_any_key_first():
    trie = EarleyTrie()
    for line in ("pid=3 level=info time=2026-04-24T19:11:01Z", "request_id=9 level=error ts=2026-04-24T19:11:01Z", "host=web1 lvl=warn time=2026-04-24T19:11:01Z"):
        assert entries(trie, "r", line, SEEN, False)[0][3] == "2026-04-24 19:11:01", line
