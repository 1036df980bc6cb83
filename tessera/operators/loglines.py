"""Log lines of many programs into entries, by a weighted grammar.

The lexer turns the head of a line into token classes. A weighted context-free
grammar describes headers, fields and continuations; an Earley parser keeps the
highest-scoring derivation of each line: an entry's header or a continuation of
the entry before it. Charts of the first ``SHARED`` tokens are kept in a trie keyed by
token class, so that a line whose header was seen before costs one lookup a
token; the trie is begun anew beyond ``MOST`` nodes, so memory has a bound.
The message isn't lexed (apart from JSON and key=value lines, whose fields may
stand anywhere): once only the message can follow, parsing ends.

Defined results for odd input: null and empty texts give no entries; lines
before the first header belong to none and come out as ``unparsed``; control
codes belong to no field; a text of one endless line is one line; repeated
texts give equal rows. Lines are what stands between LFs: a last LF begins a last,
empty line, which belongs to the last entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Names and numbers of levels, mapped to the common six.
LEVELS = {
    "TRACE": "TRACE", "VERBOSE": "TRACE", "FINER": "TRACE", "FINEST": "TRACE", "V": "TRACE", "10": "TRACE",
    "DEBUG": "DEBUG", "FINE": "DEBUG", "CONFIG": "DEBUG", "D": "DEBUG", "20": "DEBUG", "DBG": "DEBUG",
    "INFO": "INFO", "INFORMATION": "INFO", "NOTICE": "INFO", "I": "INFO", "30": "INFO",
    "WARN": "WARN", "WARNING": "WARN", "W": "WARN", "40": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR", "E": "ERROR", "50": "ERROR",
    "FATAL": "FATAL", "CRITICAL": "FATAL", "CRIT": "FATAL", "EMERGENCY": "FATAL", "EMERG": "FATAL", "ALERT": "FATAL", "PANIC": "FATAL", "F": "FATAL", "A": "FATAL", "C": "FATAL", "60": "FATAL",
}
MONTHS = {m: i for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1)}
_WORDS = "|".join(sorted((w for w in LEVELS if len(w) > 2 and not w.isdigit()), key=len, reverse=True))

#: Token classes in the order in which the lexer tries them.
LEXER = [
    ("ISO", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"),
    ("CLF", r"\[\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}\]"),
    ("DATE", r"\d{4}-\d\d-\d\d(?=[ T])"),
    ("SDATE", r"\d{4}/\d\d/\d\d(?= )"),
    ("MDATE", r"\d{1,2}-[A-Z][a-z]{2}-\d{4}(?= )"),
    ("MMDD", r"\d\d-\d\d(?= \d\d:)"),
    ("GLOG", r"[IWEFDV]\d{4}(?= \d\d:\d\d:\d\d)"),
    ("EPOCH", r"\d{10}\.\d{1,9}(?= )"),
    ("TIME", r"\d\d:\d\d:\d\d(?:[.,]\d+)?(?![\d:])"),
    ("ZONE", r"[+-]\d\d:?\d\d(?= )|(?:UTC|GMT|Z)(?= )"),
    ("IP", r"\d{1,3}(?:\.\d{1,3}){3}(?![\w.])"),
    ("KTIME", r"(?:time|ts|timestamp|at)=(?=[\"\d])"),
    ("KLEVEL", r"(?:level|lvl|severity)=(?=[\"A-Za-z])"),
    ("KCOMP", r"(?:component|logger|module|source|app)="),
    ("KEY", r"[A-Za-z_][\w.\-]*=(?! )"),
    ("ULEVEL", rf"(?:{_WORDS})(?![\w./$-])"),
    ("LLEVEL", rf"(?:{_WORDS.lower()})(?![\w./$-])"),
    ("LETTER", r"[VDIWEFAC](?= )"),
    ("MONTH", rf"(?:{'|'.join(MONTHS)})(?= [ \d]\d )"),
    ("FILE", r"[A-Za-z_][\w.\-/$]*\.(?:cc|cpp|c|h|go|py|rs|java)(?=:\d)"),
    ("NUM", r"-?\d+(?:\.\d+)?(?![\w.])"),
    ("JTIME", r"\"(?:@timestamp|timestamp|time|ts|date)\"(?=\s*:)"),
    ("JLEVEL", r"\"(?:level|severity|lvl|levelname|log\.level)\"(?=\s*:)"),
    ("JCOMP", r"\"(?:component|logger|name|module|source|tag)\"(?=\s*:)"),
    ("STR", r"\"(?:[^\"\\]|\\.)*\""),
    ("NAME", r"[A-Za-z_](?:[\w./$-]*[\w$])?"),
    ("WS", r"[ \t]+"),
    ("P", r"[^\w\s]"),
]


def _lexers() -> dict:
    """For each first character the matcher of the classes that can begin with
    it, in the lexer's order."""
    heads = {
        "digit": ("0123456789", "ISO DATE SDATE MDATE MMDD EPOCH TIME IP NUM"),
        "sign": ("+-", "ZONE NUM P"),
        "quote": ('"', "JTIME JLEVEL JCOMP STR P"),
        "open": ("[", "CLF P"),
        "blank": (" \t", "WS"),
        "lower": ("abcdefghijklmnopqrstuvwxyz_", "KTIME KLEVEL KCOMP KEY LLEVEL FILE NAME"),
        "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "GLOG ZONE KEY ULEVEL LETTER MONTH FILE NAME"),
    }
    patterns = dict(LEXER)
    return {c: re.compile("|".join(f"(?P<{n}>{patterns[n]})" for n in names.split())).match for chars, names in heads.values() for c in chars}


_LEX_BY, _LEX_OTHER = _lexers(), re.compile(r"(?P<P>[^\w\s])").match
_CONTROL = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*\x07|\x1b[@-Z\\-_]|[\x00-\x08\x0b-\x1f\x7f]")

#: Weighted rules: left side, right side, weight. Upper-case words and single
#: signs are token classes; a rule whose left side starts with @ is a field. A
#: line is a header or continues the entry before it: the rule of no token says
#: that any line may, those of an indent and of a cause that such lines rather do.
GRAMMAR = """
LINE = S 0 | CONTINUED 0
CONTINUED = @more 0
@more = 0 | WS 1 | NAME WS NAME : 1
S = PYTHON 9 | PIPE 9 | NGINX 9 | BRACKETED 8 | JUL 8 | LOGCAT 9 | GLOGLINE 9 | SYSLOG 7 | EPOCHLINE 8 | CLOCK 7 | ACCESS 8 | BARE 4 | COLON 3 | JSON 8 | LOGFMT 6
@when = ISO 2 | DATE WS TIME 2 | DATE WS TIME WS ZONE 3 | SDATE WS TIME 2 | MDATE WS TIME 2 | MMDD WS TIME 2 | CLF 3 | EPOCH 2
@clock = TIME 1
@sysdate = MONTH WS NUM WS TIME 2
@level = ULEVEL 2 | LLEVEL 2
@letter = LETTER 2
@comp = NAME 1 | NAMES 1 | ULEVEL 0 | LLEVEL 0 | MONTH 0 | LETTER 0
@file = FILE 1
NAMES = NAME WS NAME 0
PYTHON = @when WS - WS @comp WS - WS @level WS - 3
PIPE = @when WS | WS @level WS | WS @comp WS | 3
NGINX = @when WS [ @level ] WS NUM # NUM : 3 | @when WS [ @level ] 1
BRACKETED = @when WS @level WS [ @comp ] 3 | @when WS [ @level ] WS [ @comp ] 2
JUL = @when WS @level WS @comp WS - 3
LOGCAT = @when WS NUM WS NUM WS @letter WS @comp : 3
GLOGLINE = @glog WS TIME WS NUM WS @file : NUM ] 3
@glog = GLOG 2
SYSLOG = @sysdate WS @host WS @comp [ NUM ] : 3 | @sysdate WS @host WS @comp : 2
@host = NAME 0 | IP 0
EPOCHLINE = @when WS @level WS @comp : 3
CLOCK = @clock WS @level WS ( @comp ) 3
ACCESS = IP WS - WS - WS @when 3 | IP WS - WS NAME WS @when 3
BARE = [ @ulevel ] 1
@ulevel = ULEVEL 1
COLON = @ulevel : WS 1
JSON = { PAIRS } 1 | { PAIRS } WS 1
PAIRS = PAIR 0 | PAIRS COMMA PAIR 0
COMMA = , 0 | , WS 0
PAIR = JTIME SEP @jtime 3 | JLEVEL SEP @jlevel 3 | JCOMP SEP @jcomp 2 | STR SEP VALUE 0 | JLEVEL SEP ODD 0 | JTIME SEP ODD 0 | JCOMP SEP ODD 0
SEP = : 0 | : WS 0
@jtime = STR 0 | NUM 0
@jlevel = STR 0 | NUM 0
@jcomp = STR 0
ODD = OBJECT 0 | ARRAY 0 | NAME 0
VALUE = STR 0 | NUM 0 | NAME 0 | OBJECT 0 | ARRAY 0
OBJECT = { PAIRS } 0 | { } 0
ARRAY = [ ] 0 | [ VALUES ] 0
VALUES = VALUE 0 | VALUES COMMA VALUE 0
LOGFMT = FIELD WS FIELD 1 | FIELD WS FIELD WS FIELDS 1
FIELDS = FIELD 0 | FIELDS WS FIELD 0
FIELD = KTIME @ltime 3 | KLEVEL @llevel 3 | KCOMP @lcomp 2 | KEY FREE 0
@ltime = STR 0 | ISO 0 | NUM 0 | EPOCH 0
@llevel = LLEVEL 0 | ULEVEL 0 | STR 0 | NAME 0
@lcomp = NAME 0 | STR 0 | ULEVEL 0 | LLEVEL 0
FREE = STR 0 | NAME 0 | NUM 0 | ISO 0 | IP 0 | LLEVEL 0 | ULEVEL 0
"""
_STAMPS, _LEVELED, _COMPS = {"when", "clock", "sysdate", "glog", "jtime", "ltime"}, {"level", "ulevel", "letter", "glog", "jlevel", "llevel"}, {"comp", "file", "jcomp", "lcomp"}


def read_grammar(text: str) -> tuple[list[tuple[str, tuple[str, ...], float]], dict[str, list[int]]]:
    """Rules and, by left side, their numbers. A bar stands for the sign | in
    a rule that has bars around spaces only within layouts, so alternatives are
    split where a weight ends."""
    rules, by = [], {}
    for line in filter(None, text.split("\n")):
        left, right = line.split(" = ", 1)
        part: list[str] = []
        words = right.split(" ")
        for i, w in enumerate(words):
            if re.fullmatch(r"\d+", w) and (i + 1 == len(words) or words[i + 1] == "|"):
                by.setdefault(left, []).append(len(rules))
                rules.append((left, tuple(part), float(w)))
                part = []
            elif w == "|" and not part and rules and words[i - 1].isdigit():
                continue
            else:
                part.append(w)
    return rules, by


#: Tokens of a line whose charts are shared, and the most nodes of the trie.
SHARED, MOST = 40, 100_000


class EarleyTrie:
    """Earley charts of token-class prefixes, shared in a trie.

    A node holds its own Earley set and a link to each next token class; the
    sets before it are those on the way from the root. Items are (rule, dot,
    origin) with the best score and the fields found so far.
    """

    __slots__ = ("rules", "by", "start", "root", "nodes")

    class Node:
        __slots__ = ("items", "next", "accept", "open")

        def __init__(self, items, accept, open_):
            self.items, self.next, self.accept, self.open = items, {}, accept, open_

    def __init__(self, grammar: str = GRAMMAR) -> None:
        self.rules, self.by = read_grammar(grammar)
        self.start = self.rules[0][0]
        first: dict = {}
        self._close(first, [], [(r, 0, 0, 0.0, ()) for r in self.by[self.start]])
        self.nodes, self.root = 0, self._node(first)

    def _close(self, items: dict, sets: list, todo: list) -> None:
        """Predictions and completions of one set; a better score is passed on."""
        here = len(sets)
        while todo:
            rule, dot, origin, score, fields = todo.pop()
            old = items.get((rule, dot, origin))
            if old is not None and old[0] >= score:
                continue
            items[(rule, dot, origin)] = (score, fields)
            left, right, weight = self.rules[rule]
            if dot < len(right):
                if right[dot] in self.by:
                    for r in self.by[right[dot]]:
                        if (r, 0, here) not in items:
                            todo.append((r, 0, here, 0.0, ()))
                continue
            total = score + weight
            found = fields + ((left[1:], origin, here),) if left[0] == "@" else fields
            for (r, d, o), (s, f) in list((items if origin == here else sets[origin]).items()):
                rhs = self.rules[r][1]
                if d < len(rhs) and rhs[d] == left:
                    todo.append((r, d + 1, o, s + total, f + found))

    def _node(self, items: dict) -> EarleyTrie.Node:
        accept, open_ = None, False
        for (r, d, o), (score, fields) in items.items():
            left, right, weight = self.rules[r]
            if d < len(right):
                open_ = True
            elif left == self.start and o == 0 and (accept is None or score + weight > accept[0]):
                accept = (score + weight, fields)
        return self.Node(items, accept, open_)

    def step(self, node: EarleyTrie.Node, token: str, sets: list) -> EarleyTrie.Node | None:
        """The node after one more token; None if no item can scan it. ``sets``
        are those from the root to ``node``."""
        items: dict = {}
        todo = [(r, d + 1, o, s, f) for (r, d, o), (s, f) in node.items.items() if d < len(self.rules[r][1]) and self.rules[r][1][d] == token]
        self._close(items, sets, todo)
        after = self._node(items) if items else None
        if len(sets) <= SHARED:
            node.next[token] = after
            self.nodes += 1
        return after

    def parse(self, line: str) -> tuple[float, tuple, list] | None:
        """Best derivation of ``line``: score, fields as token spans, tokens;
        later ones go before earlier ones of the same score."""
        if self.nodes > MOST:
            self.root.next.clear()
            self.nodes = 0
        node, tokens, at, size, by = self.root, [], 0, len(line), _LEX_BY
        best, sets = node.accept, [node.items]
        while at < size:
            m = by.get(line[at], _LEX_OTHER)(line, at)
            if m is None:
                break
            kind = m.lastgroup
            if kind == "P":
                kind = line[at]
            after = node.next.get(kind, 0)
            if after == 0:
                after = self.step(node, kind, sets)
            if after is None:
                break
            end = m.end()
            tokens.append((at, end))
            node, at = after, end
            sets.append(node.items)
            if node.accept is not None and (best is None or node.accept[0] >= best[0]):
                best = node.accept
            if not node.open:
                break
        return (*best, tokens) if best else None


def _shift(y, mo, d, h, mi, s, zone: str) -> str:
    """The UTC time of a time with zone, as text."""
    try:
        t = datetime(y, mo, d, h, mi, min(s, 59))
    except ValueError:
        return ""
    if zone and zone[0] in "+-":
        digits = zone[1:].replace(":", "")
        t -= (1 if zone[0] == "+" else -1) * timedelta(hours=int(digits[:2]), minutes=int(digits[2:4] or 0))
    return str(t)


def _epoch(value: float) -> str:
    while value > 1e11:  # milliseconds, microseconds, nanoseconds
        value /= 1000
    return str(datetime.fromtimestamp(int(value), timezone.utc))[:19]


_ISOP = re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ]+(\d\d):(\d\d):(\d\d)(?:[.,]\d+)?\s*(Z|UTC|GMT|[+-]\d\d:?\d\d)?")


def timestamp(text: str, seen: datetime | None) -> str:
    """``YYYY-MM-DD HH:MM:SS`` in UTC; what the text omits comes from ``seen``."""
    text = text.strip('"[] ')
    m = _ISOP.match(text)
    if m:
        zone = m[7] or ""
        if zone[:1] not in ("+", "-"):
            return f"{m[1]}-{m[2]}-{m[3]} {m[4]}:{m[5]}:{m[6]}"
        return _shift(*map(int, m.groups()[:6]), zone)
    if m := re.match(r"(\d{1,2})[-/]([A-Z][a-z]{2})[-/](\d{4})[ :](\d\d):(\d\d):(\d\d)(?:[.,]\d+)?\s*([+-]\d\d:?\d\d)?", text):
        return _shift(int(m[3]), MONTHS.get(m[2], 0), int(m[1]), int(m[4]), int(m[5]), int(m[6]), m[7] or "")
    if m := re.fullmatch(r"\d{9,19}(?:\.\d+)?", text):
        return _epoch(float(text))
    if seen is None:
        return ""
    if m := re.match(r"[A-Z]?(\d\d)-?(\d\d)[ ]+(\d\d):(\d\d):(\d\d)", text):
        return _shift(seen.year, *map(int, m.groups()), "")
    if m := re.match(r"([A-Z][a-z]{2}) +(\d{1,2}) +(\d\d):(\d\d):(\d\d)", text):
        return _shift(seen.year, MONTHS.get(m[1], 0), *map(int, m.groups()[1:]), "")
    if m := re.match(r"(\d\d):(\d\d):(\d\d)", text):
        return _shift(seen.year, seen.month, seen.day, *map(int, m.groups()), "")
    return ""


def header(trie: EarleyTrie, line: str, seen: datetime | None) -> tuple[str, str, str, int] | None:
    """(timestamp, level, component, end of the header), or None where the line
    isn't laid out by a logging program."""
    got = trie.parse(line)
    if got is None or got[1] and got[1][0][0] == "more":
        return None
    ts = level = comp = ""
    stamped = leveled = False
    tokens = got[2]
    for name, start, end in got[1]:
        text = line[tokens[start][0] : tokens[end - 1][1]]
        if name == "glog":
            ts, stamped, leveled, level = timestamp(line[: tokens[end + 1][1]], seen), True, True, LEVELS[text[0]]
        elif name in _STAMPS and not stamped:
            ts, stamped = timestamp(text, seen), True
        elif name in _LEVELED and not leveled:
            level, leveled = LEVELS.get(text.strip('"').upper(), ""), True
        elif name in _COMPS and not comp:
            comp = text.strip('"')
    if not (stamped and ts or leveled and level):
        return None
    return ts, level, comp, tokens[-1][1]


#: One row per entry; ``unparsed`` rows are the lines before the first entry.
SCHEMA = T.StructType(
    [T.StructField("record_id", T.StringType()), T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("entry_ts", "level", "component", "message")]
    + [T.StructField("unparsed", T.BooleanType())]
)
_ARROW = pa.schema([("record_id", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("entry_ts", pa.string()), ("level", pa.string()), ("component", pa.string()), ("message", pa.string()), ("unparsed", pa.bool_())])


def _starts(trie: EarleyTrie) -> frozenset[str]:
    """First characters that a header can have: those of the token classes and
    signs with which a derivation may begin; others are no layout's, nor is an
    indent, with which only continuations begin."""
    first = {right[d] for r, d, _ in trie.root.items if d < len(right := trie.rules[r][1])} - {"WS"}
    return frozenset(c for c, match in _LEX_BY.items() if first & match.__self__.groupindex.keys()) | {t for t in first if len(t) == 1 and not t.isalnum()}


_STARTS = _starts(EarleyTrie())


def entries(trie: EarleyTrie, record: str, text: str, seen: datetime | None, message: bool) -> list[tuple]:
    """Entries of one text, in order."""
    lines = text.split("\n")
    out: list[list] = []
    coded = _CONTROL.search(text) is not None
    for no, line in enumerate(lines, 1):
        if coded:
            line = _CONTROL.sub("", line)
        if not line or line[0] not in _STARTS:
            continue
        got = header(trie, line, seen)
        if got is not None:
            if out:
                out[-1][2] = no - 1
            out.append([record, no, len(lines), got[0], got[1], got[2], got[3], False])
    if message:
        first = out[0][1] if out else len(lines) + 1
        for e in out:
            e[6] = _CONTROL.sub("", "\n".join([lines[e[1] - 1].rstrip("\r")[:]] + lines[e[1] : e[2]]))[e[6] :].strip()
        if first > 1:
            out.insert(0, [record, 1, first - 1, "", "", "", _CONTROL.sub("", "\n".join(lines[: first - 1])), True])
    else:
        for e in out:
            e[6] = None
    return out


def log_entries(df: DataFrame, key: str, text: str, seen: str, *, message: bool = True) -> DataFrame:
    """Entries of ``text``, one row each. ``seen`` is the time from which what
    a line omits is taken. ``message=False`` leaves messages and unparsed spans
    out, for those who need the fields only."""
    source = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(seen).cast("timestamp_ntz").alias("s")).filter("t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = EarleyTrie()
        for batch in batches:
            rows: list = []
            keys, texts, times = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                rows += entries(trie, keys[i].as_py(), texts[i].as_py(), times[i].as_py(), message)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return source.mapInArrow(run, SCHEMA)


def entry_keys(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Entries of both streams of the runs and of the log evidence: where they
    are and what their headers say. Distinct rows."""
    logs = evidence.filter(F.upper("evidence_type") == "LOG")
    parts = [(runs, "run_id", "stdout", "captured_at", "stdout"), (runs, "run_id", "stderr", "captured_at", "stderr"), (logs, "evidence_id", "content", "collected_at", "evidence")]
    out = None
    for df, key, text, seen, origin in parts:
        part = log_entries(df, key, text, seen, message=False).select(F.lit(origin).alias("origin"), "record_id", "first_line", "last_line", "entry_ts", "level", "component")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def entry_messages(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of :func:`log_entries`, messages and unparsed spans with them, of
    the same three origins as :func:`entry_keys`. Distinct rows."""
    logs = evidence.filter(F.upper("evidence_type") == "LOG")
    parts = [log_entries(df, key, text, seen).select(F.lit(origin).alias("origin"), "*") for df, key, text, seen, origin in ((runs, "run_id", "stdout", "captured_at", "stdout"), (runs, "run_id", "stderr", "captured_at", "stderr"), (logs, "evidence_id", "content", "collected_at", "evidence"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
