"""Credentials in source, configuration and log text: find and redact.

1. *Index*: an Aho-Corasick automaton finds triggers (nouns such as password,
   address schemes, header schemes, known key prefixes); at each hit a small
   matcher reads the literal that stands there, which is kept with the owner
   (project) of its text. In the same pass every string of the corpus that is
   shaped like a part of a literal (:func:`shapes`) is indexed by its text.
2. *Suppress*: a literal that more than ``max_owners`` owners share, in as many
   different texts, is a placeholder, whatever it looks like; copies of one text
   count once. References, masks and words never enter.
3. *Confirm*: what is left is rare; it is confirmed if its structure is that of
   a secret (:func:`strength`).
4. *Re-scan*: each confirmed literal has an anchor, its longest shaped part; one
   equality join of the anchors with the index gives the texts in which it may
   stand, and automata of these literals run over these texts, so that a secret
   is also found where nothing around it tells. What has no anchor goes through
   automata over all texts, in blocks of bounded size. All of it is linear in
   the corpus, and no list of values passes the driver but for the blocks.

Defined results: null and empty texts give no rows; repeated rows give their
lines once; a secret in parts is reported at its first part; texts are read
whole, whatever their length. Null owners count as one owner each record.
"""

from __future__ import annotations

import base64
import binascii
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.session import stage

# Nouns that name a secret, prefixes of issued keys, masks.
NOUNS = ("password", "passwd", "passphrase", "passwort", "pwd", "pass", "secret", "token", "key", "_pw", "credential", "credentials")
PREFIXES = {
    "AKIA": r"AKIA[0-9A-Z]{16}",
    "ASIA": r"ASIA[0-9A-Z]{16}",
    "AIza": r"AIza[\w-]{30,}",
    "ghp_": r"ghp_[A-Za-z0-9]{30,}",
    "gho_": r"gho_[A-Za-z0-9]{30,}",
    "ghs_": r"ghs_[A-Za-z0-9]{30,}",
    "glpat-": r"glpat-[\w-]{16,}",
    "xoxb-": r"xoxb-[\w-]{16,}",
    "xoxp-": r"xoxp-[\w-]{16,}",
    "sk_live_": r"sk_live_[A-Za-z0-9]{16,}",
    "SG.": r"SG\.[\w-]{16,}\.[\w-]{16,}",
    "npm_": r"npm_[A-Za-z0-9]{30,}",
    "eyJ": r"eyJ[\w-]{8,}\.[\w-]{4,}\.[\w-]{8,}",
}
_KNOWN = re.compile("|".join(PREFIXES.values()))
_MASK = re.compile(
    r"(?i)^(?:\$[{(]|\$\d$|%\(|%\w+%$|\{\{|<|!(?:ref|vault|env|secret|sub|include|getatt|importvalue|reference)\b|@(?:microsoft|env|vault)|env:|vault|secrets?[./:]|arn:|file:|ref[:+]|null\b|none\b|nil\b|true\b|false\b|undefined\b|n/a\b|tbd\b|todo\b|change|your|insert|example|dummy|sample|placeholder|redacted|masked|hidden|x{3,}$|\.\.\.|\*{3})"
    r"|\$\{|\{\{|\$\(|%\(|<[a-z]|>$"
)
_VARIABLE = re.compile(r"\$(?:[A-Z_][A-Z0-9_]*|[a-z_][a-z0-9_]*)")
_WORDS = re.compile(r"^(?:[A-Za-z]?[a-z]+|[A-Z]+)(?:[ _.\-/][A-Za-z]?[a-z]*)*$|^[A-Z]+(?:_[A-Z0-9]+)*$")
_CAMEL = re.compile(r"(?:^[a-z]+|[A-Z][a-z]+)")
_SHORT = frozenset("db my id io ui os to in is on no do of by at ok js ts py ip vm ci".split())
_AFTER = re.compile(r"(\\?[\"']?)\]?[ \t]*(:=|=>|=|:)[ \t]*")
_QUOTED = re.compile(r"[rbfu]{0,2}(\\?\"\"\"|'''|\\?[\"'`])")
_BARE = re.compile(r"[^\s\"'`<>,;)\]}\\]+")
_QUERY = re.compile(r"[^\s\"'`<>,;)\]}\\&]+")
_XML = re.compile(r">([^<>\s][^<>\n]*)</")
_ATTR = re.compile(r"\"\s+value=\"([^\"\n]*)\"")
_PROSE = re.compile(r"[\w ,.()'\-]*+")
_REMARK = re.compile(r"[:=][ \t]*([^\s\"'`<>,;]{16,})[ \t]*\r?(?:\n|$)")
_SPACE = re.compile(r"[ \t]+[\"']?([^\s\"']+)")
_URL = re.compile(r"://[^\s:/@\"'`<>]*:([^\s@/\"'`<>]+)@[\w\[]")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:[A-Za-z0-9+/=]|\\n|\\r|\s|[\"'+\\])*)(?:-----END [A-Z0-9 ]*-----)?")
_STRING = r"([\"'])((?:(?!\{0})[^\\\n])*)\{0}"
#: Strings joined by a sign or on one line; inside brackets also by line ends.
_PARTS = re.compile(_STRING.format(1) + r"(?:(?:[ \t]*(?:\+|\.\.?|&)\s*|[ \t]*\\\n[ \t]*|[ \t]+)" + _STRING.format(3) + ")+")
_BRACKETED = re.compile(_STRING.format(1) + r"(?:\s*\+?\s*" + _STRING.format(3) + ")+")
_STRINGS = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'")
_SCHEME = re.compile(r"[ \t]+([A-Za-z0-9+/=._~\-]{6,})")
_CALL = re.compile(r"\s*(?:[\w.]+\s*=\s*)?([\"'])[^\"'\n]*\1\s*,\s*(?:[\w.]+\s*=\s*)?([\"'])([^\"'\n]+)\2")
_USER = re.compile(r"[\"']?[^\s:\"']+:([^\s\"']+)")
#: What makes a short value beside it a part of something longer.
_INNER, _INNER_AFTER = re.compile(r"[\w./$%+-]"), re.compile(r"[\w/$%+-]|\.\w")
_B64 = re.compile(r"^[A-Za-z0-9+/]{8,}={0,2}$")
#: Shapes of a literal's parts: whole runs of letters and digits that mix both or
#: both cases, long runs of capitals, letters and digits on both sides of a sign,
#: letters before or after a sign that prose and code seldom have inside a word.
#: All but the runs are looked for from their sign, as signs are few.
_MIXED = re.compile(r"\d[^\W\d_]|[^\W\d_]\d|[a-z][A-Z]")
_RUN = re.compile(r"[^\W_]+")
_CAPITALS = re.compile(r"(?<![^\W_])[A-Z]{16,}(?![^\W_])")
_LETTERS_DIGITS = re.compile(r"(?:_|[^\w\s])(?<=[^\W\d_].)\d{2,}(?![^\W_])")
_DIGITS_LETTERS = re.compile(r"(?:_|[^\w\s])(?<=\d\d.)[^\W\d_]++(?![^\W_])")
_LETTERS_SIGN = re.compile(r"[!$%^&*?~#@+](?<=[^\W\d_].)")
_SIGN_LETTERS = re.compile(r"[!$%^&*?~#@+][^\W\d_]{3,}+(?![^\W_])")


def decoded(value: str) -> str | None:
    """The printable text that ``value`` encodes in base64, if it does."""
    if len(value) % 4 or not _B64.match(value):
        return None
    try:
        text = base64.b64decode(value, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return text if text.isprintable() else None


def camel_case(value: str) -> bool:
    """Whether letters of both cases are a name made of words: parts of three
    letters or more (or known short ones) with a vowel and without five
    consonants in a row, as chance letters have them."""
    parts = _CAMEL.findall(value)
    if "".join(parts) != value:
        return False
    return all(p.lower() in _SHORT or len(p) > 2 and re.search(r"(?i)[aeiouy]", p) and not re.search(r"(?i)[^aeiouy]{5}", p) for p in parts)


def strength(value: str, *, quoted: bool, strong_name: bool) -> bool:
    """Whether the literal has the structure of a working secret.

    A known issued form; else a string of six characters or more that is no
    reference, mask, word, name or plain number: digits among letters, a sign
    among them, or letters of both cases in no order of words."""
    if _KNOWN.match(value):
        return not re.search(r"EXAMPLE|(.)\1{5}", value)
    if len(value) < 6 or " " in value or _MASK.search(value) or _VARIABLE.fullmatch(value) or len(set(value)) < 4:
        return False
    if re.fullmatch(r"[\d.,:+\-]+", value):
        return False
    if not quoted and ("(" in value or value[-1] in "[." or re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", value) and not re.search(r"\d", value)):
        return False
    if _WORDS.match(value) or camel_case(value):
        return False
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    signs = len(value) - digits - letters
    if not strong_name and (len(value) < 16 or not digits or not letters):
        return False
    if digits and letters:
        return True
    return signs > 0 and letters > 3 or any(c.isupper() for c in value) and any(c.islower() for c in value) and len(value) >= 8


#: Classes of ASCII characters: digit, small letter, capital, sign, unusual sign.
_DIGIT, _SMALL, _CAPITAL, _SIGN, _UNUSUAL = 1, 2, 3, 4, 5
_CLASS = np.array([_DIGIT if c.isdigit() else _SMALL if c.islower() else _CAPITAL if c.isupper() else _UNUSUAL if c in "!$%^&*?~#@+" else 0 if c.isspace() else _SIGN for c in map(chr, range(128))], np.uint8)


def _starts(text: str) -> tuple:
    """Places where a mixed run, and each of the shapes with signs, may be: by
    the classes of neighbours in ASCII texts, by patterns in others."""
    if not text.isascii():
        return (m.start() for m in _MIXED.finditer(text)), *((m.start() for m in p.finditer(text)) for p in (_LETTERS_DIGITS, _DIGITS_LETTERS, _LETTERS_SIGN))
    c = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    digit, letter, sign, unusual = c == _DIGIT, (c == _SMALL) | (c == _CAPITAL), c >= _SIGN, c == _UNUSUAL
    mixed = digit[:-1] & letter[1:] | letter[:-1] & digit[1:] | (c[:-1] == _SMALL) & (c[1:] == _CAPITAL)
    between = lambda a, b: (np.flatnonzero(a[:-2] & sign[1:-1] & b[2:]) + 1).tolist()
    return np.flatnonzero(mixed).tolist(), between(letter, digit), between(digit, letter), (np.flatnonzero(letter[:-1] & unusual[1:]) + 1).tolist()


def shapes(text: str) -> set[str]:
    """The strings of ``text`` by which literals are indexed. What stands by
    itself in a text has the same shapes there as alone: they are whole runs."""
    out = {*_CAPITALS.findall(text), *_SIGN_LETTERS.findall(text)}
    mixed, *signed = _starts(text)
    at = 0
    for place in mixed:
        if place < at:
            continue
        begin = place
        while begin > at and text[begin - 1].isalnum():
            begin -= 1
        at = _RUN.match(text, begin).end()
        out.add(text[begin:at])
    for places_, pattern, part, least in zip(signed, (_LETTERS_DIGITS, _DIGITS_LETTERS, _LETTERS_SIGN), (str.isalpha, str.isdecimal, str.isalpha), (1, 2, 3)):
        last = 0
        for place in places_:
            m = pattern.match(text, place)
            begin = place
            while begin > last and part(text[begin - 1]):
                begin -= 1
            if m and place - begin >= least and not (begin and text[begin - 1].isalnum()):
                out.add(text[begin : m.end()])
            last = place
    return out


def anchor(value: str) -> int | None:
    """The key of the longest shape of a literal; None if it has none."""
    found = shapes(value)
    return _hashed(max(found, key=lambda x: (len(x), x))) if found else None


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def last_words(text: str, at: int, n: int = 3) -> str:
    """The ``n`` words of the line before ``at``, with the space among them."""
    begin = at
    for _ in range(n):
        while begin and text[begin - 1] in " \t":
            begin -= 1
        while begin and text[begin - 1] not in " \t\n":
            begin -= 1
    return text[begin:at]


def _triggers() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for n in NOUNS:
        a.add_word(n, ("noun", len(n)))
    for p in PREFIXES:
        a.add_word(p.lower(), ("known", len(p)))
    for word, kind in (("://", "url"), ("bearer", "bearer"), ("basic", "basic"), ('"auth"', "auth"), ("-----begin ", "pem"), ('" + "', "parts"), ("' + '", "parts"), (" -u ", "user"), (" -p ", "flag"), ("login(", "call"), ("authenticate(", "call"), ("connect(", "call")):
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Literals of one text: (start, end, value, confirmed by structure)."""

    def __init__(self) -> None:
        self.triggers = _triggers()

    def value_at(self, text: str, at: int, *, query: bool = False) -> tuple[int, int, str, bool] | None:
        """The literal that begins at ``at``: quoted, in parts, or bare."""
        if text[at : at + 1] == "(" or text[at : at + 1] == "\\":
            ahead = at + 1
            while ahead < len(text) and text[ahead] in " \t\r\n\\(":
                ahead += 1
            if ahead < len(text) and text[ahead] in "\"'":
                return self.parts_at(text, ahead, _BRACKETED)
            return None
        q = _QUOTED.match(text, at)
        if q:
            begin, mark = q.end(), q[1]
            end = text.find(mark, begin)
            stop = text.find("\n", begin)
            if end < 0 or 0 <= stop < end and len(mark.strip("\\")) == 1:
                return None
            joined = self.parts_at(text, begin - 1) if len(mark) == 1 and mark in "\"'" else None
            if joined and joined[1] > end + 1:
                return joined
            return begin, end, text[begin:end], True
        m = (_QUERY if query else _BARE).match(text, at)
        return (m.start(), m.end(), m[0], False) if m else None

    @staticmethod
    def parts_at(text: str, at: int, pattern: re.Pattern = _PARTS) -> tuple[int, int, str, bool] | None:
        m = pattern.match(text, at)
        if not m:
            return None
        value = "".join(a or b for a, b in _STRINGS.findall(m[0]))
        return at + 1, m.end() - 1, value, True

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, value, kind), in order, no two overlapping."""
        got: list[tuple[int, int, str, str]] = []
        self.run = self.prose = (0, 0)
        pem: list[tuple[int, int]] = []
        for last, (kind, size) in self.triggers.iter(_lower(text)):
            start, end = last + 1 - size, last + 1
            if kind == "noun":
                self.noun(text, start, end, got)
            elif kind == "known":
                m = _KNOWN.match(text, start)
                if m and strength(m[0], quoted=True, strong_name=True) and not (start and (text[start - 1].isalnum() or text[start - 1] in "_-")):
                    got.append((m.start(), m.end(), m[0], "known"))
            elif kind == "url":
                m = _URL.match(text, start)
                if m and not _MASK.search(m[1]) and not _VARIABLE.fullmatch(m[1]) and len(m[1]) >= 4 and len(set(m[1])) > 2:
                    got.append((m.start(1), m.end(1), m[1], "login"))
            elif kind in ("bearer", "basic"):
                m = _SCHEME.match(text, end)
                if m and (strength(m[1], quoted=True, strong_name=True) if kind == "bearer" else ":" in (decoded(m[1]) or "")):
                    got.append((m.start(1), m.end(1), m[1], "header"))
            elif kind == "auth":
                m = _AFTER.match(text, end)
                v = self.value_at(text, m.end()) if m else None
                if v and ":" in (decoded(v[2]) or ""):
                    got.append((v[0], v[1], v[2], "login"))
            elif kind == "pem":
                m = _PEM.match(text, start)
                if m and len(re.findall(r"[A-Za-z0-9+/]", m["body"])) >= 24:
                    got.append((m.start(), m.end(), m[0], "private key"))
                    pem.append((m.start(), m.end()))
            elif kind == "parts":
                first = text.rfind(text[start], 0, start)
                p = self.parts_at(text, first) if first >= 0 else None
                if p:
                    line = text[text.rfind("\n", 0, first) + 1 : (text.find("\n", p[1]) + 1 or len(text) + 1) - 1]
                    named = any(n in line.lower() for n in NOUNS)
                    if _KNOWN.match(p[2]) or named and strength(p[2], quoted=True, strong_name=False):
                        got.append((p[0], p[1], p[2], "parts"))
            elif kind == "user":
                m = _USER.match(text, end)
                if m and strength(m[1], quoted=True, strong_name=True):
                    got.append((m.start(1), m.end(1), m[1], "login"))
            elif kind == "call":
                m = _CALL.match(text, end)
                if m and strength(m[3], quoted=True, strong_name=True):
                    got.append((m.start(3), m.end(3), m[3], "login"))
            elif kind == "flag":
                line = text[text.rfind("\n", 0, start) + 1 : start]
                m = re.compile(r"[\"']?([^\s\"']+)").match(text, end)
                if m and re.search(r"\b(?:docker|podman|helm|sshpass|mysql\w*|login)\b", line) and strength(m[1], quoted=True, strong_name=True):
                    got.append((m.start(1), m.end(1), m[1], "flag"))
        got.sort(key=lambda g: (g[0], -g[1]))
        out: list[tuple[int, int, str, str]] = []
        for g in got:
            inside = next((p for p in pem if p[0] <= g[0] < p[1]), None)
            if inside and g[3] != "private key" or out and g[0] < out[-1][1]:
                continue
            out.append(g)
        return out

    def name_start(self, text: str, at: int) -> int:
        """Where the name that runs up to ``at`` begins; a run is read once."""
        first, last = self.run
        begin = at
        while begin > last and (text[begin - 1].isalnum() or text[begin - 1] in "_.-"):
            begin -= 1
        if first <= begin <= last:
            begin = first
        self.run = (begin, at)
        return begin

    def prose_end(self, text: str, at: int) -> int:
        """Where the prose that runs on from ``at`` ends; a run is read once."""
        if not self.prose[0] <= at < self.prose[1]:
            self.prose = (at, _PROSE.match(text, at).end())
        return self.prose[1]

    def noun(self, text: str, start: int, end: int, got: list) -> None:
        following = text[end : end + 1]
        if following.isalnum() or following in ("_", "-") and following:
            return
        name = text[self.name_start(text, start) : end].lower()
        if "public" in name or "pub_key" in name:
            return
        noun = text[start:end].lower()
        strong = noun != "key" or bool(re.search(r"(?:api|access|secret|signing|private|auth|encrypt\w*|service|client|master|account|storage|shared|admin|session|license)[_\-.]?key$", name)) or bool(re.fullmatch(r"[a-z_]*secretkey", name))
        if noun == "pass" and not re.search(r"(?:^|[_\-.])pass$", name):
            return
        if following == ">":
            m = _XML.match(text, end)
            found = (m.start(1), m.end(1), m[1], True) if m else None
        elif following == '"' and (m := _ATTR.match(text, end)):
            found = (m.start(1), m.end(1), m[1], True)
        else:
            m = _AFTER.match(text, end)
            if m:
                found = self.value_at(text, m.end(), query=text.find("?", max(text.rfind(" ", 0, start), text.rfind("\n", 0, start), 0), start) >= 0)
            else:
                m = _SPACE.match(text, end)
                before = last_words(text, start) if m else ""
                remark = _REMARK.match(text, self.prose_end(text, end)) if following in " ," else None
                if remark and strength(remark[1], quoted=False, strong_name=False) and not re.match(r"\d{4}-\d\d-\d\d[T ]|\w+://", remark[1]):
                    got.append((remark.start(1), remark.end(1), remark[1], "remark"))
                    return
                if not m or not (re.search(r"\b(?:ENV|ARG)\s+[\w]*$", before) or re.search(r"\blogin\s+\S+\s+$", before) or re.search(r"--[\w-]*$", before) or re.search(r"(?i)identified\s+by\s+$", before)):
                    return
                found = (m.start(1), m.end(1), m[1], True)
        if not found:
            return
        value = found[2]
        if "-----BEGIN" in value or value.startswith("ssh-"):
            return
        if value.lower().split(" ")[0] in ("bearer", "basic"):
            return
        plain = decoded(value) if len(value) >= 8 else None
        ok = strength(value, quoted=found[3], strong_name=strong) or plain is not None and strong and strength(plain, quoted=True, strong_name=True)
        if ok:
            got.append((found[0], found[1], value, "assigned"))


_CANDIDATE = pa.schema([("origin", pa.string()), ("record_id", pa.string()), ("file_ord", pa.int64()), ("owner", pa.string()), ("doc", pa.int64()), ("line_no", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("kind", pa.string())])
CANDIDATE_DDL = "origin string, record_id string, file_ord bigint, owner string, doc bigint, line_no bigint, `begin` bigint, `end` bigint, value string, kind string"


def texts(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """(origin, record_id, file_ord, owner, text, doc) of both sources, doc a
    hash of the text; null and empty texts left out. Extra columns of the inputs don't matter."""
    e = evidence.select(F.lit("evidence").alias("origin"), F.col("evidence_id").cast("string").alias("record_id"), F.lit(0).cast("bigint").alias("file_ord"), F.coalesce("project_name", F.col("evidence_id").cast("string")).alias("owner"), F.col("content").alias("text"))
    r = requests.select(F.col("request_id").cast("string").alias("record_id"), F.coalesce("project_name", F.col("request_id").cast("string")).alias("owner"), F.posexplode("files").alias("pos", "f"))
    r = r.select(F.lit("prompt_request").alias("origin"), "record_id", F.col("pos").cast("bigint").alias("file_ord"), "owner", F.col("f.content").alias("text"))
    return e.unionByName(r).filter("text is not null and text <> ''").withColumn("doc", F.xxhash64("text"))


def candidates(source: DataFrame) -> DataFrame:
    """Literals with the structure of a secret, where they stand, and the index
    (kind INDEX): by text the keys of its shaped strings, as ``begin``, with
    the text's length as ``end``. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            rows = []
            origin, record, ord_, owner, doc, text = (c.to_pylist() for c in b.columns)
            for i, t in enumerate(text):
                line, at = 1, 0
                for begin, end, value, kind in finder.find(t):
                    line += t.count("\n", at, begin)
                    at = begin
                    rows.append((origin[i], record[i], ord_[i], owner[i], doc[i], line, begin, end, value, kind))
                rows += [(None, None, None, None, doc[i], None, _hashed(x), len(t), None, "INDEX") for x in shapes(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CANDIDATE)], schema=_CANDIDATE)

    return source.select("origin", "record_id", "file_ord", "owner", "doc", "text").mapInArrow(run, CANDIDATE_DDL)


def confirmed(found: DataFrame, max_owners: int = 8) -> DataFrame:
    """(value, owners, kind) of values that no more than ``max_owners`` owners
    share in different texts. They are counted after equal rows are made one
    map-side."""
    rows = found.filter("kind <> 'INDEX'").select("value", "kind", "owner", "doc").distinct()
    shared = F.least(F.countDistinct("owner"), F.countDistinct("doc"))
    return rows.groupBy("value").agg(shared.alias("owners"), F.min("kind").alias("kind")).filter(F.col("owners") <= max_owners)


def anchored(values: DataFrame) -> DataFrame:
    """(value, anchor) of the values to look for again. Private keys have their
    own mark wherever they stand, so they are left to the candidates."""
    schema = pa.schema([("value", pa.string()), ("anchor", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([anchor(v) for v in b.column(0).to_pylist()], pa.int64())], schema=schema)

    return values.filter("kind <> 'private key'").select("value").mapInArrow(run, "value string, anchor bigint")


def _alone(text: str, begin: int, end: int, least: int) -> bool:
    """Whether the value between stands by itself: one of ``least`` characters or
    more isn't part of a longer word; a shorter one is a token, no part of a
    name, path or number with signs."""
    if end - begin < least:
        return not (_INNER.match(text[begin - 1 : begin]) or _INNER_AFTER.match(text, end))
    return not (begin and text[begin - 1].isalnum() and text[begin].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def places(text: str, automaton: ahocorasick.Automaton, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the automaton's values that stand by themselves, in order."""
    return sorted((last + 1 - size, last + 1) for last, size in automaton.iter(text) if _alone(text, last + 1 - size, last + 1, least))


def _built(values) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, len(v))
    a.make_automaton()
    return a


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, values: list[str]) -> ahocorasick.Automaton:
    """A block's automaton; one a worker, the one before it is let go. ``name``
    is that of the one broadcast, never used again."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = _built(values)
    return _AUTOMATA[name]


_KEYS = ("origin", "record_id", "file_ord", "owner", "doc")


def _scanned(source: DataFrame, automaton_of, least: int) -> DataFrame:
    """Rows of the candidates' form of the values in each row's text.
    ``automaton_of`` gives the automaton of a row's last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *keys, t, values in zip(*(c.to_pylist() for c in b.columns)):
                line, at = 1, 0
                for begin, end in places(t, automaton_of(values), least):
                    line += t.count("\n", at, begin)
                    at = begin
                    rows.append((*keys, line, begin, end, t[begin:end], "rescan"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CANDIDATE)], schema=_CANDIDATE)

    return source.mapInArrow(run, CANDIDATE_DDL)


def rescan(source: DataFrame, index: DataFrame, values: DataFrame, *, least: int = 10, group: int = 1000, block: int = 100_000) -> DataFrame:
    """Every place where a confirmed value stands by itself, as rows of the
    candidates' form; one of under ``least`` characters has to be a token.

    The anchors' join with the index gives each text its values; at most
    ``group`` of them make one automaton, more of them make more rows. Values
    without an anchor are sent in blocks of ``block``, one after the other."""
    anchors = stage(anchored(values), "secret-anchors")
    keys = index.select("doc", F.col("begin").alias("anchor"), F.col("end").alias("size"))
    hits = keys.join(anchors.filter("anchor is not null"), "anchor").select("doc", "size", "value", F.pmod(F.xxhash64("value"), F.lit(1 << 20)).alias("h")).distinct()
    # a text's values by the thousand: few texts have more than one group
    many = hits.groupBy("doc", "size").agg(F.ceil(F.count("*") / F.lit(group)).alias("groups"))
    lists = hits.join(many, ["doc", "size"]).groupBy("doc", "size", F.pmod("h", "groups").alias("g")).agg(F.collect_list("value").alias("values")).drop("g")
    lists = stage(lists, "secret-hits")
    texts_ = source.withColumn("size", F.length("text").cast("bigint"))
    out = _scanned(texts_.join(lists, ["doc", "size"]).select(*_KEYS, "text", "values"), _built, least)
    rest = anchors.filter("anchor is null").select("value")
    passes = -(-rest.count() // block)
    for i in range(passes):
        part = rest if passes == 1 else rest.filter(F.pmod(F.xxhash64("value"), F.lit(passes)) == i)
        sent, name = source.sparkSession.sparkContext.broadcast([r[0] for r in part.toLocalIterator()]), uuid.uuid4().hex
        found = _scanned(source.select(*_KEYS, "text", F.lit(None).cast("string").alias("values")), lambda _, sent=sent, name=name: _automaton(name, sent.value), least)
        out = out.unionByName(stage(found, "secret-rest"))
        sent.destroy()
    return out


def secret_spans(source: DataFrame, max_owners: int = 8) -> DataFrame:
    """All confirmed secrets of the texts, with line and characters."""
    found = stage(candidates(source), "secret-candidates")
    values = stage(confirmed(found, max_owners), "secret-values")
    sure = found.filter("kind <> 'INDEX'").join(values.select("value"), "value", "left_semi").select(*_CANDIDATE.names)
    return sure.unionByName(rescan(source, found.filter("kind = 'INDEX'"), values))


def redacted(source: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts with each secret replaced by ``REDACTED``; all other characters
    stay. Overlapping spans are merged; quotes and line ends stay outside. Spans
    belong to a record's text, so texts under one key or none don't mix."""
    keys = ("origin", "record_id", "file_ord", "doc")
    per = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("begin", "end").alias("s")).groupBy(*[f"_{k}" for k in keys]).agg(F.array_sort(F.collect_set("s")).alias("spans"))
    cut = """aggregate(spans, struct(cast(0 as bigint) as at, cast('' as string) as done),
        (acc, s) -> if(s.end <= acc.at, acc, struct(s.end as at,
            concat(acc.done, substring(text, cast(acc.at + 1 as int), cast(greatest(s.begin - acc.at, 0) as int)), if(s.begin < acc.at, '', 'REDACTED')) as done)),
        acc -> concat(acc.done, substring(text, cast(acc.at + 1 as int))))"""
    once = source.dropDuplicates(list(keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return once.join(per, same, "left").select("origin", "record_id", "file_ord", F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(cut)).alias("redacted_text"))
