import re
import unicodedata

import duckdb
from hypothesis import given, settings, strategies as st

from tessera.llm import lookalikes as la

CON = duckdb.connect()


def form(text):
    return CON.execute(f"SELECT {la.canonical_sql('t')} FROM (SELECT CAST(? AS VARCHAR) AS t)", [text]).fetchall()[0][0]


def by_hand(text):
    """The same rules in Python."""
    s = unicodedata.normalize("NFC", text)
    so = lambda c: unicodedata.category(c) == "So" or "\U0001f3fb" <= c <= "\U0001f3ff" or c == "️"
    hidden = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
    keep = "".join("" if c == "‍" and 0 < i < len(s) - 1 and so(s[i - 1]) and unicodedata.category(s[i + 1]) == "So" else c for i, c in enumerate(s))
    s = hidden.sub("", keep)
    for a, b in la.JOINED.items():
        s = s.replace(a, b)
    return unicodedata.normalize("NFC", s.translate(dict(zip(map(ord, la.mapping()[0]), la.mapping()[1]))))


SIGNS = "aeo éАеоΟοё²½①ＡｆＩ，　 ​­﻿ﬁﬂ\u0301\u0308µ👩💻✅.9"


@settings(max_examples=300, deadline=None)
@given(st.text(SIGNS, max_size=25))
def test_against_python(text):
    assert form(text) == by_hand(text)
    assert form(form(text)) == form(text)


def test_alike_and_apart():
    for a, b in (("Full", "Ｆｕｌｌ"), ("é", "e\u0301"), ("a b", "a b"), ("ab", "a​b"), ("café", "саfе\u0301"), ("fix", "ﬁx"), ("μs", "µs"), ("soft", "so­ft")):
        assert form(a) == form(b), (a, b)
    for a, b in (("x2", "x²"), ("1/2", "½"), ("1", "①"), ("e", "é"), ("A", "a"), ("0", "O"), ("a!", "a"), ("ss", "ß"), ("👩💻", "👩‍💻"), ("a b", "ab")):
        assert form(a) != form(b), (a, b)


def test_pairs(spark):
    rows = [(1, "Full text"), (2, "Ｆull text"), (3, "Full text"), (4, "other"), (5, None), (6, ""), (7, "Full​ text"), (8, "y" * 200_000), (8, "y" * 200_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, canonical_key string")
    assert {tuple(r) for r in la.alike_pairs(df, "doc_id", "text").collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    assert {tuple(r) for r in la.alike_pairs(df, "doc_id", "text", room=1).collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    classes = {r.doc_id: (r.form_id, r.copy_id, r.n_links) for r in la.alike_classes(df, "doc_id", "text").collect()}
    assert classes == {1: (1, 1, 2), 2: (1, 2, 3), 3: (1, 1, 2), 4: (4, 4, 0), 7: (1, 7, 3), 8: (8, 8, 0)}
    forms = {r.doc_id: r.canonical_text for r in la.canonical(df, "doc_id", "text").collect()}
    assert forms[2] == "Full text" and forms[5] is None and forms[6] == ""
    assert la.alike_pairs(df.limit(0), "doc_id", "text").count() == 0 and la.alike_classes(df.limit(0), "doc_id", "text").count() == 0


def test_pairs_against_brute_force(spark):
    texts = ["abc", "аbc", "a​bc", "abd", "ａbc", "abc", "", None, "​", "­", "abd"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    forms = {i: form(t) for i, t in enumerate(texts) if t}
    want = {(i, j) for i in forms for j in forms if i < j and forms[i] == forms[j] and texts[i] != texts[j]}
    for room in (1, 4, 1000):
        assert {tuple(r) for r in la.alike_pairs(df, "doc_id", "text", room=room).collect()} == want
    links = {r.doc_id: r.n_links for r in la.alike_classes(df, "doc_id", "text").collect()}
    assert links == {i: sum(i in p for p in want) for i in forms}
