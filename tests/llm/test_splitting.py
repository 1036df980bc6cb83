import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm.queries import p6_pieces
from tessera.llm.splitting import bisect, oversized, pieces, split_items


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab .\r\né", max_size=90), max_size=40), st.integers(20, 120), st.integers(0, 15))
def test_whole_text_comes_back(parts, limit, overlap):
    text = "".join(parts)
    got = pieces(text, limit, overlap)
    assert "".join(text[o:e] for _, o, e, _ in got) == text
    assert all(e - s <= limit and 0 <= o - s <= overlap for s, o, e, _ in got)
    long_line = any(len(x.removesuffix("\r") if i else x.removesuffix("\r")) > limit for i, x in enumerate(text.split("\n")))
    if len(text) > limit:
        assert any(w < 3 for _, _, _, w in got) == long_line


def test_strongest_boundary_wins():
    text = "a" * 40 + "\n" + "b" * 9 + "\n\n" + "c" * 48
    assert [text[b:e] for b, e, _ in bisect(text, 70, 10)] == ["a" * 40 + "\n" + "b" * 9 + "\n\n", "c" * 48]


def test_parameters():
    with pytest.raises(ValueError):
        bisect("x", 0, 0)
    with pytest.raises(ValueError):
        bisect("x", 10, 10)


def test_table(spark):
    rows = [("1", None), ("2", ""), ("3", "x" * 6000), ("4", "x" * 6000 + "\n"), ("5", "é" * 6001), ("5", "é" * 6001), ("6", ("y" * 99 + "\n") * 70)]
    ev = spark.createDataFrame([(*r, 1) for r in rows], "evidence_id string, content string, piece int")
    ch = spark.createDataFrame([("c", "z\n" * 4000)], "chunk_id string, content string")
    assert {tuple(r) for r in oversized(ev, ch).collect()} == {("evidence", "4", 0), ("evidence", "5", 1), ("evidence", "6", 0), ("evidence_chunk", "c", 0)}
    six = split_items(ev, "evidence_id", "content").filter("record_id = '6'").orderBy("piece").collect()
    assert all(len(r.content) <= 6000 and r.content == rows[6][1][r.begin : r.end] for r in six) and six[1].own_begin - six[1].begin == 200
    assert oversized(ev.limit(0), ch.limit(0)).count() == 0


def test_pieces_of_both_tables(spark, tmp_path):
    texts = {"e": "x\n" * 4000, "same": "y\n" * 4000}, {"c": "z\n" * 4000, "same": "é" * 7000}
    for name, key, rows in (("evidence", "evidence_id", texts[0]), ("evidence_chunk", "chunk_id", texts[1])):
        spark.createDataFrame([*rows.items(), *rows.items(), ("short", "s")], f"{key} string, content string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {}
    for r in p6_pieces(spark, str(tmp_path)).orderBy("origin", "record_id", "piece").collect():
        assert len(r.content) <= 6000
        got[r.origin, r.record_id] = got.get((r.origin, r.record_id), "") + r.content[r.own_begin - r.begin :]
    assert got == {**{("evidence", k): t for k, t in texts[0].items()}, **{("evidence_chunk", k): t for k, t in texts[1].items()}}
