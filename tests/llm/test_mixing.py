import os

import pytest

from tessera.llm import mixing
from tessera.llm.mixing import VOCABULARY, mixture, rates, water_fill

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public tokenizer's file")


def test_water_fill():
    got = water_fill({"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 3, "c": 1}, 300)
    assert got["b"] == 30 and abs(got["a"] - 270 * 5 / 7) < 1e-9 and abs(sum(got.values()) - 300) < 1e-9
    assert water_fill({"a": 10}, {"a": 1, "z": 1}, {"a": 2, "z": 2}, 1000) == {"a": 20.0, "z": 0.0}
    assert water_fill({}, {"a": 1}, {"a": 1}, 5) == {"a": 0.0}
    assert water_fill({"a": 5}, {"a": 0}, {"a": 1}, 5) == {"a": 0.0}


def test_table(spark):
    docs = spark.createDataFrame([(i, "one two three " * (1 + i % 5), " Chat" if i % 4 else "WIKI ", 1) for i in range(400)] + [(900, None, "chat", 1), (901, "", "chat", 1), (902, "x", None, 1), (903, "x", "other", 1)], "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("chat", 0.5, 1), ("wiki", 0.5, 2), ("none", 0.2, 3)], "source string, target_share double, max_repeat int")
    chosen, report = mixing.mix(docs, targets)
    rows = chosen.collect()
    assert {r.doc_id for r in rows} <= set(range(400)) and max(r.n_uses for r in rows if r.source == "wiki") == 2 and max(r.n_uses for r in rows if r.source == "chat") == 1
    rep = {r.source: r for r in report.collect()}
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9 and abs(rep["chat"].actual_share - 0.5) < 0.06 and rep["none"].tokens_used == 0
    assert chosen.orderBy("doc_id").collect() == mixing.mix(docs.repartition(7), targets)[0].orderBy("doc_id").collect()


def test_exact_counts(spark):
    tokens = mixing.counted(spark.createDataFrame([(1, "hello world", "a"), (2, "a" * 50_000, "a")], "doc_id bigint, text string, source string"), "doc_id", "text", "source").orderBy("doc_id").collect()
    assert tokens[0].n_tokens == 2 == len(mixing.encoder(open(VOCABULARY, "rb").read()).encode_ordinary("hello world"))


def test_whole_and_fractional_uses(spark):
    t = spark.createDataFrame([(i, "s", 10) for i in range(4000)], "doc_id bigint, source string, n_tokens bigint")
    table = spark.createDataFrame([("s", 1.0, 40_000, 4000, 90_000.0, 2.25, 3.0)], mixing._RATE)
    uses = [r.n_uses for r in mixture(t, "doc_id", table).collect()]
    assert len(uses) == 4000 and set(uses) == {2, 3} and abs(sum(uses) / 4000 - 2.25) < 0.03


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("chat", 1.0, 2)], "source string, target_share double, max_repeat int")
    chosen, report = mixing.mix(docs, targets)
    assert chosen.count() == 0 and report.first()["actual_share"] == 0.0
    assert rates(mixing.counted(docs, "doc_id", "text", "source"), targets.limit(0)) == []
