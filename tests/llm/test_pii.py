import pytest

from tessera.llm import pii

CASES = [
    ("mail a_b7@staff.example now", {"EMAIL"}), ("<KIM.X+Y@MX.EXAMPLE.NET>", {"EMAIL"}), ("a.b (at) corp.example", {"EMAIL"}), ("a.b at mx dot example dot net", {"EMAIL"}), ("mailto:a@b.test", {"EMAIL"}),
    ("git@git.forge.example:planner/vago.git", set()), ("@dereve/ticket-kit@4.332.0", set()), ("https://u:pw@h.example/x", set()),
    ("on +1-202-555-0157 ext. 28", {"PHONE"}), ("030/23125751", {"PHONE"}), ("0044 (0)20 7946 0699", {"PHONE"}), ("(202) 555-0147", {"PHONE"}), ("+1202555 0113", {"PHONE"}), ("01 99 00 18 62", {"PHONE"}), ("020 7946 0194", {"PHONE"}), ("303.555.0171", {"PHONE"}),
    ("Build 202.555.708 passed", set()), ("Order ORD-169-161-8266 is", set()), ("Epoch 1772626361 is", set()), ("1.20.648 and 192.0.2.30", set()), ("08-16 05:07:04.814  2000  2100 I a: b", set()), ("2026-07-24 10:06:59,655 - a - INFO - b", set()), ("id a0f40b75-dd14-5277-1083-e4897395ca2f", set()),
    ("SSN 972-70-1955", {"ID_NUMBER"}), ("Why is 954-73-8664 stored", {"ID_NUMBER"}), ("tax id 00 145 643 412 has", {"ID_NUMBER"}), ("QQ993935A stored", {"ID_NUMBER"}), ("passport no. X0824440", {"ID_NUMBER"}), ("(DNI 00402613Q)", {"ID_NUMBER"}), ("driver licence DL-872-42013", {"ID_NUMBER"}), ("national id 174113-8700", {"ID_NUMBER"}),
    ("lives at Flat 12, 89 Larkspur Avenue, Ostbruck QX9 6ZZ.", {"ADDRESS"}), ("went to 32c saltmarsh way, brackwater instead", {"ADDRESS"}), ("C/ del Olmo 146, 2º B, 00575 Castelmir", {"ADDRESS"}), ("Am Alten Wehr 205, D-00533 Eastmoor", {"ADDRESS"}), ("Lindhofstraße 123, 00371 Fenmarch", {"ADDRESS"}), ("196 bis, rue des Ardoisiers, 00526 Q", {"ADDRESS"}), ("Column street_address in a/b.py", set()), ("Calle Nogueral, 208, 00253 Sollin", {"ADDRESS"}),
]


@pytest.mark.parametrize(("line", "want"), CASES)
def test_structured(line, want):
    assert {t for _, _, t in pii.structured(line)} == want


def frames(spark, talk, runs=()):
    req = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(talk)], "request_id bigint, conversation string, extra_context string, record_id string")
    return pii.texts(req, spark.createDataFrame(list(runs), "run_id bigint, stdout string"))


def test_names_by_disclosure(spark):
    talk = [f"Contact Annika Orv{'abcdefghij'[i]}ley, mail annika_{i}@post.test" for i in range(10)] + ["Amber Lantern is the code name of it"] * 30 + ["Will Harbor Gateway pass?"] * 30 + ["plain words only here"] * 60
    talk += ["Yesterday Annika Nestwick wrote that it fails", "Dr. Pellaford said so", "Regards, Pellstad, Annika", None, "", "x" * 100_000]
    parts = frames(spark, talk)
    spans = pii.personal_spans(parts).cache()
    names = {r.record_id for r in spans.filter("pii_type = 'NAME'").collect()}
    assert {str(i) for i in range(10)} | {"130", "131", "132"} == names
    clean = {r.record_id: r.clean_text for r in pii.sanitised(parts, spans).filter("origin = 'conversation'").collect()}
    assert clean["130"] == "Yesterday [NAME] wrote that it fails" and clean["131"] == "[NAME] said so" and clean["20"] == talk[20] and "[EMAIL]" in clean["0"]


def test_empty_and_repeats(spark):
    assert pii.personal_spans(frames(spark, [])).count() == 0
    got = pii.personal_spans(frames(spark, [], [(1, "a\nSSN 972-70-1955"), (1, "a\nSSN 972-70-1955")])).select("origin", "record_id", "line_no", "pii_type").distinct().collect()
    assert got == [("stdout", "1", 2, "ID_NUMBER")]


def test_hints_leave_nothing_out():
    words = pii._hint_words()
    text = "\n".join(line for line, _ in CASES) + "\nDr. Pellaford said\nThe form of Annika Orveley\nOrvquist, Ingrid\nHerr Jarrvale, Am Alten Wehr 55, D-00113 F\r\nplain\n"
    got = {(no, tuple(pii.structured(line, kinds)), tuple(pii.name_spans(line, pii.structured(line, kinds), kinds))) for no, _, line, kinds in pii.hinted(words, text)}
    for no, line in enumerate(text.split("\n"), 1):
        found = pii.structured(line)
        names = pii.name_spans(line, found)
        if found or names:
            assert (no, tuple(found), tuple(names)) in got, line
    assert pii.hinted(words, "") == [] and all(text[b : b + len(x)] == x for _, b, x, _ in pii.hinted(words, text))


def test_texts_under_one_key_or_none(spark):
    parts = frames(spark, [], [(None, "SSN 972-70-1955"), (None, "plain text of it"), (2, "a"), (2, "see SSN 972-70-1956")])
    got = {r.clean_text for r in pii.sanitised(parts, pii.personal_spans(parts)).collect()}
    assert got == {"[ID_NUMBER]", "plain text of it", "a", "see [ID_NUMBER]"}


def test_general_number_forms(spark):
    told = ["my NINO is AB 12 34 56 C", "DNI: 12345678Z", "passport no. T22000129", "tax id 86 095 742 719 is his"]
    for line in told:
        assert {t for _, _, t in pii.structured(line)} == {"ID_NUMBER"}, line
    # bare numbers: their shape tells where such numbers stand with words or entities
    talk = [f"DNI 1234{i:04}Z of her" for i in range(20)] + ["he wrote 99345678K there", "see AB 12 34 56 D now"] + [f"order 86 095 742 {i:03} shipped" for i in range(30)] + ["plain words only here"] * 60
    spans = pii.personal_spans(frames(spark, talk))
    got = {(int(r.record_id), r.pii_type) for r in spans.collect()}
    assert got == {(i, "ID_NUMBER") for i in range(22)}


def test_terms_of_all_lines():
    text = "Anna Berg said\nnothing here\nsee Anna, ANNA and Anna.x or fooBar McBride"
    assert list(pii.line_terms(text)) == [(1, {"anna", "berg"}), (3, {"anna"})]
    assert list(pii.line_terms("")) == []
