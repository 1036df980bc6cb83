import random

from hypothesis import given, settings, strategies as st

from tessera.llm import leakage
from tessera.llm.leakage import LEAST, SuffixAutomaton, leaks, placed_words, words

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi omega one two three four five six".split()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=14))
def test_automaton_against_brute_force(items, text):
    a = SuffixAutomaton(dict(enumerate(items)))
    got = a.segments(text)
    # every longest match that ends where the text's next word breaks it is told
    for j in range(len(text)):
        best = max((n for n in range(1, j + 2) for s in items for i in range(len(s) - n + 1) if s[i : i + n] == text[j + 1 - n : j + 1]), default=0)
        longer = j + 1 < len(text) and any(s[i : i + best + 1] == text[j + 1 - best : j + 2] for s in items for i in range(len(s) - best)) if best else True
        if best >= LEAST and not longer:
            for k, s in enumerate(items):
                for i in range(len(s) - best + 1):
                    if s[i : i + best] == text[j + 1 - best : j + 1]:
                        assert (i, j + 1 - best, best) in got[k]
    for k, found in got.items():
        assert all(items[k][i : i + n] == text[j : j + n] for i, j, n in found)


ITEM = "Given that `rank_worker` calls score_batch under matiroha, list the snapshot which NodeManager would drop. Pick the owner of sofa: ShardIndexer, or channel behind /archives/session."


def test_forms_of_one_passage():
    item = words(ITEM)
    a = SuffixAutomaton({1: item})
    whole = ITEM
    forms = [whole, whole.upper(), whole.replace(" ", " \n\t"), "// " + whole.replace(" ", "\n// "), whole.replace("`", "&#96;"), '{"p": "' + whole.replace(" ", "\\n") + '"}', whole.replace("a", "а").replace("o", "ο"), "<b>" + whole.replace(" ", "</b> <b>") + "</b>", whole.replace("e", "é"), "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in whole), whole.replace(",", "").replace(".", "").replace(":", ""), whole.replace("list", "show").replace("owner", "master")]
    for f in forms:
        assert [x[0] for x in leaks(a, words("before it all " + f + " and after"))] == [1], f
    cut = whole.split()
    assert leaks(a, words(" ".join(cut[: len(cut) * 7 // 10])))
    assert not leaks(a, words(" ".join(cut[: len(cut) * 4 // 10])))
    shuffled = cut[:]
    random.Random(1).shuffle(shuffled)
    assert not leaks(a, words(" ".join(shuffled))) and not leaks(a, []) and not SuffixAutomaton({}).segments(["a"] * 5)


def test_passage_beside_a_look_alike():
    item = [f"w{i}" for i in range(40)]
    a = SuffixAutomaton({1: item})
    # the item's pattern: the whole span, two of three words its own
    alike = [w if i % 6 < 4 or i in (0, 39) else "other" for i, w in enumerate(item)]
    assert not leaks(a, alike)
    for n in (22, 26, 30, 36):
        for gap in (0, 3, 10, 30, 60, 300):
            for text, begin in ((alike + ["x"] * gap + item[:n], 40 + gap), (item[40 - n :] + ["x"] * gap + alike, 0)):
                [(_, span, first, last)] = leaks(a, text)
                assert span >= n and first <= begin + 1 and last >= begin + n - 2, (n, gap)
    assert not leaks(a, alike + ["x"] * 60 + item[:15]) and not leaks(a, alike + ["x"] * 60 + alike)
    # a sparse beginning leads into the passage
    assert leaks(a, [w for i, w in enumerate(item[:18]) if i % 5 == 0] + item[18:])


@settings(max_examples=200, deadline=None)
@given(st.text("aB é&#96;<b>\\n\\u0061.'-\n", max_size=60))
def test_placed_words_agree(text):
    assert [w for w, _, _ in placed_words(text)] == words(text)


def test_table(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM} y"), (2, None), (3, ""), (4, "nothing here " * 20_000), (5, ITEM), (5, ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "!!!"), (4, " ".join(WORDS))], "item_id bigint, text string")
    found = leakage.leaked(docs, "doc_id", "text", items, "item_id", "text", spans=True).distinct()
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (5, 1)}
    clean = {r.doc_id: r.clean_text for r in leakage.without_leaks(docs, "doc_id", "text", found).collect()}
    assert clean[1] == "x . y" and clean[2] is None and clean[3] == ""
    assert leakage.leaked(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leakage.leaked(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_every_passage_is_removed(spark):
    cut = ITEM.split()
    most, rest, half = " ".join(cut[: len(cut) * 7 // 10]), " ".join(cut[len(cut) * 3 // 10 :]), len(cut) * 9 // 20
    far = "some words between " * 30
    texts = [f"a {ITEM} b {ITEM} c", f"a {ITEM}\n> {ITEM}\n{far}{ITEM} c", f"a {most} b {rest} c", f"a {most} {far} {rest} c", " ".join(["a", *cut[:half], ITEM, *cut[half : 2 * half], "c"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    found = leakage.leaked(docs, "doc_id", "text", items, "item_id", "text", spans=True)
    clean = {r.doc_id: " ".join(words(r.clean_text)) for r in leakage.without_leaks(docs, "doc_id", "text", found).collect()}
    assert clean == {0: "a b c", 1: f"a {far}c", 2: "a b c", 3: f"a {far}c", 4: "a c"}


def test_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=20))) for i in range(7)], "item_id bigint, text string")
    blocks = list(leakage.item_blocks(items, "item_id", "text", 45))
    assert len(blocks) == 3 and sorted(k for b in blocks for k in b) == list(range(7))


def test_calls_in_turn_keep_apart(spark):
    # workers are reused: each call has its own automaton, whatever came before
    words = [f"w{i}" for i in range(400)]
    sets = [[(1, " ".join(words[:40]))], [(2, " ".join(words[100:140]))]]
    documents = spark.createDataFrame([(10, "x " + sets[0][0][1]), (20, "y " + sets[1][0][1])], "doc_id bigint, text string")
    frames = [spark.createDataFrame(s, "item_id bigint, text string") for s in sets]
    for i in range(20):
        got = {(r.doc_id, r.item_id) for r in leakage.leaked(documents, "doc_id", "text", frames[i % 2], "item_id", "text").collect()}
        assert got == ({(10, 1)} if i % 2 == 0 else {(20, 2)}), i


def test_memory_is_linear():
    a = leakage.SuffixAutomaton({1: ["a", "b"] * 2000})
    assert len(a.places) <= 2 * 4000


def test_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(10)], "item_id bigint, text string")
    documents = spark.createDataFrame([(i, "z " + " ".join(words[i * 40 : i * 40 + 40])) for i in range(10)], "doc_id bigint, text string")
    monkeypatch.setattr(leakage.item_blocks, "__defaults__", (100,))
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(documents, "doc_id", "text", items, "item_id", "text").collect()} == {(i, i) for i in range(10)}
