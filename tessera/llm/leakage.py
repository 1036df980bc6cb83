"""Held-out test items in training text.

A generalised suffix automaton over the words of all items takes the words of
each document one by one and gives, at each word, the longest passage of any
item that ends there. Maximal matches become segments of their items, whose
lengths are added along chains in both orders: a chain that covers the share of
its item, with few words between its segments, is a leak (:func:`covered`). Only
where the segments alone don't decide, as altered words stand too close for
them, an exact check follows: the longest chain of the item's single words.

Words are compared in one form: escapes and entities resolved, markup dropped,
look-alike letters, accents, case, punctuation and spacing made one.

The items are the query set and the documents the rows: items are taken in
blocks of a bounded number of words, each block's automaton sent once.

Defined results: null and empty texts match nothing; an item without words
matches nothing; repeated rows give their pairs once; documents are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.lookalikes import mapping
from tessera.session import stage

LEAST = 3  # words of a segment
GAP = 6  # most steps between two words of a passage: an altered word may have been a path
SHARE = 0.5  # of the item's words
SURE = 0.85  # of a passage's words that are the item's own
DENSE, OWN = 0.72, 0.54  # fewer will do where so many of all the item's words stand unaltered
BLOCK_WORDS = 400_000

_ALIKE = dict(zip(*mapping()))


_DROPPED = frozenset(".'’‘`")


class _Fold(dict):
    """One character's form: letters and digits without accents in lower case,
    everything else a space; invisible characters, dots and quotes vanish, as
    texts without punctuation have their neighbours joined."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = _ALIKE.get(c, c)
        out = []
        for d in unicodedata.normalize("NFKD", c):
            d = _ALIKE.get(d, d)
            kind = unicodedata.category(d)
            if kind[0] == "M" or kind == "Cf" or d in _DROPPED:
                continue
            out.append(d.casefold() if kind[0] in "LN" else " ")
        self[code] = "".join(out)
        return self[code]


_FOLD = _Fold()
_ESCAPE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8}\d{0,2});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[nrt\"'\\/]|%[0-9A-F]{2}|</?[A-Za-z][^<>\n]{0,200}>|-\r?\n\s*(?=[a-z])")


def _resolved(m: re.Match) -> str:
    s = m[0]
    if s[0] == "&":
        return html.unescape(s) if html.unescape(s) != s else s
    if s[0] == "<":
        return " "
    if s[0] == "-":
        return "-"
    if s[:2] in ("\\u", "\\x"):
        return chr(int(s[2:], 16))
    if s[0] == "%":
        return chr(int(s[1:], 16)) if int(s[1:], 16) < 128 else " "
    return {"n": " ", "r": " ", "t": " "}.get(s[1], s[1])


def words(text: str) -> list[str]:
    """The words of a text in one form."""
    if "&" in text or "\\" in text or "<" in text or "%" in text or "-\n" in text or "-\r" in text:
        text = _ESCAPE.sub(_resolved, text)
    return text.translate(_FOLD).split()


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """:func:`words` with the characters of the text that each comes from."""
    out: list[tuple[str, int, int]] = []
    at, chars = 0, []
    marks = [(m.start(), m.end(), _resolved(m)) for m in _ESCAPE.finditer(text)]
    for begin, end, form in [*marks, (len(text), len(text), "")]:
        chars += [(_FOLD[ord(c)], i, i + 1) for i, c in enumerate(text[at:begin], at)]
        chars += [("".join(_FOLD[ord(c)] for c in form), begin, end)] if end > begin else []
        at = end
    word, first, last = "", 0, 0
    for form, begin, end in chars:
        for c in form:
            if c == " ":
                if word:
                    out.append((word, first, last))
                word = ""
            else:
                if not word:
                    first = begin
                word, last = word + c, end
    return [*out, (word, first, last)] if word else out


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    Every place (item, index of a word) is kept once; the ends of a state's
    passage are a slice of them, so memory is linear in the items' words."""

    def __init__(self, items: dict[int, list[str]]) -> None:
        self.items = items
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for item, seq in items.items():
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w, own)
                own[last].append((item, i))
        # places in the order of a walk over the suffix links: those of a state
        # and of all states below it stand side by side
        below: list[list[int]] = [[] for _ in self.size]
        for state in range(1, len(self.size)):
            below[self.link[state]].append(state)
        self.places: list[tuple[int, int]] = []
        self.first, self.after = [0] * len(self.size), [0] * len(self.size)
        todo = [0]
        while todo:
            state = todo.pop()
            if state < 0:
                self.after[~state] = len(self.places)
                continue
            self.first[state] = len(self.places)
            self.places += own[state]
            todo.append(~state)
            todo += below[state]

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(item, index of the last word) of all ends of the state's passage."""
        return self.places[self.first[state] : self.after[state]]

    def _extend(self, last: int, w: str, own: list) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q, own)
        cur = self._new(size[last] + 1, own)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q, own)
        return cur

    def _new(self, size: int, own: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        own.append([])
        return len(self.size) - 1

    def _clone(self, p: int, w: str, q: int, own: list) -> int:
        c = self._new(self.size[p] + 1, own)
        self.next[c] = dict(self.next[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def segments(self, seq: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """item -> (first word of the item, first word of the text, words) of
        the maximal matches of ``LEAST`` words and more."""
        out: dict[int, list] = defaultdict(list)
        nxt, link, size = self.next, self.link, self.size
        state = length = 0

        def note(state: int, length: int, j: int) -> None:
            told: set = set()
            while state > 0 and length >= LEAST:
                for item, i in self.ends(state):
                    if (item, i) not in told:
                        told.add((item, i))
                        out[item].append((i - length + 1, j - length + 1, length))
                state = link[state]
                length = size[state]

        for j, w in enumerate(seq):
            to = nxt[state].get(w)
            if to is not None:
                state, length = to, length + 1
                continue
            if length >= LEAST:
                note(state, length, j - 1)
            while state > 0 and w not in nxt[state]:
                state = link[state]
            length = size[state]
            to = nxt[state].get(w)
            if to is not None:
                state, length = to, length + 1
        if length >= LEAST:
            note(state, length, len(seq) - 1)
        return out


def passage(item: list[str], text: list[str], lo: int, hi: int) -> tuple[int, int, int, int, int]:
    """(words of the item spanned, words matched, first and last word in the
    text, first word in the item) of the best chain of equal words in order
    between ``lo`` and ``hi``, whose steps are at most GAP long on both sides."""
    at: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(item):
        at[w].append(i)
    best: dict[int, dict[int, tuple[int, int, int]]] = {}  # j -> i -> matched, first i, first j
    top = (0, 0, 0, 0, 0)
    for j in range(lo, hi):
        for i in at.get(text[j], ()):
            got = (1, i, j)
            for dj in range(1, GAP + 1):
                row = best.get(j - dj)
                for di in range(1, GAP + 1) if row else ():
                    before = row.get(i - di)
                    if before is not None and (before[0] + 1, before[1]) > (got[0], got[1]):
                        got = (before[0] + 1, before[1], before[2])
            best.setdefault(j, {})[i] = got
            span = i - got[1] + 1
            if (got[0], span) > (top[1], top[0]):
                top = (span, got[0], got[2], j, got[1])
    return top


def enough(matched: int, span: int, size: int, share: float) -> bool:
    """Whether a chain over ``span`` of an item's ``size`` words repeats its share."""
    return span >= share * size and (matched >= SURE * span or matched >= DENSE * span and matched >= OWN * share / SHARE * size)


def covered(found: list[tuple[int, int, int]], size: int, share: float) -> bool:
    """Whether a chain of the automaton's segments (first word of the item, first
    word of the text, words), in order of the text, repeats the share: by the
    words that they match and the part of the item that they span."""
    chains: list[tuple[int, int, int, int]] = []  # end in item, end in text, matched, first word of the item
    for i, j, n in found:
        best = (n, i)
        for end_i, end_j, matched, first in reversed(chains):
            if 0 <= i - end_i < GAP and 0 <= j - end_j < GAP and matched + n > best[0]:
                best = (matched + n, first)
        chains.append((i + n, j + n, *best))
        if enough(best[0], i + n - best[1], size, share):
            return True
    return False


def dense_passage(item: list[str], text: list[str], lo: int, hi: int, share: float) -> tuple[int, int, int, int, int] | None:
    """:func:`passage`, but of the chains that are dense enough: for each pair
    of equal words, the most matches of a chain from each first word."""
    at: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(item):
        at[w].append(i)
    best: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}  # j -> i -> first i -> matched, first j
    top = None
    for j in range(lo, hi):
        for i in at.get(text[j], ()):
            got = {i: (1, j)}
            for dj in range(1, GAP + 1):
                row = best.get(j - dj)
                for di in range(1, GAP + 1) if row else ():
                    for first, (n, begin) in row.get(i - di, {}).items():
                        if (n + 1, begin) > got.get(first, (0, 0)):
                            got[first] = (n + 1, begin)
            best.setdefault(j, {})[i] = got
            for first, (n, begin) in got.items():
                span = i - first + 1
                if (top is None or (n, span) > (top[1], top[0])) and enough(n, span, len(item), share):
                    top = (span, n, begin, j, first)
        best.pop(j - GAP, None)
    return top


def judged(item: list[str], text: list[str], lo: int, hi: int, share: float) -> tuple[int, int, int, int, int] | None:
    """The best passage between ``lo`` and ``hi`` that repeats the ``share``. The
    chain of most matches needn't be dense enough where another one is: then,
    if its matches would do for any, all chains and their parts are judged."""
    top = passage(item, text, lo, hi)
    if enough(top[1], top[0], len(item), share):
        return top
    if top[1] < min(SURE * share, OWN * share / SHARE) * len(item):
        return None
    return dense_passage(item, text, lo, hi, share)


def passages(item: list[str], text: list[str], lo: int, hi: int, share: float) -> list[tuple[int, int, int]]:
    """(words of the item spanned, first and last word in the text) of all the
    passages between ``lo`` and ``hi``: the best one, then those beside it."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        top = judged(item, text, lo, hi, share)
        if top:
            out.append((top[0], top[2], top[3]))
            todo += [(lo, top[2]), (top[3] + 1, hi)]
    return out


def leaks(automaton: SuffixAutomaton, seq: list[str], share: float = SHARE, *, spans: bool = True) -> list[tuple[int, int, int, int]]:
    """(item, words spanned, first and last word in the text) of each passage
    that repeats the ``share`` or more of an item. Without ``spans`` an item that
    the segments' lengths and coverage prove is told once, without places."""
    out = []
    for item, found in automaton.segments(seq).items():
        own = automaton.items[item]
        if sum(n for _, _, n in found) < 0.5 * share * len(own):
            continue
        if not spans and covered(sorted(found, key=lambda s: (s[1], s[0])), len(own), share):
            out.append((item, 0, 0, 0))
            continue
        # stretches of the text in which the item's words stand close together,
        # with as many words around them as a passage may reach
        found.sort(key=lambda s: s[1])
        groups: list[list[int]] = []
        for i, j, n in found:
            if groups and j - len(own) <= groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], j + n + len(own))
            else:
                groups.append([j - len(own), j + n + len(own)])
        out += [(item, *x) for lo, hi in groups for x in passages(own, seq, max(0, lo), min(len(seq), hi), share)]
    return out


def all_leaks(automaton: SuffixAutomaton, seq: list[str], share: float = SHARE) -> list[tuple[int, int, int, int]]:
    """:func:`leaks`, and those that come about where the words around a removed
    passage meet, until the words that remain hold none."""
    out, left = [], list(range(len(seq)))
    while found := leaks(automaton, [seq[p] for p in left], share):
        out += [(item, n, left[x], left[y]) for item, n, x, y in found]
        gone = {p for _, _, x, y in found for p in range(x, y + 1)}
        left = [p for k, p in enumerate(left) if k not in gone]
    return out


_BUILT: dict = {}


def _built(name: str, items: dict[int, list[str]]) -> SuffixAutomaton:
    """The automaton of a block, kept by worker; ``name`` is that of the one
    broadcast, never used again."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = SuffixAutomaton(items)
    return _BUILT[name]


def item_blocks(items: DataFrame, key: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[dict[int, list[str]]]:
    """The items in blocks; no more than one block is on the driver."""
    block: dict[int, list[str]] = {}
    size = 0
    for k, t in items.select(F.col(key).cast("bigint"), text).filter(F.col(text).isNotNull() & F.col(key).isNotNull()).distinct().toLocalIterator():
        seq = words(t)
        if not seq:
            continue
        block[k] = seq
        size += len(seq)
        if size >= block_words:
            yield block
            block, size = {}, 0
    if block:
        yield block


def leaked(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, share: float = SHARE, *, spans: bool = False) -> DataFrame:
    """(key, doc, item_id) of the items in each document, doc a hash of the text;
    ``spans`` gives a row for each passage, with its words and characters, all that
    must go for none of the same block of items to remain."""
    spark = documents.sparkSession
    source = documents.filter(F.length(text) > 0).select(F.col(key).cast("bigint").alias("k"), F.xxhash64(text).alias("d"), F.col(text).alias("t"))
    schema = pa.schema([(n, pa.int64()) for n in (key, "doc", "item_id", "words", "begin", "end")])
    ddl = ", ".join(f"`{n}` bigint" for n in schema.names)
    blocks = item_blocks(items, item_key, item_text)
    out, block = None, next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _built(name, sent.value)
            for b in batches:
                rows = []
                for k, d, t in zip(*(c.to_pylist() for c in b.columns)):
                    found = all_leaks(automaton, words(t), share) if spans else leaks(automaton, words(t), share, spans=False)
                    if found and spans:
                        placed = placed_words(t)
                        rows += [(k, d, i, w, placed[x][1], placed[y][2]) for i, w, x, y in found]
                    else:
                        rows += [(k, d, i, None, None, None) for i, _, _, _ in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        part = source.mapInArrow(run, ddl)
        if following is not None or out is not None:
            # several blocks: each is done and let go before the next is sent
            part = stage(part, "leaks")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
        block = following
    return spark.createDataFrame([], ddl) if out is None else out


def without_leaks(documents: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """The documents' texts without the leaked passages (``found`` with spans).
    Passages belong to a key's text, so texts under one key or none don't mix."""
    per = found.select(F.col(key).alias("_k"), F.col("doc").alias("_d"), F.struct("begin", "end").alias("s")).distinct().groupBy("_k", "_d").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    cut = """aggregate(spans, struct(cast(0 as bigint) as at, cast('' as string) as done),
        (acc, s) -> if(s.end <= acc.at, acc, struct(s.end as at, concat(acc.done, substring(t, cast(acc.at + 1 as int), cast(greatest(s.begin - acc.at, 0) as int))) as done)),
        acc -> concat(acc.done, substring(t, cast(acc.at + 1 as int))))"""
    rows = documents.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("t"), F.xxhash64(text).alias("d"))
    joined = rows.join(per, F.col(key).eqNullSafe(F.col("_k")) & (F.col("d") == F.col("_d")), "left")
    return joined.select(key, F.coalesce(F.size("spans"), F.lit(0)).alias("n_removed"), F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.expr(cut)).alias("clean_text"))
