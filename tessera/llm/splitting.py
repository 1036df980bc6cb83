"""Cut oversized texts into pieces at natural boundaries.

Recursive bisection: a stretch that is longer than the limit minus the overlap
is cut at the strongest boundary near its midpoint, and both halves again, until
each fits; then every piece but the first gets up to ``overlap`` characters of
what stands before it, beginning at a boundary where one exists.

Boundaries, strongest first: blank lines; starts of definitions, headings and
log entries at the margin; line ends; inside a line only where the line alone
exceeds the limit: sentence ends, spaces, any character. A line of up to the
limit is never cut: its piece gets less overlap instead.

Defined results: null, empty and short texts are no rows; lengths count code
points; a text of one endless line is cut inside it; repeated rows give their
pieces once (callers take distinct rows).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 6000, 200
_START = re.compile(r"(?:def |class |async def |function |export |func |public |private |@\w|# |## |#{3,6} |import |from |\[|\d{4}[-/]\d\d|diff --git|---|===|FROM |\w+:$)")
_SENTENCE = re.compile(r"[.!?;]['\")\]]?\s+")
_SPACE = re.compile(r"\s+")


def boundaries(text: str, limit: int) -> list[tuple[int, int]]:
    """(position, strength) of every place before which a cut may fall, in
    order; strengths 5 blank line, 4 start of a part, 3 line end, 2 sentence
    end, 1 space, 0 any character."""
    out: list[tuple[int, int]] = []
    at, blank = 0, False
    for line in text.split("\n"):
        if at:
            out.append((at, 5 if blank else 4 if _START.match(line) else 3))
        bare = len(line) - line.endswith("\r")
        if bare > limit:
            inner = {m.end() + at: 2 for m in _SENTENCE.finditer(line)}
            for m in _SPACE.finditer(line):
                inner.setdefault(m.end() + at, 1)
            for p in range(at + 100, at + bare, 100):
                inner.setdefault(p, 0)
            out += sorted((p, s) for p, s in inner.items() if at < p < at + bare)
        if bare + 2 > limit and at + bare < len(text):
            out.append((at + bare, 3))  # before the line's own end, which may not fit
        blank = not line.strip()
        at += len(line) + 1
    return out


def bisect(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, end, strength of the cut at ``begin``) of the stretches without
    overlaps; the first one's strength is 9."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and exceed the overlap")
    marks = boundaries(text, limit)
    places = [p for p, _ in marks]
    room = limit - overlap
    done: list[tuple[int, int, int]] = []
    todo = [(0, len(text), 9)]
    while todo:
        begin, end, cut = todo.pop()
        size = end - begin
        lo, hi = bisect_right(places, begin), bisect_left(places, end)
        if size <= room or size <= limit and (lo == hi or all(marks[k][1] < 3 for k in range(lo, hi))):
            done.append((begin, end, cut))
            continue
        middle, best = begin + size / 2, None
        for k in range(lo, hi):
            p, s = marks[k]
            away = abs(p - middle) / size  # 0 at the midpoint, 0.5 at an end
            if s < 3 and best is not None and best[0] >= 3:
                continue
            rank = (3 if s >= 3 else 0, s - 10 * away)
            if best is None or rank > best[1]:
                best = (s, rank, p)
        if best is None:
            # a line longer than the limit lies across: any character
            p, s = begin + size // 2, 0
        else:
            p, s = best[2], best[0]
        todo.append((p, end, s))
        todo.append((begin, p, cut))
    return done


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(begin with overlap, begin, end, strength) of the pieces, in order. Each
    is at most ``limit`` long; the parts from ``begin`` on give the text."""
    out = []
    for begin, end, cut in bisect(text, limit, overlap):
        start = max(0, begin - min(overlap, limit - (end - begin)))
        if begin and start < begin:
            line = text.find("\n", max(0, start - 1), begin - 1)
            if line >= 0:
                start = line + 1
            elif m := _SPACE.search(text, start, begin):
                start = m.end() if m.end() < begin else start
        out.append((start, begin, end, cut))
    return out


_ARROW = pa.schema([("record_id", pa.string()), ("piece", pa.int64()), ("n_pieces", pa.int64()), ("begin", pa.int64()), ("own_begin", pa.int64()), ("end", pa.int64()), ("strength", pa.int64()), ("content", pa.string())])
_DDL = "record_id string, piece bigint, n_pieces bigint, `begin` bigint, own_begin bigint, `end` bigint, strength bigint, content string"


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, *, content: bool = True) -> DataFrame:
    """Pieces of the texts that are longer than ``limit``. Short ones are left
    out JVM-side, before anything reaches Python. ``content=False`` leaves the
    pieces' texts out."""
    source = df.filter(F.length(text) > limit).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                cut = pieces(t, limit, overlap)
                rows += [(k, i, len(cut), s, o, e, w, t[s:e] if content else None) for i, (s, o, e, w) in enumerate(cut)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return source.mapInArrow(run, _DDL)


def all_pieces(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pieces of both tables' contents with their origin, each once."""
    parts = [split_items(df, key, "content").select(F.lit(origin).alias("origin"), "*") for df, key, origin in ((evidence, "evidence_id", "evidence"), (chunks, "chunk_id", "evidence_chunk"))]
    return parts[0].unionByName(parts[1]).distinct()


def oversized(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(origin, record_id, forced_cut): a cut inside a line shows that no line
    end would do."""
    out = None
    for df, key, origin in ((evidence, "evidence_id", "evidence"), (chunks, "chunk_id", "evidence_chunk")):
        got = split_items(df, key, "content", content=False).groupBy("record_id").agg(F.max((F.col("strength") < 3).cast("bigint")).alias("forced_cut"))
        part = got.select(F.lit(origin).alias("origin"), "record_id", "forced_cut")
        out = part if out is None else out.unionByName(part)
    return out
