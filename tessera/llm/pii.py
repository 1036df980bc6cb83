"""Personal information in free text: find it and put typed placeholders.

Mail and street addresses, telephone numbers, titled names and numbers whose
form or whose line names them are read by their forms. For all else the corpus
is the measure: for every capitalised term, and every shape that an identity
number may have, on how many lines does it stand at all, and on how many with a
protected entity (or a word for identity numbers)? The information that it gives
about a protected entity, log2 of the rate on its lines against the rate on all
lines, is its disclosure. Spans of capitalised terms of which one discloses more
than the share ``threshold`` of the most that a term can disclose are names, and
numbers of a shape that does are identity numbers; code names, places, products
and order numbers stay below, as nothing personal stands near them.

Statistics cover every term of every line of the input; they are summed per batch
before any shuffle, and spans are made distinct before they are joined with them.

Defined results: null and empty texts give no rows; several entities of a type
on a line give one row of p4_found; repeated rows give their lines once; a
corpus without structured entities has no names but the titled ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import stage

# Words of addresses, titles and identity numbers.
_STREETS = "street|avenue|drive|way|row|lane|road|close|court|terrace|crescent|square|boulevard|hill|gardens|grove|mews|walk|place|parade|alley"
_SHORT = "st|ave|rd|dr|ln|blvd|ct|sq"
_TITLES = r"Mr|Mrs|Ms|Miss|Mx|Mme|Mlle|Dr|Prof|Professor|Herr|Frau|Señora|Señor|Sra|Srta|Sr|Sir|Madame|Monsieur"
_ID_WORDS = r"SSN|social security(?: number| no\.?)?|tax id|TIN|passport(?: no\.?| number)?|driver'?s? licen[cs]e(?: no\.?)?|licen[cs]e no\.?|national id(?: number| no\.?)?|id card|identity card|Personalausweis|Reisepass|Steuer-?ID|NI number|NINO|national insurance(?: number| no\.?)?|DNI|NIE|NIF|CURP|INSEE|NIR"
_WORD = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"

EMAIL = re.compile(
    r"(?<![\w.+%/@:-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)++[A-Za-z]{2,}+(?![\w@]|:[\w./]|-\w)"
    r"|(?<![\w.+%/@-])[A-Za-z0-9][\w.+%-]*\s?(?:\(at\)|\[at\]|\{at\}|<at>)\s?[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?|\sdot\s)[\w-]+)+"
    r"|(?<![\w.+%/@-])[A-Za-z0-9][\w.+%-]*\s(?:at|AT)\s[\w-]+(?:\s(?:dot|DOT)\s[\w-]+)+"
)
MAILTO = re.compile(r"mailto:([A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
ID_NUMBER = re.compile(
    rf"(?i:\b(?:{_ID_WORDS}))\s*(?:[:#=]\s*|is\s+)?(?=[A-Z0-9 .\-]*\d)[A-Z0-9]{{1,4}}(?:[ .\-]?[A-Z0-9]+)*?(?=[^A-Za-z0-9 .\-]|[ .\-]+(?![A-Z]?\d|[A-Z]\b)|$)"
    r"|(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
    r"|(?<![\w.\-])[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)"
)
#: Shapes that identity numbers share with other numbers: by disclosure.
SHAPES = {
    "#two threes": re.compile(r"(?<![\w.:\-])(?<!\d,)\d{2} \d{3} \d{3} \d{3}(?![\w\-])"),
    "#six four": re.compile(r"(?<![\w.\-])\d{6}-\d{4}(?![\w\-])"),
    "#eight letter": re.compile(r"(?<![\w.\-/])\d{8}-?[A-Z](?!\w)"),
    "#letter seven letter": re.compile(r"(?<![\w.\-/])[XYZ]\d{7}-?[A-Z](?!\w)"),
    "#letters digits": re.compile(r"(?<![\w.\-/])[A-Z]{1,2}\d{7,8}[A-Z]?(?!\w)"),
    "#letters three five": re.compile(r"(?<![\w.\-])[A-Z]{1,2}-\d{3}-\d{5}(?!\w)"),
}
_ID_WORD = re.compile(rf"(?i:\b(?:{_ID_WORDS})\b)")
PHONE = re.compile(
    r"(?<![\w.\-])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){5,13}(?:,?\s?(?:ext\.?|extension|x|Durchwahl)\s?\d{1,5})?(?![\w])"
    r"|(?<![\w.\-])00\d{2} ?(?:\(0\) ?)?\d(?:[ \-]?\d){6,11}(?![\w\-])"
    r"|(?<![\w.\-(/])(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?:,?\s?(?:ext\.?|extension|x)\s?\d{1,5})?(?![\w\-])"
    r"|(?<![\w.:\-/])(?<!\d,)0\d{1,4}(?:/\d{5,9}|(?:[ \-]\d{2}){4}|[ \-]\d{3,4}[ \-]\d{3,5})(?![\w\-:])"
)
ADDRESS = re.compile(
    rf"(?:(?i:\b(?:flat|apt\.?|apartment|unit|suite)) ?\w{{1,4}}, ?)?(?<![\w.\-/])\d{{1,4}}[A-Za-z]? (?:[^\W\d_][\w'’]* ){{1,3}}(?i:{_STREETS}|(?:{_SHORT})\.?)\b(?=,|\.|;|$|\"| in\b|\)|<|\s*\|)"
    r"|(?<![\w.\-/])\d{1,4}(?:,? (?:bis|ter))?,? (?i:rue|avenue|boulevard|place|impasse|chemin|allée|quai|cours) (?:d(?:e la|e l['’]|es|u|e)? ?|l['’])?[\w'’\-]+(?: [A-ZÀ-Ý][\w'’\-]+)*"
    r"|\b[A-ZÄÖÜ][a-zäöüß\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|(?i:straße|strasse)) \d{1,4}[a-z]?\b"
    r"|\b(?i:am|an der|an den|im|zum|zur|auf dem|auf der|hinter dem) [A-ZÄÖÜ\w][\w\-]*(?: [A-ZÄÖÜ\w][\w\-]*)? \d{1,4}[a-z]?,? (?:D-)?\d{5}\b"
    r"|(?i:\bC/|\bcalle\b|\bavda\.?|\bavenida\b|\bplaza\b|\bpaseo\b|\bcamino\b) ?(?i:de la|de los|de las|del|de|la|el|los)? ?[\w'’\-]+(?: [\w'’\-]+)?,? (?:n\.?º ?)?\d{1,4}\b"
)
#: Flat, town and postcode that may follow the street.
_TAIL = re.compile(r"(?:,? (?:(?i:apt|flat|unit|suite|piso)\.? ?\w{1,4}|\d{1,2}º ?[A-Z]?))?(?:,? (?:D-)?\d{5} [^\W\d_][\w\-]+|, (?:[A-ZÀ-Ý][\w\-]+|[a-z]{4,}(?=\W*$| instead))(?:,? [A-Z]{2}\d{0,2} ?\d[\dA-Z]{2,4})?)?")
_CLOSINGS = frozenset(("regards", "thanks", "best", "cheers", "hi", "hello", "dear", "sincerely", "greetings", "thank", "yes", "no", "ok"))
_OPENERS = _CLOSINGS | frozenset("contact mail ask call ping yesterday today why may can could will please the a an is does did has had when while if it this that from to by and but or for with cc re note owner name user customer reported signed i we he she they you who what where how was were as at on in of so then after before since talk see".split())
TITLED = re.compile(rf"\b(?:{_TITLES}|{_TITLES.upper()})\.? (?:[A-Z]\.? )?[A-ZÀ-Ý][\w'’\-]+(?: [A-ZÀ-Ý][\w'’\-]+)?")
_TERM = re.compile(rf"(?<![\w@./\\_\-]){_WORD}(?![\w@(_]|[./\\]\w)")
_NOT_TERM = re.compile(r"[a-z][A-Z]")
TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")


ALL = frozenset(("mail", "number", "street", "title", "pair"))
#: Shapes of identity and telephone numbers; what has none of them needs no closer look.
_NUMBER_HINT = re.compile(
    r"\d{3}-\d\d-\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]-\d{3}-\d{5}|\d\d \d{3} \d{3} \d{3}|\d{6}-\d{4}|[A-Z]\d{7}|\d{8}-?[A-Z]|\+(?!\d\d:?\d\d(?:[\]\"}]| \|))\d|(?<![\w.])00\d\d ?\(?\d"
    r"|(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|(?<!\d)0\d{1,4}(?:/\d{5}|(?:[ \-]\d\d){4}|[ \-]\d{3,4}[ \-]\d{3})"
)
_PAIR_HINT = re.compile(r"[^\W\d_a-z][\w'’\-]+,? (?:[A-Z]\.? )?[^\W\d_a-z]")


def _hint_words() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    streets = [f" {w}" for w in (*_STREETS.split("|"), *_SHORT.split("|"))]
    streets += ["straße", "strasse", "str.", "weg ", "gasse ", "allee ", "platz ", "ufer ", "damm ", "ring ", "rue ", "boulevard ", "place ", "impasse ", "chemin ", "allée ", "quai ", "cours ", "avenue ", "c/", "calle", "avda", "avenida", "plaza", "paseo", "camino", "am ", "an der ", "an den ", "im ", "zum ", "zur ", "auf de", "hinter dem "]
    for w in streets:
        a.add_word(w, ("street", len(w)))
    for w in ("ssn", "social security", "tax id", "tin", "passport", "licence", "license", "national id", "id card", "identity card", "personalausweis", "reisepass", "steuer", "ni number", "nino", "national insurance", "dni", "nie", "nif", "curp", "insee", "nir"):
        a.add_word(w, ("number", len(w)))
    for w in ("@", "(at)", "[at]", "{at}", "<at>", " at "):
        a.add_word(w, ("mail", len(w)))
    for w in _TITLES.lower().split("|"):
        a.add_word(f"{w} ", ("title", len(w) + 1))
        a.add_word(f"{w}. ", ("title", len(w) + 2))
    a.make_automaton()
    return a


def hinted(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str, frozenset]]:
    """(line number, offset, line, what it may hold) of the lines that may hold
    anything, by one pass of an automaton and two of plain patterns. No line
    with an entity is left out."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    marks: list[tuple[int, str]] = []
    end_of = len(text)
    for last, (kind, size) in automaton.iter(low):
        end = last + 1
        after = text[end] if end < end_of else " "
        if kind == "street":
            if low[end - size] == " " and after.isalnum():
                continue
        elif kind == "title":
            start = end - size
            if start and text[start - 1].isalnum() or not after.isupper():
                continue
        elif kind == "number" and after.isalpha():
            continue
        marks.append((last, kind))
    marks += [(m.start(), "number") for m in _NUMBER_HINT.finditer(text)]
    marks += [(m.start(), "pair") for m in _PAIR_HINT.finditer(text)]
    if not marks:
        return []
    marks.sort()
    out: list[tuple[int, int, str, frozenset]] = []
    no, begin, i = 1, 0, 0
    while i < len(marks):
        at = marks[i][0]
        no += text.count("\n", begin, at)
        begin = text.rfind("\n", 0, at) + 1
        stop = text.find("\n", at)
        stop = end_of if stop < 0 else stop
        kinds = set()
        while i < len(marks) and marks[i][0] <= stop:
            kinds.add(marks[i][1])
            i += 1
        out.append((no, begin, text[begin:stop], frozenset(kinds)))
        no, begin = no + 1, stop + 1
    return out


def structured(line: str, kinds: frozenset = ALL) -> list[tuple[int, int, str]]:
    """(begin, end, type) of the entities that their form gives away, and of the
    numbers that only the corpus can judge, their shape as type; ``kinds`` says
    what the line may hold."""
    out: list[tuple[int, int, str]] = []

    def add(m: re.Match, kind: str, group: int = 0) -> None:
        if not any(b < m.end(group) and m.start(group) < e for b, e, _ in out):
            out.append((m.start(group), m.end(group), kind))

    low = line.lower()
    if "mail" in kinds and ("@" in line or "at)" in low or "at]" in low or "at}" in low or " at " in low or "at>" in low):
        for m in MAILTO.finditer(line):
            add(m, "EMAIL", 1)
        for m in EMAIL.finditer(line):
            before = line[: m.start()].rpartition(" ")[2]
            if "://" not in before and not m[0].startswith("git@"):
                add(m, "EMAIL")
    if "number" in kinds or "street" in kinds:
        told = "number" in kinds and _ID_WORD.search(line) is not None
        numbers = [("ID_NUMBER" if told else shape, rx, "number") for shape, rx in SHAPES.items()]
        for kind, rx, need in (("ID_NUMBER", ID_NUMBER, "number"), *numbers, ("ADDRESS", ADDRESS, "street"), ("PHONE", PHONE, "number")):
            for m in rx.finditer(line) if need in kinds else ():
                if kind == "PHONE" and not 9 <= sum(c.isdigit() for c in m[0].split("x")[0]) <= 16:
                    continue
                add(m, kind)
                if kind == "ADDRESS" and out and out[-1][2] == kind and out[-1][1] == m.end():
                    out[-1] = (out[-1][0], _TAIL.match(line, m.end()).end(), kind)
    return out


def _name_like(term: str) -> bool:
    return len(term) > 1 and (term[0].isupper() and not _NOT_TERM.search(term.replace("-", " ")))


def name_spans(line: str, taken: list[tuple[int, int, str]], kinds: frozenset = ALL) -> list[tuple[int, int, tuple[str, ...], bool]]:
    """(begin, end, terms, titled) of the spans that may be a person's name."""
    out: list[tuple[int, int, tuple[str, ...], bool]] = []
    free = lambda b, e: not any(x < e and b < y for x, y, _ in taken) and not any(x < e and b < y for x, y, _, _ in out)
    for m in TITLED.finditer(line) if "title" in kinds else ():
        if free(m.start(), m.end()):
            out.append((m.start(), m.end(), (), True))
    if "pair" not in kinds:
        return out
    terms = [m for m in _TERM.finditer(line) if _name_like(m[0])]
    i = 0
    while i < len(terms):
        if terms[i][0].casefold() in _OPENERS:
            i += 1
            continue
        j = i
        while j + 1 < len(terms) and j - i < 3:
            gap = line[terms[j].end() : terms[j + 1].start()]
            if gap == " " or re.fullmatch(r" [A-Z]\.? ", gap):
                j += 1
            else:
                break
        if j > i:
            b, e = terms[i].start(), terms[j].end()
            if free(b, e):
                out.append((b, e, tuple(t[0].casefold() for t in terms[i : j + 1]), False))
        elif i + 1 < len(terms) and line[terms[i].end() : terms[i + 1].start()] == ", " and not (i + 2 < len(terms) and line[terms[i + 1].end() : terms[i + 2].start()] == " ") and free(terms[i].start(), terms[i + 1].end()):
            out.append((terms[i].start(), terms[i + 1].end(), (terms[i + 1][0].casefold(),), False))
            j = i + 1
        i = j + 1
    return out


_ROW = pa.schema([("record_id", pa.string()), ("doc", pa.int64()), ("line_no", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("pii_type", pa.string()), ("terms", pa.list_(pa.string())), ("n", pa.int64()), ("k", pa.int64())])
_DDL = "record_id string, doc bigint, line_no bigint, `begin` bigint, `end` bigint, pii_type string, terms array<string>, n bigint, k bigint"
_PERSONAL = {"EMAIL", "PHONE", "ID_NUMBER", "ADDRESS"}


_COUNTED = re.compile(r"\n|(?<![\w@./\\_\-])(?![a-z])[^\W\d_]+(?:['’\-][^\W\d_]+)*(?![\w@(_]|[./\\]\w)")


def line_terms(text: str) -> Iterator[tuple[int, set[str]]]:
    """(line number, capitalised terms) of the lines that have any."""
    no, terms = 1, set()
    for m in _COUNTED.finditer(text):
        w = m[0]
        if w == "\n":
            if terms:
                yield no, terms
                terms = set()
            no += 1
        elif _name_like(w):
            terms.add(w.casefold())
    if terms:
        yield no, terms


def scan(source: DataFrame) -> DataFrame:
    """Entities, name and number candidates (type CANDIDATE) and term counts
    (type TERM, summed per batch) of the texts (record_id, doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _hint_words()
        for b in batches:
            rows: list[tuple] = []
            seen: Counter = Counter()
            near: Counter = Counter()
            lines = hits = 0
            for record, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                lines += text.count("\n") + 1
                personal: set[int] = set()
                named: dict[int, set[str]] = {}
                for no, at, line, kinds in hinted(words, text):
                    found = structured(line, kinds)
                    spans = name_spans(line, found, kinds)
                    sure = {t for _, _, t in found if t[0] != "#"} | {"NAME" for s in spans if s[3]}
                    if sure:
                        personal.add(no)
                        hits += 1
                    named[no] = {p for x, y, t in found if t == "EMAIL" for p in re.split(r"[^a-z]+", line[x:y].partition("@")[0].lower()) if len(p) > 2}
                    told = "number" in kinds and _ID_WORD.search(line) is not None
                    for shape in (n for n, rx in SHAPES.items() if rx.search(line)) if "number" in kinds else ():
                        seen[shape] += 1
                        near[shape] += told or bool(sure - {"ID_NUMBER"})
                    for x, y, t in found:
                        rows.append((record, doc, no, at + x, at + y, *(("CANDIDATE", [t]) if t[0] == "#" else (t, None)), None, None))
                    for x, y, terms, titled in spans:
                        rows.append((record, doc, no, at + x, at + y, "NAME" if titled else "CANDIDATE", None if titled else list(terms), None, None))
                for no, terms in line_terms(text):
                    for term in terms:
                        seen[term] += 1
                        near[term] += no in personal or term in named.get(no, ())
            rows += [("", 0, 0, 0, 0, "TERM", [t], n, near[t]) for t, n in seen.items() if n]
            rows.append(("", 0, 0, 0, 0, "TERM", [""], lines, hits))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)

    return source.select("record_id", "doc", "text").mapInArrow(run, _DDL)


def texts(requests: DataFrame, runs: DataFrame) -> list[tuple[str, DataFrame]]:
    """The three text fields by origin; null and empty ones left out."""
    parts = ((requests, "request_id", "conversation"), (requests, "request_id", "extra_context"), (runs, "run_id", "stdout"))
    return [(col, df.select(F.col(key).cast("string").alias("record_id"), F.col(col).alias("text"), F.xxhash64(col).alias("doc")).filter("text is not null and text <> ''")) for df, key, col in parts]


def disclosure(terms: DataFrame) -> DataFrame:
    """(term, n, bits, share) of all terms. bits: log2 of the rate of lines with
    a protected entity among the term's lines (add-half) over the rate of all
    lines; share: bits of the most possible, which is minus log2 of that rate."""
    sums = terms.groupBy(F.element_at("terms", 1).alias("term")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    base = sums.filter("term = ''").agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("rate"))
    rate = base.first()["rate"]  # one number
    rate = min(0.99, 1.0 if rate is None else rate)
    bits = F.log2((F.col("k") + 0.5) / (F.col("n") + 1) / F.lit(rate))
    return sums.filter("term <> ''").select("term", "n", bits.alias("bits"), (bits / -math.log2(rate)).alias("share"))


def personal_spans(parts: list[tuple[str, DataFrame]], threshold: float = 0.35) -> DataFrame:
    """All entities with line and characters, by origin and record."""
    rows = None
    for origin, df in parts:
        part = scan(df).withColumn("origin", F.lit(origin))
        rows = part if rows is None else rows.unionByName(part)
    rows = stage(rows, "pii-scan")
    bits = disclosure(rows.filter("pii_type = 'TERM'"))
    candidates = rows.filter("pii_type = 'CANDIDATE'")
    spans = candidates.select("terms").distinct()
    scored = spans.select("terms", F.explode("terms").alias("term")).join(bits, "term").groupBy("terms").agg(F.max("share").alias("share")).filter(F.col("share") >= threshold)
    names = candidates.join(scored.select("terms"), "terms", "left_semi").withColumn("pii_type", F.when(F.element_at("terms", 1).startswith("#"), "ID_NUMBER").otherwise("NAME"))
    keep = ("origin", "record_id", "doc", "line_no", "begin", "end", "pii_type")
    return rows.filter(F.col("pii_type").isin(*TYPES)).select(*keep).unionByName(names.select(*keep))


def sanitised(parts: list[tuple[str, DataFrame]], spans: DataFrame) -> DataFrame:
    """The texts with each entity replaced by its typed placeholder."""
    keys = ("origin", "record_id", "doc")
    per = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("begin", "end", "pii_type").alias("s")).groupBy(*[f"_{k}" for k in keys]).agg(F.array_sort(F.collect_set("s")).alias("spans"))
    source = None
    for origin, df in parts:
        part = df.select(F.lit(origin).alias("origin"), "record_id", "doc", "text").dropDuplicates(["record_id", "doc"])
        source = part if source is None else source.unionByName(part)
    cut = """aggregate(spans, struct(cast(0 as bigint) as at, cast('' as string) as done),
        (acc, s) -> if(s.end <= acc.at, acc, struct(s.end as at,
            concat(acc.done, substring(text, cast(acc.at + 1 as int), cast(greatest(s.begin - acc.at, 0) as int)), if(s.begin < acc.at, '', concat('[', s.pii_type, ']'))) as done)),
        acc -> concat(acc.done, substring(text, cast(acc.at + 1 as int))))"""
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return source.join(per, same, "left").select("origin", "record_id", F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(cut)).alias("clean_text"))
