"""One consistent form for texts that look alike.

DuckDB runs inside the Arrow partitions and does all of the text work in its
embedded SQL: ``nfc_normalize`` composes accents, regular expressions drop
invisible characters, ``replace`` opens joined letters and ``translate`` maps
full-width forms, kinds of space and look-alike letters.

What a reader can tell apart stays apart: raised and circled digits, fraction
signs, letter case, accents, and the joiner inside an emoji.

Defined results: null and empty texts stay null and empty and form no pairs;
texts are never cut; copies of one text are one class, whose members pair with
those of the form's other classes; rows without an id form no pairs; repeated
rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import stage

# Look-alike letters, joined letters, spaces, invisible characters.
LETTERS = {
    "Latin for Cyrillic": ("АВЕЅІЈКМНОРСТХаеорсухѕіјԁһԛԝҮԚԜЁёЇї", "ABESIJKMHOPCTXaeopcyxsijdhqwYQWËëÏï"),
    "Latin for Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϹϳόΪΫ", "ABEZHIKMNOPTYXovcCjóÏŸ"),
    "one of two alike": ("µɡ‐‑", "μg--"),
}
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
SPACES = "               　"
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}\x{200C}\x{200D}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_KEPT = ""  # stands for an emoji's joiner while the others go
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def mapping() -> tuple[str, str]:
    """The two strings of ``translate``."""
    pairs = [*LETTERS.values(), WIDE, (SPACES, " " * len(SPACES)), (_KEPT, "‍")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str) -> str:
    """The DuckDB expression that brings ``column`` to its consistent form."""
    emoji = r"([\p{So}\x{1F3FB}-\x{1F3FF}\x{FE0F}])\x{200D}([\p{So}])"
    s = f"nfc_normalize({column})"
    for _ in range(2):  # neighbours in a chain share a sign
        s = f"regexp_replace({s}, {_literal(emoji)}, {_literal(chr(92) + '1' + _KEPT + chr(92) + '2')}, 'g')"
    s = f"regexp_replace({s}, {_literal(INVISIBLE)}, '', 'g')"
    for joined, parts in JOINED.items():
        s = f"replace({s}, {_literal(joined)}, {_literal(parts)})"
    a, b = mapping()
    return f"nfc_normalize(translate({s}, {_literal(a)}, {_literal(b)}))"


def canonical(df: DataFrame, key: str, text: str, *, content: bool = True) -> DataFrame:
    """(key, canonical_text, raw_key, canonical_key): the consistent form of
    each text and 128-bit keys of both. ``content=False`` leaves the form out."""
    form = "CASE WHEN c = t THEN t ELSE c END" if content else "CAST(NULL AS VARCHAR)"
    sql = f"SELECT k, {form} AS c, md5(t) AS r, md5(c) AS m FROM (SELECT k, t, {canonical_sql('t')} AS c FROM batch)"
    kind = df.schema[key].dataType.simpleString()
    schema = pa.schema([("k", pa.int64() if kind in ("bigint", "int") else pa.string()), ("c", pa.string()), ("r", pa.string()), ("m", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            out = con.sql(sql).to_arrow_table().cast(schema)
            con.unregister("batch")
            yield from out.to_batches()
        con.close()

    source = df.select(F.col(key).cast("bigint" if kind == "int" else kind).alias("k"), F.col(text).alias("t"))
    return source.mapInArrow(run, f"k {'bigint' if kind in ('bigint', 'int') else 'string'}, c string, r string, m string").select(F.col("k").alias(key), F.col("c").alias("canonical_text"), F.col("r").alias("raw_key"), F.col("m").alias("canonical_key"))


#: Members of a form that meet the others in one task; larger forms are salted.
ROOM = 2000


def form_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical_key, raw_key) of the non-empty texts, staged: DuckDB runs
    once over them, whatever is made of the keys."""
    got = canonical(df.filter(F.length(text) > 0), key, text, content=False)
    return stage(got.filter(F.col(key).isNotNull()).select(key, "canonical_key", "raw_key"), "alike-keys")


def alike_pairs(df: DataFrame, key: str, text: str, *, room: int = ROOM) -> DataFrame:
    """Pairs of documents whose texts differ in code points and share their
    form, smaller id first: every document of one class of exact copies with
    every one of the form's other classes.

    Only forms of several classes go on to the join; keys of 128 bits stand for
    the texts. The members of a form are spread over as many salts as ``room``
    goes into their number, so that no task holds the pairs of a large form."""
    keys = form_keys(df, key, text)
    forms = keys.groupBy("canonical_key").agg(F.min("raw_key").alias("a"), F.max("raw_key").alias("b"), F.count("*").alias("n"))
    several = forms.filter("a <> b").select("canonical_key", F.ceil(F.col("n") / F.lit(room)).cast("int").alias("salts"))
    kept = stage(keys.join(several, "canonical_key").select("canonical_key", "raw_key", F.col(key).alias("doc"), "salts").distinct(), "alike-members")
    a = kept.select("canonical_key", F.col("raw_key").alias("raw_a"), F.col("doc").alias("doc_id_a"), F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"))
    b = kept.select("canonical_key", F.col("raw_key").alias("raw_b"), F.col("doc").alias("doc_id_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["canonical_key", "salt"]).filter("doc_id_a < doc_id_b and raw_a <> raw_b").select("doc_id_a", "doc_id_b")


def alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form_id, copy_id, n_links): one row a document with text. form_id
    is the smallest id of its form, copy_id that of its exact copies, n_links
    the number of documents that look alike and differ in code points. Counts
    are summed map-side before the joins; nothing is paired."""
    keys = form_keys(df, key, text).distinct()
    copies = keys.groupBy("canonical_key", "raw_key").agg(F.min(key).alias("copy_id"), F.count("*").alias("n_copies"))
    forms = copies.groupBy("canonical_key").agg(F.min("copy_id").alias("form_id"), F.sum("n_copies").alias("n_form"))
    both = copies.join(forms, "canonical_key").select("canonical_key", "raw_key", "copy_id", "form_id", (F.col("n_form") - F.col("n_copies")).alias("n_links"))
    return keys.join(both, ["canonical_key", "raw_key"]).select(key, "form_id", "copy_id", "n_links")
