"""Queries of the text problems over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import handwritten, leakage, lookalikes, mixing, pii, secrets, splitting
from tessera.session import table


def _sources(spark: SparkSession, base: str) -> DataFrame:
    return secrets.texts(table(spark, base, "evidence"), table(spark, base, "prompt_request"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Lines on which a credential begins."""
    return secrets.secret_spans(_sources(spark, base)).select("origin", "record_id", "file_ord", "line_no").distinct()


def p2_redacted(spark: SparkSession, base: str) -> DataFrame:
    """All texts, their credentials redacted."""
    source = _sources(spark, base)
    return secrets.redacted(source, secrets.secret_spans(source))


def _personal(spark: SparkSession, base: str) -> list[tuple[str, DataFrame]]:
    return pii.texts(table(spark, base, "prompt_request"), table(spark, base, "terminal_run"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Lines with personal information, by type."""
    return pii.personal_spans(_personal(spark, base)).select("origin", "record_id", "line_no", "pii_type").distinct()


def p4_clean(spark: SparkSession, base: str) -> DataFrame:
    """All texts with typed placeholders in place of personal information."""
    parts = _personal(spark, base)
    return pii.sanitised(parts, pii.personal_spans(parts))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Rows whose file isn't hand-written."""
    return handwritten.not_handwritten(table(spark, base, "file_symbols"), table(spark, base, "ranked_file"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Contents over the limit, and whether a cut falls inside a line."""
    return splitting.oversized(table(spark, base, "evidence"), table(spark, base, "evidence_chunk"))


def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    """The pieces of the oversized evidence and chunks."""
    return splitting.all_pieces(table(spark, base, "evidence"), table(spark, base, "evidence_chunk"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that repeat at least half of a held-out item."""
    return leakage.leaked(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "benchmark_item"), "item_id", "text").select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, base: str) -> DataFrame:
    """All documents without the leaked passages."""
    documents = table(spark, base, "documents")
    found = leakage.leaked(documents, "doc_id", "text", table(spark, base, "benchmark_item"), "item_id", "text", spans=True)
    return leakage.without_leaks(documents, "doc_id", "text", found)


def p8_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "mix_target"))[0]


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    """Wanted and actual shares of the mixture."""
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "mix_target"))[1]


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of documents that look alike and differ in code points."""
    return lookalikes.alike_pairs(table(spark, base, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, base: str) -> DataFrame:
    """Each document's class of look-alike texts and its number of links."""
    return lookalikes.alike_classes(table(spark, base, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, base: str) -> DataFrame:
    """Each document's consistent form."""
    return lookalikes.canonical(table(spark, base, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p4_found, p4_clean, p5_found, p6_found, p6_pieces, p7_found, p7_cleaned, p8_mix, p8_shares, p9_found, p9_classes, p9_forms)}
#: The consistent form, code point by code point, written apart from the operator.
_FORM = r"""u AS (SELECT doc_id, text, regexp_extract_all(nfc_normalize(text), '(?s).') AS c FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '')),
        v AS (SELECT doc_id, text, list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE
                WHEN unicode(c[i]) = 8205 THEN CASE WHEN i > 1 AND regexp_matches(c[i - 1], '[\p{So}\x{1F3FB}-\x{1F3FF}\x{FE0F}]') AND regexp_matches(c[i + 1], '\p{So}') THEN c[i] END
                WHEN unicode(c[i]) IN (173, 847, 1564, 6158, 65279) OR unicode(c[i]) BETWEEN 8203 AND 8207 OR unicode(c[i]) BETWEEN 8234 AND 8238 OR unicode(c[i]) BETWEEN 8288 AND 8292 OR unicode(c[i]) BETWEEN 8294 AND 8303 OR unicode(c[i]) BETWEEN 65024 AND 65039 THEN NULL
                WHEN unicode(c[i]) BETWEEN 65281 AND 65374 THEN chr(unicode(c[i]) - 65248)
                WHEN unicode(c[i]) IN (160, 5760, 8239, 8287, 12288) OR unicode(c[i]) BETWEEN 8192 AND 8202 THEN ' '
                ELSE coalesce(m[c[i]], c[i]) END), lambda x: x IS NOT NULL) AS k
              FROM u, (SELECT MAP {'А': 'A', 'В': 'B', 'Е': 'E', 'Ѕ': 'S', 'І': 'I', 'Ј': 'J', 'К': 'K', 'М': 'M', 'Н': 'H', 'О': 'O', 'Р': 'P', 'С': 'C', 'Т': 'T', 'Х': 'X', 'а': 'a', 'е': 'e', 'о': 'o', 'р': 'p', 'с': 'c', 'у': 'y', 'х': 'x', 'ѕ': 's', 'і': 'i', 'ј': 'j', 'ԁ': 'd', 'һ': 'h', 'ԛ': 'q', 'ԝ': 'w', 'Ү': 'Y', 'Ԛ': 'Q', 'Ԝ': 'W', 'Ё': 'Ë', 'ё': 'ë', 'Ї': 'Ï', 'ї': 'ï',
                'Α': 'A', 'Β': 'B', 'Ε': 'E', 'Ζ': 'Z', 'Η': 'H', 'Ι': 'I', 'Κ': 'K', 'Μ': 'M', 'Ν': 'N', 'Ο': 'O', 'Ρ': 'P', 'Τ': 'T', 'Υ': 'Y', 'Χ': 'X', 'ο': 'o', 'ν': 'v', 'ϲ': 'c', 'Ϲ': 'C', 'ϳ': 'j', 'ό': 'ó', 'Ϊ': 'Ï', 'Ϋ': 'Ÿ', chr(181): chr(956), chr(609): 'g', chr(8208): '-', chr(8209): '-',
                'ﬀ': 'ff', 'ﬁ': 'fi', 'ﬂ': 'fl', 'ﬃ': 'ffi', 'ﬄ': 'ffl', 'ﬅ': 'st', 'ﬆ': 'st', 'Ĳ': 'IJ', 'ĳ': 'ij', 'Ǉ': 'LJ', 'ǈ': 'Lj', 'ǉ': 'lj', 'Ǌ': 'NJ', 'ǋ': 'Nj', 'ǌ': 'nj'} AS m)),
        w AS (SELECT doc_id, text, nfc_normalize(array_to_string(k, '')) AS form FROM v)"""

#: A path in one form, and what it tells; written apart from the operator.
_P5_PATH = r"""CASE WHEN regexp_matches(p, '^(/|\./|[A-Za-z]:|file:)|//|/\.{1,2}/|^\.\./') THEN regexp_replace(CASE WHEN regexp_matches(p, '^(/|[A-Za-z]:|file:)') AND strpos(q, '/' || project || '/') > 0 THEN substr(q, strpos(q, '/' || project || '/') + length(project) + 2) ELSE q END, '^/+', '') ELSE p END"""
_P5_NORMAL = r"""SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^(file:)?/+', '/'), '/{2,}', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '(^|/)[^/.][^/]*/\.\./', '\1', 'g') AS q FROM (SELECT *, replace(trim(file_path, ' '), chr(92), '/') AS p, coalesce(project_name, '') AS project FROM {0})"""
_P5_TOLD = r"""(regexp_matches(lower(path), '(^|/)(node_modules|bower_components|jspm_packages|_?vendor|third[_-]?party|externals?|extern|site-packages|dist-packages|\.?venv|virtualenv|__generated__|generated|gen|_?build|dist|deps|pods|carthage|godeps|__pycache__|\.next|\.nuxt|\.tox|\.eggs)/')
        OR regexp_matches(regexp_extract(lower(path), '[^/]*$'), '[._-]min\.(js|css|mjs)$|\.bundle\.js$|\.chunk\.(js|css)$|\.pb\.(go|cc|h)$|_pb2(_grpc)?\.pyi?$|\.g\.(py|dart|cs|ts|go)$|[._-](auto)?gen(erated)?\.\w+$|^zz_generated[._]|\.designer\.(cs|vb)$|-\d+\.\d+(\.\d+)*\.(js|css)$|[.-][0-9a-f]{8,40}(\.\w+)?\.(js|css)$|\.(js|css)\.map$|^(package-lock|npm-shrinkwrap)\.json$|^(yarn|poetry|cargo|gemfile|composer|pipfile|pdm|uv|flake)\.lock$|^pnpm-lock\.yaml$|^go\.sum$'))"""
_P5_HEAD = r"""(regexp_matches(lower(head_text), '@generated|<auto-generated|code generated by|automatically (created|generated) by|machine-written by|machine generated by|edits are overwritten|(changes|edits) will be lost|will be overwritten|change the template instead|output of go:generate|auto-?generated from|generated from protobuf|this file (is|was) generated|this file is auto-generated|this is a generated file')
        OR regexp_matches(lower(head_text), '(^|\n)[\s/*#;<!\-"''%(]*(auto-?generated|generated (by|from)|automatically generated)') OR regexp_matches(lower(head_text), '(do not (edit|modify|change)|don''t edit)\s*([.!;)*\-]|\n|$)'))"""

SQL: dict[str, str] = {
    "p5_found": f"""WITH f AS (SELECT *, {_P5_PATH} AS path FROM ({_P5_NORMAL.replace('{0}', 'file_symbols')})), j AS (SELECT file_id, project_name, path, coalesce({_P5_TOLD}, false) AS by_path, coalesce(CASE WHEN n_lines <> 0 THEN n_bytes / n_lines END > 200, false) OR coalesce({_P5_HEAD}, false) AS by_content FROM f),
        r AS (SELECT rank_id, project_name, {_P5_PATH} AS path FROM ({_P5_NORMAL.replace('{0}', 'ranked_file')})), told AS (SELECT DISTINCT project_name, path FROM j WHERE by_content)
        SELECT DISTINCT 'file_symbols' AS origin, CAST(file_id AS VARCHAR) AS record_id FROM j WHERE by_path OR by_content UNION SELECT 'ranked_file', CAST(rank_id AS VARCHAR) FROM r LEFT JOIN told USING (project_name, path) WHERE coalesce({_P5_TOLD}, false) OR (project_name, path) IN (SELECT project_name, path FROM told)""",
    "p9_found": f"WITH {_FORM} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p9_classes": f"WITH {_FORM} SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS form_id, min(doc_id) OVER (PARTITION BY form, text) AS copy_id, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS n_links FROM w",
    "p9_forms": f"WITH {_FORM} SELECT doc_id, CASE WHEN text = '' THEN '' ELSE form END AS canonical_text, md5(text) AS raw_key, md5(coalesce(form, text)) AS canonical_key FROM (SELECT d.doc_id, d.text, w.form FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id)",
    "p6_found": """
        WITH t AS (SELECT 'evidence' AS origin, evidence_id AS record_id, content FROM evidence UNION ALL SELECT 'evidence_chunk', chunk_id, content FROM evidence_chunk)
        SELECT DISTINCT origin, record_id, CAST(list_max(list_transform(string_split(content, chr(10)), lambda l: length(rtrim(l, chr(13))))) > 6000 AS BIGINT) AS forced_cut
        FROM t WHERE length(content) > 6000""",
}
