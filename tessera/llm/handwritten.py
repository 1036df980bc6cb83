"""Generated, minified, vendored files and data saved as code.

A file's head goes through a multi-pattern automaton of generation notices; a
notice counts where it is one: strong notices anywhere in the head, weak ones
only as the first words of a comment, ``do not edit`` only at the end of its
sentence. Path rules (JVM-side) cover vendored and build folders, lock files
and suffixes of generated and minified files; long average lines give away
minified code and data.

Defined results: a null or empty path matches no rule; null heads have no
notice; null or zero sizes give no average; paths are compared after
:func:`normal_path`; repeated rows give their key once. An empty table of
indexed files leaves the ranked ones to the path rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.session import stage

# Folders and suffixes of files nobody wrote by hand.
FOLDERS = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "_vendor", "third_party", "third-party", "thirdparty", "external", "externals", "extern", "site-packages", "dist-packages", "venv", ".venv", "virtualenv",
    "__generated__", "generated", "gen", "_build", "build", "dist", "deps", "pods", "carthage", "godeps", "__pycache__", ".next", ".nuxt", ".tox", ".eggs",
)
FILES = (
    r"[._-]min\.(?:js|css|mjs)$", r"\.bundle\.js$", r"\.chunk\.(?:js|css)$", r"\.pb\.(?:go|cc|h)$", r"_pb2(?:_grpc)?\.pyi?$", r"\.g\.(?:py|dart|cs|ts|go)$",
    r"[._-]generated\.\w+$", r"^zz_generated[._]", r"[._-](?:autogen|autogenerated)\.\w+$", r"\.designer\.(?:cs|vb)$", r"-\d+\.\d+(?:\.\d+)*\.(?:js|css)$",
    r"[.-][0-9a-f]{8,40}(?:\.\w+)?\.(?:js|css)$", r"\.(?:js|css)\.map$", r"^(?:package-lock|npm-shrinkwrap)\.json$", r"^(?:yarn|poetry|cargo|gemfile|composer|pipfile|pdm|uv|flake)\.lock$", r"^pnpm-lock\.yaml$", r"^go\.sum$",
)
#: Notice: "s" counts anywhere, "l" as first words of a comment, "e" at the end of a sentence.
NOTICES = {
    "@generated": "s", "<auto-generated": "s", "code generated by": "s", "automatically created by": "s", "automatically generated by": "s", "machine-written by": "s", "machine generated by": "s", "edits are overwritten": "s",
    "changes will be lost": "s", "edits will be lost": "s", "will be overwritten": "s", "change the template instead": "s", "output of go:generate": "s", "autogenerated from": "s", "auto-generated from": "s", "generated from protobuf": "s",
    "this file is generated": "s", "this file was generated": "s", "this file is auto-generated": "s", "this is a generated file": "s",
    "auto-generated": "l", "autogenerated": "l", "generated by": "l", "generated from": "l", "automatically generated": "l",
    "do not edit": "e", "do not modify": "e", "don't edit": "e", "do not change": "e",
}
LONG_LINE = 200  # average characters a line
_LEAD = re.compile(r"(?:^|\n)[\s/*#;<!\-\"'%(]*$")
_END = re.compile(r"\s*(?:[.!;)*\-]|\n|$)")


def notices() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for text, kind in NOTICES.items():
        a.add_word(text, (len(text), kind))
    a.make_automaton()
    return a


def has_notice(automaton: ahocorasick.Automaton, head: str | None) -> bool:
    """Whether a head says that the file was generated."""
    if not head:
        return False
    low = head.lower()
    for last, (size, kind) in automaton.iter(low):
        if kind == "s" or kind == "l" and _LEAD.search(low, 0, last + 1 - size) or kind == "e" and _END.match(low, last + 1):
            return True
    return False


def notice_in(column: str) -> Column:
    """:func:`has_notice` of a column, by Arrow batch."""

    def run(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = notices()
        for batch in heads:
            yield pd.Series([has_notice(automaton, h) for h in batch], dtype="bool")

    run.__annotations__ = {"heads": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.BooleanType())(column)


def normal_path(path: Column, project: Column) -> Column:
    """One way to write a path: forward slashes, no ``.`` or empty parts, no
    checkout folder before the project's own files; letter case stays."""
    p = F.translate(F.trim(path), "\\", "/")
    q = F.regexp_replace(p, r"^(?:file:)?/+", "/")
    q = F.regexp_replace(F.regexp_replace(q, "/{2,}", "/"), r"(^|/)(?:\./)+", "$1")
    q = F.regexp_replace(q, r"(^|/)[^/.][^/]*/\.\./", "$1")
    inside = F.position(F.concat(F.lit("/"), project, F.lit("/")), q)
    q = F.when(p.rlike("^(?:/|[A-Za-z]:|file:)") & (inside > 0), q.substr(inside + F.length(project) + F.lit(2), F.length(q))).otherwise(q)
    # most paths are plain already
    return F.when(p.rlike(r"^(?:/|\./|[A-Za-z]:|file:)|//|/\.{1,2}/|^\.\./"), F.regexp_replace(q, "^/+", "")).otherwise(p)


def by_path(path: Column) -> Column:
    """Whether the path alone says that nobody wrote the file by hand."""
    low = F.lower(path)
    folders = "|".join(re.escape(f) for f in FOLDERS)
    files = "|".join(FILES)
    return F.coalesce(low.rlike(rf"(?:^|/)(?:{folders})/") | F.regexp_extract(low, r"([^/]*)$", 1).rlike(files), F.lit(False))


def judged(files: DataFrame) -> DataFrame:
    """(project_name, path, file_id, by_path, by_size, by_notice) of indexed files."""
    path = normal_path(F.col("file_path"), F.coalesce("project_name", F.lit("")))
    return files.select(
        "project_name",
        path.alias("path"),
        "file_id",
        by_path(path).alias("by_path"),
        F.coalesce(F.try_divide("n_bytes", "n_lines") > LONG_LINE, F.lit(False)).alias("by_size"),
        notice_in("head_text").alias("by_notice"),
    )


def not_handwritten(files: DataFrame, ranked: DataFrame) -> DataFrame:
    """(origin, record_id) of the rows of both tables whose file isn't
    hand-written. The paths are judged once, before the join; only the files
    that their content gives away stand on its other side."""
    seen = stage(judged(files).filter("by_path or by_size or by_notice"), "files-judged")
    own = seen.select(F.lit("file_symbols").alias("origin"), F.col("file_id").cast("string").alias("record_id"))
    told = seen.filter("not by_path").select("project_name", "path").distinct().withColumn("told", F.lit(True))
    path = normal_path(F.col("file_path"), F.coalesce("project_name", F.lit("")))
    rows = ranked.select(F.col("rank_id").cast("string").alias("record_id"), "project_name", path.alias("path"))
    rows = rows.select("record_id", "project_name", "path", by_path(F.col("path")).alias("by_path"))
    joined = rows.join(told, ["project_name", "path"], "left").filter(F.col("by_path") | F.col("told").isNotNull())
    return own.unionByName(joined.select(F.lit("ranked_file").alias("origin"), "record_id")).distinct()
