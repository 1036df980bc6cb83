"""Source trees as tables: listings, texts, evidence rows.

Listings read file metadata only; contents are read where a column asks for
them. Folder rules are tests on the parts of the path below the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What the scans leave out and take in.
TREE_FOLDERS = (".git", ".github", ".idea", ".vscode", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", "env", "node_modules", "build", "dist", "target", ".dart_tool", ".next", ".turbo", ".gradle", "coverage")
TREE_FILES = (".DS_Store", "Thumbs.db")
PROJECT_EXTENSIONS = (".py", ".dart", ".ts", ".tsx", ".js", ".jsx", ".json", ".yaml", ".yml", ".toml", ".sql", ".md")
PROJECT_FOLDERS = (".git", ".idea", ".vscode", "__pycache__", ".pytest_cache", ".dart_tool", "build", "dist", "node_modules", ".venv", "venv")
CODE_EXTENSIONS = (".dart", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".env", ".md", ".html", ".css", ".sql", ".sh", ".bat")
CODE_FOLDERS = ("node_modules", ".git", "venv", ".venv", "build", "dist", "__pycache__", ".dart_tool", ".pub-cache", "android", "ios", "web", "windows", "linux", "macos")
LANGUAGES = {".py": "Python", ".dart": "Dart", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".sql": "SQL"}


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def listing(spark: SparkSession, root: str, *, content: bool = False) -> DataFrame:
    """(path below the root, modified, length[, content]) of all files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^\\Q" + base + "\\E/*", "")
    cols = [path.alias("path"), F.col("modificationTime").alias("modified"), "length"]
    return df.select(*cols, "content") if content else df.select(*cols)


def keep(files: DataFrame, folders: tuple[str, ...], extensions: tuple[str, ...] | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Files under none of the folders, with one of the extensions."""
    parts = F.split("path", "/")
    below = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    out = files.filter(~F.arrays_overlap(below, F.array(*[F.lit(f) for f in folders])) | (F.size(parts) <= 1))
    if names:
        out = out.filter(~F.regexp_extract("path", r"([^/]+)$", 1).isin(*names))
    return out.filter(_extension(F.col("path")).isin(*extensions)) if extensions else out


def _glob(pattern: str) -> str:
    """A pattern as an expression on paths: ``*`` and ``?`` within a name, ``**``
    any folders; neither begins a hidden name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + r"(?:[^/.][^/]*/)*", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + r"(?:[^/.][^/]*(?:/[^/.][^/]*)*)?", i + 2
        elif pattern[i] in "*?":
            first = i == 0 or pattern[i - 1] == "/"
            out, i = out + (r"(?!\.)" if first else "") + ("[^/]*" if pattern[i] == "*" else "[^/]"), i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + ("\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] != "_" else pattern[i]), i + 1
    return out


def expand(files: DataFrame, patterns: list[str], *, fallback: bool = True) -> DataFrame:
    """(pattern, path) of the files that each pattern means: those it matches and
    all below folders that it matches; where there is none, with ``fallback``,
    the first file of the pattern's last name anywhere."""
    if not patterns:
        return files.select(F.lit("").alias("pattern"), "path").limit(0)
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    tests = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col("path").rlike(f"^(?:{_glob(p.strip('/'))})(?:/.*)?$").alias("hit"), (base == p.rstrip("/").rpartition("/")[2]).alias("named")) for p in dict.fromkeys(patterns)])
    rows = files.select("path", F.explode(F.filter(tests, lambda t: t["hit"] | t["named"])).alias("t")).select("path", "t.*")
    found = rows.filter("hit").select("pattern", "path")
    if not fallback:
        return found
    first = rows.groupBy("pattern").agg(F.max("hit").alias("any"), F.min("path").alias("path")).filter("not any")  # a row a pattern
    return found.unionByName(first.select("pattern", "path"))


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, name, node_type, depth): files and each folder above
    them, the root as ``.``; ordered folders first, then by name."""
    f = keep(files, TREE_FOLDERS, names=TREE_FILES)
    parts = F.split("path", "/")
    ups = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.when(i == F.size(parts), "file").otherwise("directory").alias("node_type"), i.alias("depth")))).alias("x")).select("x.*").distinct()
    name, parent = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_replace("path", r"/?[^/]+$", "")
    rows = ups.select("path", F.when(parent == "", ".").otherwise(parent).alias("parent"), name.alias("name"), "node_type", "depth")
    return rows.unionByName(files.sparkSession.createDataFrame([(".", None, ".", "directory", 0)], "path string, parent string, name string, node_type string, depth int"))


def bounded_text(files: DataFrame, most_kb: int = 256) -> DataFrame:
    """(path, text): texts over the limit are headed and cut."""
    text = F.decode("content", "UTF-8")
    head = F.concat(F.lit(f"[Truncated — showing first {most_kb}KB of "), F.floor(F.col("length") / 1024).cast("string"), F.lit("KB]\n"))
    return files.select("path", F.when(F.col("length") > most_kb * 1024, F.concat(head, F.substring(text, 1, most_kb * 1024))).otherwise(text).alias("text"))


def file_evidence(files: DataFrame) -> DataFrame:
    """FILE evidence: content with name, extension, size and hashes."""
    meta = F.create_map(F.lit("filename"), F.regexp_extract("path", r"([^/]+)$", 1), F.lit("extension"), _extension(F.col("path")), F.lit("size_bytes"), F.col("length").cast("string"), F.lit("sha256"), F.sha2("content", 256), F.lit("md5"), F.md5("content"))
    return files.select(F.lit("FILE").alias("evidence_type"), "path", F.decode("content", "UTF-8").alias("content"), meta.alias("metadata"))


def terminal_evidence(runs: DataFrame) -> DataFrame:
    """TERMINAL evidence: one block of text a run."""
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    text = F.concat_ws("\n", F.concat(F.lit("COMMAND: "), F.coalesce("command", F.lit(""))), F.concat(F.lit("EXIT CODE: "), F.coalesce(F.col("exit_code").cast("string"), F.lit("None"))), F.lit(""), F.lit("================ STDOUT ================"), strip("stdout"), F.lit(""), F.lit("================ STDERR ================"), strip("stderr"))
    return runs.select("run_id", text.alias("content"), F.coalesce(F.length("stdout"), F.lit(0)).alias("stdout_length"), F.coalesce(F.length("stderr"), F.lit(0)).alias("stderr_length"), (strip("stderr") != "").alias("has_errors"))


def request_evidence(requests: DataFrame, text: str) -> DataFrame:
    """USER_REPORTED_PROBLEM evidence of the requests that say anything."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    return requests.select(F.lit("USER_REPORTED_PROBLEM").alias("evidence_type"), clean.alias("content")).filter("content <> ''")


def file_arguments(given: DataFrame, kinds: list[str], files: DataFrame) -> DataFrame:
    """Rows (evidence_type, path) of a known kind whose file is there."""
    return given.filter(F.col("evidence_type").isin(*kinds)).join(files.select("path").distinct(), "path", "left_semi").select("evidence_type", "path")


def content_hash(files: DataFrame) -> DataFrame:
    """(path, hash): MD5 of each file's bytes, '' where they can't be read."""
    return files.select("path", F.coalesce(F.md5("content"), F.lit("")).alias("hash"))


def extension_histogram(files: DataFrame, path: str = "path") -> DataFrame:
    """(extension, n, language)."""
    lang = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return files.groupBy(_extension(F.col(path)).alias("extension")).agg(F.count("*").alias("n")).withColumn("language", lang[F.col("extension")])


def fingerprint(files: DataFrame, group: str | None = None) -> DataFrame:
    """One hash of a repository's files with sizes: row hashes are summed, so
    no list of all files is built anywhere. Changes with any path or size."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\0", "path", F.col("length").cast("string")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    agg = [F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.sum(row).alias("fingerprint")]
    return files.groupBy(group).agg(*agg) if group else files.agg(*agg)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, hash)."""
    b, a = before.select("path", F.col("hash").alias("b")), after.select("path", F.col("hash").alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "path", "full").withColumn("change", kind).filter("change is not null").select("path", "change")
