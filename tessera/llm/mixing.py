"""Mix documents of several sources towards target shares of tokens.

Capped water-filling: each source gets its share of the budget; a source that
would be repeated more than its cap is clamped there, and what it leaves over
goes to the others in proportion to their weights, until nothing is clamped
anew. A source's rate (tokens wanted of tokens there are) then splits into whole
repetitions and a fraction; a seeded hash of the document's id decides whether a
document is used once more.

Defined results: sources are compared trimmed and in lower case; documents
without text, without a source or of a source without target aren't used; a
target without documents gets nothing and its weight goes to the others; shares
are divided by their sum; the budget is all tokens of the sources with targets
unless given. The sums over all documents are exact; only the sums, one row for
each target, reach the driver.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.session import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before byte-pair merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[bytes, tiktoken.Encoding] = {}


def encoder(content: bytes) -> tiktoken.Encoding:
    """The public tokenizer of a ranks file's content, kept by worker."""
    name = hashlib.sha256(content).digest()
    if name not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding(name.hex(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def counted(documents: DataFrame, key: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens) of documents with text; sources normalised. The
    vocabulary, one file of some 700 KB, is read by the driver and broadcast."""
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.filter(F.length(text) > 0).select(F.col(key).cast("bigint").alias("k"), F.lower(F.trim(source)).alias("s"), F.col(text).alias("t"))
    schema = pa.schema([("k", pa.int64()), ("s", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(encode(t)) for t in b.column(2).to_pylist()], pa.int64())], schema=schema)

    return rows.mapInArrow(run, "k bigint, s string, n bigint").select(F.col("k").cast(kind).alias(key), F.col("s").alias("source"), F.col("n").alias("n_tokens"))


def water_fill(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens that each source gives. Sources of no size give none."""
    given: dict[str, float] = {s: 0.0 for s in weights}
    active = {s: w for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0 and caps.get(s, 0) > 0}
    left = float(budget)
    while active and left > 0:
        total = sum(active.values())
        over = [s for s, w in active.items() if left * w / total >= sizes[s] * caps[s]]
        if not over:
            for s, w in active.items():
                given[s] = left * w / total
            break
        for s in over:
            given[s] = float(sizes[s] * caps[s])
            left -= given[s]
            del active[s]
    return given


def rates(tokens: DataFrame, targets: DataFrame, budget: float | None = None) -> list[tuple]:
    """(source, target share, tokens there are, documents, tokens wanted, rate, cap)
    of each target."""
    rows = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("w"), F.col("max_repeat").cast("double").alias("c")).filter("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.max("c").alias("c"))
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    got = [(r.source, r.w or 0.0, r.c or 0.0, int(r.n or 0), int(r.docs or 0)) for r in rows.join(sums, "source", "left").collect()]
    sizes = {s: n for s, _, _, n, _ in got}
    given = water_fill(sizes, {s: w for s, w, *_ in got}, {s: c for s, _, c, _, _ in got}, sum(sizes.values()) if budget is None else budget)
    whole = sum(w for _, w, *_ in got) or 1.0
    return [(s, w / whole, n, d, given[s], given[s] / n if n else 0.0, c) for s, w, c, n, d in sorted(got)]


_RATE = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("target_share", T.DoubleType()), ("tokens_there", T.LongType()), ("docs_there", T.LongType()), ("tokens_wanted", T.DoubleType()), ("rate", T.DoubleType()), ("cap", T.DoubleType()))])


def mixture(tokens: DataFrame, key: str, table: DataFrame, seed: int = 42) -> DataFrame:
    """(key, source, n_tokens, n_uses) of the documents that are used."""
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor("rate")
    uses = whole + F.when(share < F.col("rate") - whole, 1).otherwise(0)
    joined = tokens.join(table.select("source", "rate", "cap"), "source").withColumn("n_uses", F.least(uses, F.col("cap")).cast("bigint"))
    return joined.filter("n_uses > 0").select(key, "source", "n_tokens", "n_uses")


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, budget: float | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the documents used, the report of wanted and actual shares)."""
    spark = documents.sparkSession
    tokens = stage(counted(documents, key, text, source, vocabulary), "mix-tokens")
    table = spark.createDataFrame(rates(tokens, targets, budget), _RATE)
    chosen = mixture(tokens, key, table, seed)
    used = chosen.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens_used"), F.max("n_uses").alias("most_uses"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = table.join(used, "source", "left").select("source", "target_share", "tokens_there", "docs_there", "tokens_wanted", "rate", zero("docs_used"), zero("tokens_used"), zero("most_uses"))
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))  # one row a target
    return chosen, report.withColumn("actual_share", F.when(total > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0)))
