"""Document fingerprints from closed syncmers; DataFrame and SQL functions only.

Symbols are the words of the lowered text (``[^\\x20\\x09-\\x0D]+``, in pieces of 32 characters where longer), k-mers are
K of them in a row, inner substrings one of them. A k-mer is chosen if the smallest hash of its inner substrings
is that of its first or last one. The choice depends on the k-mer alone, so the same passage gives the same anchors
wherever it stands. A text of fewer than K words, but not none, has one anchor: all its words. With ``filled``, as in
the query, so has a longer text in which no k-mer is chosen: only texts without words have no anchor.

``anchors`` gives positions and hashes, ``fingerprint`` the hashes in order, eight hex digits each; ``likeness`` is the
share of distinct anchors that two texts have in common (two empty ones are alike).

The next document is the one with the next smaller doc_id; after the smallest comes the largest. Rows without doc_id
come last, rows that repeat an id in order of their text's hash. Neighbours meet through one range bucketing of the
rows by id, hash and place, so that no id is a hot one: a bucket also gets the first row of the bucket that follows. Null text counts as empty. Empty tables give
empty results; a single row is its own next document. Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

K = 5
#: Rows of a bucket, about; beyond MAX_BUCKETS buckets grow, and are sorted on disk.
BUCKET_ROWS = 2_000
MAX_BUCKETS = 100_000


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[^\\x20\\x09-\\x0D]{1,32}"), 0)
    return F.transform(words, lambda w: F.hash(w))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chosen(h: Column, i: Column, k: int) -> Column:
    """Hash of the k-mer at i if it is a closed syncmer, else null."""
    inner = [F.get(h, i + j) for j in range(k)]
    least = F.least(*inner)
    return F.when((inner[0] == least) | (inner[-1] == least), F.hash(*inner))


def marks(text: Column, k: int = K, filled: bool = False) -> Column:
    """Hashes of the chosen k-mers, in order."""

    def of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - k)
        whole = F.when(F.size(h) > 0, F.array(F.hash(h))).otherwise(F.array().cast("array<int>"))
        found = F.when(F.size(h) >= k, F.filter(F.transform(places, lambda i: _chosen(h, i, k)), lambda x: x.isNotNull())).otherwise(whole)
        return _let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)) if filled else found

    return _let(word_hashes(text), of)


def anchors(docs: DataFrame, k: int = K, filled: bool = False) -> DataFrame:
    """doc_id, position (in words, from 0) and hash of each anchor, for matching by place."""
    rows = docs.select("doc_id", word_hashes(F.coalesce("text", F.lit(""))).alias("h"))
    h = F.col("h")
    places = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.struct(i.alias("position"), _chosen(h, i, k).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("position"), F.hash(h).alias("hash")))
    found = F.when(F.size(h) >= k, F.filter(places, lambda x: x["hash"].isNotNull())).when(F.size(h) > 0, whole)
    if filled:
        found = _let(found, lambda x: F.when((F.size(x) > 0) | (F.size(h) == 0), x).otherwise(whole))
    return rows.select("doc_id", F.inline(found))


def fingerprint(chosen: Column) -> Column:
    digits = F.transform(chosen, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    common, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


_KEY = "struct<n:int,r:bigint,h:bigint,t:bigint>"


def _key() -> Column:
    """Sorts rows: falling ids, those without one last, equal ids by their text's hash, equal rows as they come."""
    reverse = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))
    return F.struct(F.col("doc_id").isNull().cast("int").alias("n"), reverse.alias("r"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("t"))


def _place(key: Column, firsts: list[tuple]) -> Column:
    """The last of the rising ``firsts`` that is at or before ``key``, by binary search."""
    held = F.from_json(F.lit(json.dumps([dict(zip("nrht", f)) for f in firsts])), f"array<{_KEY}>")  # folded into one literal
    start = F.struct(F.lit(0).alias("a"), F.lit(len(firsts)).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        above = F.get(held, middle) <= key
        open_ = s["a"] < s["b"]
        return F.struct(F.when(open_ & above, middle + 1).otherwise(s["a"]).alias("a"), F.when(open_ & ~above, middle).otherwise(s["b"]).alias("b"))

    return F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(firsts).bit_length()))), start, halve, lambda s: s["a"]) - 1, F.lit(0))


def with_next(docs: DataFrame, filled: bool = False) -> DataFrame:
    """doc_id, text, its chosen k-mers, and both of the next document."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", _key().alias("key"))
    n = docs.count()
    ranged = keyed.select("key").repartitionByRange(int(min(MAX_BUCKETS, 1 + n // BUCKET_ROWS)), "key")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).collect()  # a row a bucket
    firsts = sorted(tuple(r["first"]) for r in firsts) or [(0, 0, 0, 0)]
    keyed = keyed.withColumn("b", _place(F.col("key"), firsts))
    # the first row of a bucket also ends the bucket before it, and the very first one the last bucket
    ends: dict[tuple, list[int]] = {}
    for k, first in enumerate(firsts):
        ends.setdefault(first[:3], []).append(k - 1 if k else len(firsts) - 1)
    ends = spark.createDataFrame([(*first, before) for first, before in ends.items()], "n int, r long, h long, before array<int>")
    ghosts = keyed.join(F.broadcast(ends), (F.col("key.n") == F.col("n")) & (F.col("key.r") == F.col("r")) & (F.col("key.h") == F.col("h")))  # MAX_BUCKETS rows at most
    # rows that agree in id and hash are one ghost, however many they are
    ghosts = ghosts.groupBy("n", "r", "h").agg(F.any_value("before").alias("before"), F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    ghosts = ghosts.select("doc_id", "text", F.explode("before").alias("b"), F.struct("n", "r", "h", F.lit(0).cast("long").alias("t")).alias("key"), F.lit(1).alias("ghost"))
    every = keyed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    every = every.repartitionById(len(firsts), "b").withColumn("marks", marks(F.col("text"), filled=filled))
    order = Window.partitionBy("b").orderBy("ghost", "key")
    every = every.select("*", F.lead("text").over(order).alias("next_text"), F.lead("marks").over(order).alias("next_marks"))
    return every.filter("ghost = 0").drop("ghost", "b", "key")


def edited_text(text: Column, following: Column) -> Column:
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - cut), F.left(following, cut))


def fingerprints(docs: DataFrame, filled: bool = False) -> DataFrame:
    rows = with_next(docs, filled).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "marks", "next_marks", marks(F.col("edited"), filled=filled).alias("edited_marks"))
    m, e = F.col("marks"), F.col("edited_marks")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(m).alias("fingerprint"),
        fingerprint(e).alias("edited_fingerprint"),
        likeness(m, e).alias("near_edited"),
        likeness(m, F.col("next_marks")).alias("near_next"),
    )


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir), filled=True)


def syncmer_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op10_closed_syncmers`` that SQL can express."""
    return op10_closed_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM d)
SELECT doc_id, n AS n_chars, sha256(substring(t, 1, n - n // 3) || substring(f, 1, n // 3)) AS edited_sha256 FROM e
"""
