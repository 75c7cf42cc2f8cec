"""URL verdicts by rules and, where none fits, by a cascade of Bloom filters; DataFrame and SQL functions only.

The key of a URL is its host and path. The cascade is built over all distinct keys of the corpus: the first level encodes
the listed keys, the second those keys of the corpus that pass the first without being listed, the third the listed keys
that pass the second, and so on until no key passes wrongly. So membership is exact for every key of the corpus, and rows
are judged where they lie: the filters are scalar subqueries, and no row is shuffled or joined. Each level hashes anew, so
the sets that are left shrink by the level's rate and the loop ends.

Filters are cut into segments by a hash of the key. A pass over the rows carries the segments of PASS_BYTES at most; a
larger cascade takes more passes, each over the rows of its segments, so what is sent to a task is bounded whatever the
length of the list. Distinct keys are aggregated before their shuffle, so a host with a third of all rows is no hot key.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to ``?``, ``#`` or the end;
a null url, or one without ``://``, has both empty. A rule fits its host and all subdomains of it if the path starts with
the rule's; the longest wins, of equally long ones the first in order of text. Listed keys that no row has change nothing,
null ones are left out, repeated ones count once. Each row gives a row, repeated ones and those without page_id too. Empty
tables give empty results, an empty list allows whatever no rule blocks. Only page_id and url are read, so extra columns
of any name do no harm. Urls are taken whole, whatever their length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

BLOCK, ALLOW = "block", "allow"
#: verdict, host, path
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]
#: Words of host names whose keys are on the query's list.
TERMS = ["ads", "adult", "bets", "casino", "pills", "spam"]
#: Bits of a segment of the first level, about; bytes of all levels that one pass carries.
SEGMENT_BITS = 1 << 23
PASS_BYTES = 32 << 20
#: Rate of wrong passes of the second and later levels, as a power of 1/2.
LATER_PROBES = 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _UPPER.lower()), path


def with_key(pages: DataFrame) -> DataFrame:
    """page_id, host, path and key."""
    host, path = parts(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))


def fitting_rule(rules: list[tuple[str, str, str]]) -> Column:
    """The rule that wins for host and path as a struct of its text and verdict, else null."""
    found = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        inside = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits = inside & F.startswith("path", F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


@dataclass
class Cascade:
    """Segments of each level as tables of (segment, words), with their words a segment and probes a key."""

    segments: int
    levels: list[tuple[DataFrame, int, int]] = field(default_factory=list)

    def segment(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(self.segments)).cast("int")

    def places(self, level: int, words: int, probes: int, key: Column) -> list[Column]:
        """Bits of a key in its segment of a level."""
        return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(64 * words)) for i in range(probes)]

    def passes(self, key: Column, first: int, last: int, from_level: int = 0) -> Column:
        """Whether a key of the segments from first to before last passes a level and is not taken back by the later ones."""
        table, words, probes = self.levels[from_level]
        some = table.filter(F.col("segment").between(first, last - 1)).agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "words"))), lambda x: x["words"]))
        own = F.get(some.scalar(), self.segment(key) - first)
        hit = F.lit(True)
        for place in self.places(from_level, words, probes, key):
            word = F.get(own, F.shiftrightunsigned(place, 6).cast("int"))
            hit &= word.bitwiseAND(_bit(place)) != 0
        if from_level + 1 < len(self.levels):
            hit &= ~self.passes(key, first, last, from_level + 1)
        return hit

    def batches(self) -> list[tuple[int, int]]:
        """Segments from and to of each pass."""
        step = max(1, PASS_BYTES // max(1, sum(8 * words for _, words, _ in self.levels)))
        return [(a, min(a + step, self.segments)) for a in range(0, self.segments, step)]

    def judged(self, rows: DataFrame, name: str = "listed") -> DataFrame:
        """``rows`` with whether their ``key`` is listed."""
        if not self.levels:
            return rows.withColumn(name, F.lit(False))
        batches, out = self.batches(), None
        for first, last in batches:
            own = rows if len(batches) == 1 else rows.filter(self.segment(F.col("key")).between(first, last - 1))
            own = own.withColumn(name, self.passes(F.col("key"), first, last))
            out = own if out is None else out.unionByName(own)
        return out

    def add(self, encoded: DataFrame, n: int, probes: int) -> None:
        """A level that holds the n keys of ``encoded``."""
        fullest = n if self.segments == 1 else encoded.groupBy(self.segment(F.col("key"))).count().agg(F.max("count")).first()[0]
        level, words = len(self.levels), max(1, math.ceil(fullest * probes / math.log(2) / 64))
        bits = encoded.select(self.segment(F.col("key")).alias("segment"), F.explode(F.array(*self.places(level, words, probes, F.col("key")))).alias("place"))
        masks = bits.select("segment", F.shiftrightunsigned("place", 6).cast("int").alias("word"), _bit(F.col("place")).alias("mask"))
        blank = encoded.sparkSession.range(self.segments * words).select((F.col("id") / words).cast("int").alias("segment"), (F.col("id") % words).cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
        rows = masks.unionByName(blank).groupBy("segment", "word").agg(F.bit_or("mask").alias("mask"))
        rows = rows.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words"))
        self.levels.append((staged(rows, f"filter-{level}"), words, probes))

    def wrong(self, others: DataFrame) -> DataFrame:
        """Keys of ``others`` that pass the last level."""
        alone = Cascade(self.segments, self.levels)
        out = None
        for first, last in self.batches():
            own = others.filter(alone.segment(F.col("key")).between(first, last - 1) & alone.passes(F.col("key"), first, last, len(self.levels) - 1))
            out = own if out is None else out.unionByName(own)
        return out


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade of the ``listed`` keys over all keys of ``universe`` (column key of both)."""
    both = universe.select("key", F.lit(True).alias("here"), F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(False).alias("here"), F.lit(True).alias("listed")))
    keys = both.filter("key is not null").groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed"))
    keys = staged(keys.filter("here").select("key", "listed"), "keys")
    n, n_listed = keys.agg(F.count("*"), F.count_if("listed")).first()
    if not n_listed:
        return Cascade(1)
    # the first level is worth a longer filter, the rarer listed keys are
    probes = max(1, min(20, round(math.log2(max(1, n - n_listed) / n_listed))))
    cascade = Cascade(max(1, math.ceil(n_listed * probes / math.log(2) / SEGMENT_BITS)))
    encoded, others, size = keys.filter("listed").select("key"), keys.filter("not listed").select("key"), n_listed
    while size:
        cascade.add(encoded, size, probes)
        encoded, others = staged(cascade.wrong(others), "wrong"), encoded
        size, probes = encoded.count(), LATER_PROBES
    return cascade


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    rows = with_key(pages)
    cascade = build(rows.select("key"), listed)
    found = cascade.judged(rows).withColumn("found", fitting_rule(rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), BLOCK).otherwise(ALLOW))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def listed_by_terms(pages: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """Keys of the corpus with one of the ``terms`` in their host; stands for a list that a user has."""
    named = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, terms)))
    return with_key(pages).filter(named).select("key")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge(pages, listed_by_terms(pages))


OP12_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), k AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM k
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {TERMS}) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
