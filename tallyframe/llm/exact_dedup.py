"""Exact deduplication through a log-structured merge index of text digests.

Memtable: each task gathers (digest, smallest identifier, rows) and, when its memtable is full, flushes a
sorted run for each digest range, with a Bloom filter of the run's digests. Compaction: the runs of a range
meet in one task, level by level: filters tell which digests a level may hold, binary search finds them, and the
smallest identifier and the sum of rows are kept; levels of like size are merged. Runs carry one entry per distinct
digest, so a group of copies arrives already added up. Lookup: every row's digest is
joined with the compacted index. Hits (digests of several rows) receive byte verification: the rows' texts
are compared with the text of the row that stays. If a digest ever held different texts, its rows are
regrouped by the texts themselves.

Texts are equal when they are identical after each ``[\\x20\\x09-\\x0D]+`` becomes one space; null counts as
empty. Rows without doc_id come after all others (they stay only if the whole group has none). Of rows that
repeat one doc_id and text, one is kept. Empty tables give empty results; extra columns are ignored by
``groups`` and carried by ``deduplicated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, shipped, staged

#: Rows of a task's memtable before it is flushed.
MEMTABLE_ROWS = 200_000
#: Digests in one range of the compacted index, about.
RANGE_ROWS = 500_000
#: Digests of copies that are broadcast as a filter (32 bytes each); beyond, the join is shuffled.
FILTER_ROWS = 200_000
_FILTER_BITS_A_KEY = 10

#: ``none`` tells rows without identifier, which come after all others; their id is 0.
RUN = "shard int, level int, digests binary, none binary, ids binary, uids binary, counts binary, filter binary"


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _sorted_run(words: np.ndarray, none: np.ndarray, ids: np.ndarray, uids: np.ndarray, counts: np.ndarray):
    """One entry per digest, in digest order, with its smallest identifier; words: n x 4 big-endian integers."""
    order = np.lexsort((uids, ids, none, words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    words, none, ids, uids, counts = words[order], none[order], ids[order], uids[order], counts[order]
    first = np.ones(len(ids), bool)
    first[1:] = (words[1:] != words[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return words[at], none[at], ids[at], uids[at], np.add.reduceat(counts, at) if len(at) else counts


def bloom(words: np.ndarray) -> bytes:
    """Bloom filter with seven probes by double hashing; digests are uniform already."""
    bits = max(64, 1 << int(np.ceil(np.log2(max(1, len(words)) * _FILTER_BITS_A_KEY))))
    out = np.zeros(bits // 8, np.uint8)
    for probe in _probes(words, bits):
        np.bitwise_or.at(out, probe >> 3, np.uint8(1) << (probe & 7).astype(np.uint8))
    return out.tobytes()


def _probes(words: np.ndarray, bits: int):
    with np.errstate(over="ignore"):
        for k in range(7):
            yield ((words[:, 2] + np.uint64(k) * (words[:, 3] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def may_contain(filter_bytes: bytes, words: np.ndarray) -> np.ndarray:
    table = np.frombuffer(filter_bytes, np.uint8)
    found = np.ones(len(words), bool)
    for probe in _probes(words, len(table) * 8):
        found &= (table[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1
    return found


def _words(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").reshape(-1, 4).astype(np.uint64)


def _rows(level: int, shards: int, words, none, ids, uids, counts) -> pa.RecordBatch:
    """A run cut by digest range, each part with its filter."""
    shard = ((words[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    out = [
        (s, level, words[a:b].astype(">u8").tobytes(), none[a:b].tobytes(), ids[a:b].tobytes(), uids[a:b].tobytes(), counts[a:b].tobytes(), bloom(words[a:b]))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:]))
        if b > a
    ]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in RUN.split(", ")])


class Levels:
    """The runs of one digest range. A new run's digests are looked up only in levels whose filter may hold them; hits
    keep the smaller identifier there, the others become a new level, and levels of like size are merged."""

    def __init__(self):
        self.levels: list[list] = []  # words, none, ids, uids, counts, filter

    def add(self, run: tuple, filter_bytes: bytes) -> None:
        words, none, ids, uids, counts = run
        new = np.ones(len(ids), bool)
        for held, *first, of, filter_bits in self.levels:
            maybe = np.flatnonzero(new & may_contain(filter_bits, words))
            at = _find(held, words[maybe])
            mine, at = maybe[at >= 0], at[at >= 0]
            of[at] += counts[mine]
            less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
            for ours, theirs in zip((none, ids, uids), first):
                less |= same & (ours[mine] < theirs[at])
                same &= ours[mine] == theirs[at]
            for ours, theirs in zip((none, ids, uids), first):
                theirs[at[less]] = ours[mine[less]]
            new[mine] = False
        if new.any():
            kept = [np.array(x[new]) for x in run]
            self.levels.append([*kept, filter_bytes if new.all() else bloom(kept[0])])
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge_last()

    def _merge_last(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        both = _sorted_run(*(np.concatenate([x, y]) for x, y in zip(a[:5], b[:5])))
        self.levels.append([*both, bloom(both[0])])

    def merged(self) -> tuple:
        while len(self.levels) > 1:
            self._merge_last()
        return tuple(self.levels[0][:5])


def _find(held: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each digest in a sorted run, or -1: binary search by the first word, then the whole digest."""
    first = np.ascontiguousarray(held[:, 0])
    at = np.searchsorted(first, words[:, 0])
    out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
    while len(open_):  # more than once only where first words are equal
        open_ = open_[at[open_] < len(first)]
        open_ = open_[first[at[open_]] == words[open_, 0]]
        same = (held[at[open_]] == words[open_]).all(axis=1)
        out[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
    return out


def flushed_runs(digests: DataFrame, shards: int) -> DataFrame:
    """Level 0: what the tasks' memtables flush. digests: digest, doc_id, uid."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            held.append(_sorted_run(_words(batch.column("digest")), none, ids, batch.column("uid").to_numpy(), np.ones(len(ids), np.int64)))
            n += len(held[-1][2])
            if n >= MEMTABLE_ROWS:
                yield _rows(0, shards, *_sorted_run(*map(np.concatenate, zip(*held))))
                held, n = [], 0
        if held:
            yield _rows(0, shards, *_sorted_run(*map(np.concatenate, zip(*held))))

    return digests.select("digest", "doc_id", "uid").mapInArrow(frugal(run), RUN)


def compacted(runs: DataFrame, shards: int) -> DataFrame:
    """Level 1: digest, keep_id, keep_uid, group_size; the runs of a range are merged as they come."""

    def merge(batches):
        shard, levels = None, None

        def out():
            words, none, ids, uids, counts = levels.merged()
            raw = words.astype(">u8").tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.Array.from_buffers(pa.binary(32), len(ids), [None, pa.py_buffer(raw)]).cast(pa.binary()),
                    pa.array(ids, mask=none > 0),
                    pa.array(uids),
                    pa.array(counts),
                ],
                ["digest", "keep_id", "keep_uid", "group_size"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if levels is not None:
                        yield out()
                    shard, levels = row["shard"], Levels()
                words = np.frombuffer(row["digests"], ">u8").reshape(-1, 4).astype(np.uint64)
                levels.add((words, np.frombuffer(row["none"], np.uint8), *(np.frombuffer(row[c], np.int64) for c in ("ids", "uids", "counts"))), row["filter"])
        if levels is not None:
            yield out()

    return runs.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("shard").mapInArrow(frugal(merge), "digest binary, keep_id long, keep_uid long, group_size long")


def groups(docs: DataFrame, verify: bool = True) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    shipped(docs.sparkSession)
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    hashed = texts.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"))
    digests = staged(hashed.withColumn("uid", F.monotonically_increasing_id()), "digests")
    shards = 4 + digests.count() // RANGE_ROWS
    index = staged(compacted(flushed_runs(digests, shards), shards), "lsm-index")
    found = digests.join(index, "digest").withColumn("exact", F.lit(None).cast("string"))
    if verify and (bad := _different_texts(texts, index)) is not None:
        found = found.join(bad, "digest", "left_anti").unionByName(_by_text(texts, bad))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _different_texts(texts: DataFrame, index: DataFrame) -> DataFrame | None:
    """Digests whose rows' bytes differ from the kept row's, or None."""
    hits = index.filter("group_size > 1").select("digest", "keep_id")
    n = hits.count()
    if not n:
        return None
    rows = texts.select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"))
    small = n <= FILTER_ROWS
    members = rows.join(F.broadcast(hits.select("digest")) if small else hits.select("digest"), "digest", "left_semi")
    mine = hits.select("digest", "keep_id")
    kept = rows.join(F.broadcast(mine) if small else mine, "digest").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = kept.groupBy("digest").agg(F.min("norm").alias("kept_norm"))  # repeated rows of one id: the first text
    kept = staged(kept, "lsm-kept")
    # no aggregate follows the join in its stage, so that a large group can be split there
    bad = staged(members.join(kept, "digest").filter(F.col("norm") != F.col("kept_norm")).select("digest"), "lsm-mismatch")
    return bad.distinct() if bad.take(1) else None


def _by_text(texts: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of digests that several texts share, grouped by the texts."""
    rows = texts.select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest")).join(bad, "digest", "left_semi")
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "lsm-regroup")
    first = rows.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))).alias("k"), F.count("*").alias("group_size")
    )
    first = first.select("digest", "norm", F.col("k.id").alias("keep_id"), F.col("k.uid").alias("keep_uid"), "group_size")
    return rows.join(first, ["digest", "norm"]).select("digest", "doc_id", "uid", "keep_id", "keep_uid", "group_size", F.col("norm").alias("exact"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by doc_id; where an id is missing or stands for several rows, by text as well.
    """
    found = staged(groups(docs), "lsm-groups")
    gone = found.filter(~F.col("kept")).select("doc_id")
    unclear = gone.filter("doc_id is null").unionByName(gone.join(found.filter("kept").select("doc_id"), "doc_id", "left_semi"))
    if not unclear.take(1):
        return docs.join(gone, "doc_id", "left_anti")
    taken = {c.lower() for c in docs.columns}
    digest, keep = (next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}") not in taken) for name in ("digest", "keep"))
    marked = docs.withColumn(digest, F.sha2(normalised(F.col("text")), 256))
    stays = found.filter("kept").select(F.col("text_sha256").alias(digest), F.col("doc_id").alias(keep))
    return marked.join(stays, digest).filter(F.col("doc_id").eqNullSafe(F.col(keep))).dropDuplicates([digest]).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


OP5_SQL = """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
