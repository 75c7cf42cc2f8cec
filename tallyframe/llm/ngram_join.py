"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Sets: distinct word shingles of the lowered whole text. Documents of equal sets form a class; classes are joined.
Order: shingles are ranked by an estimate of how many documents have them (a count sketch of fixed size), then by
hash. Any common order is correct; rare shingles first makes prefixes selective.
Prefixes: if two sets link, they share at least r = ceil(t n) shingles of either's n, so the first n - r + l shingles
of both share at least l. Each class takes the l from 1 to 4 with the least estimated cost (postings read, and
candidates times the cost of a verification, the candidates being the postings over l). A pair is a candidate if it
shares as many prefix shingles as the smaller of its two l; candidates are verified on whole sets. A pair is not even
met at a shingle before which its sets have lost too much (shingles that no other prefix has), nor verified if the
parity marks of its sets, which differ in no more bits than the sets in shingles, differ too much for a link.
Pairs: links are wanted for components, so groups are not paired out. First each class is verified against one hub, a
set in the middle of those that share its prefix shingles; what is then connected is not compared again, nor is a
pair that was verified. The last round takes every other candidate pair of different components, so that no link
between components is missed.
Components: alternating large and small stars over written tables.

Null text counts as empty. Documents without words link with nothing; with fewer words than a shingle, the whole
sequence is the only shingle. Rows that repeat an id or text are in one class; rows without doc_id are members, but
the smallest id of a component is taken over those that have one (null if none has). Empty tables give empty results;
extra columns are ignored by ``components_of`` and carried by ``one_of_each``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, frugal, mix, split_words, spread, staged, text_only, word_hashes

#: Counters of the frequency sketch, least and most (it is broadcast, 4 bytes each), and how they are cut for merging.
#: Beyond the most, counters hold many shingles each: their mean is taken off, and frequent shingles still stand out.
SKETCH_BITS, MOST_SKETCH_BITS = 22, 24
SLICE = 1 << 18
#: Characters of text for each counter.
COUNTER_CHARS = 4_000
#: Sketches that one task adds up; more are added in rounds.
FAN_IN = 64
#: A shingle of so many sets, by the sketch, is hot: its postings are dealt to so many tasks. Where its postings meet each
#: other, both sides are cut in pieces, and each piece of one meets each of the other in a place of its own.
HOT = 20_000
HOT_SALTS = 64
HOT_PIECES = 8
MAX_MATCHES = 4
#: Words of 64 bits in a set's parity mark.
MARK_WORDS = 16
#: Bytes of text that become sets at a time; the arrays of a batch take some twenty times as much.
SET_BYTES = 5_000_000
HUB_ROUNDS = 1
#: Bits of the filter that tells which documents' sets are needed; for more than an eighth as many, ids are joined.
FILTER_BITS = 1 << 26
#: Pieces that a component's classes are dealt to when they learn its smallest id.
ROOT_SALTS = 32
_SECOND = np.uint64(0x5A827999CA62C1D6)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and each text's bounds in them."""
    flat, bounds = split_words(texts)
    hashes = word_hashes(flat)
    sizes = np.diff(bounds)
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = spread(bounds[:-1], counts)
    full = sizes[owner] >= words
    found = np.zeros(len(owner), np.uint64)
    if full.any():
        value = hashes[first[full]]
        for k in range(1, words):
            value = mix(value, hashes[first[full] + k])
        found[full] = value
    for i in np.flatnonzero(~full):  # one a text, of a few words
        a = first[i]
        value = np.full(1, sizes[owner[i]], np.uint64)
        for k in range(int(sizes[owner[i]])):
            value = mix(value, hashes[a + k : a + k + 1])
        found[i] = value[0]
    order = np.lexsort((found, owner))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(sizes) + 1))


def _sums(found: np.ndarray, bounds: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Order-free 64-bit signature of each set."""
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(np.full_like(found, salt), found))])
        return (running[bounds[1:]] - running[bounds[:-1]]).view(np.int64)


def _slot(found: np.ndarray, counters: int) -> np.ndarray:
    return (found >> np.uint64(20)).astype(np.int64) & (counters - 1)


MARKS = [f"m{k}" for k in range(MARK_WORDS)]
SURVEY = "doc_id long, n int, cid long, other long, slice int, counts binary, " + ", ".join(f"{m} long" for m in MARKS)


def _marks(found: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Parity of the shingles at each of 1,024 places: marks of two sets differ in no more bits than the sets in shingles."""
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    place = (found >> np.uint64(54)).astype(np.int64)
    bit = np.uint64(1) << (place & 63).astype(np.uint64)
    out = []
    for k in range(MARK_WORDS):
        word = np.zeros(len(n), np.uint64)
        if len(full):
            word[full] = np.bitwise_xor.reduceat(np.where(place >> 6 == k, bit, np.uint64(0)), bounds[:-1][full])
        out.append(word.view(np.int64))
    return out


def sketch_size(docs: DataFrame) -> int:
    """Counters of the sketch: a power of two that grows with the text, within bounds."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return 1 << min(MOST_SKETCH_BITS, max(SKETCH_BITS, int(chars // COUNTER_CHARS).bit_length()))


def surveyed(docs: DataFrame, words: int, salt: int, counters: int) -> DataFrame:
    """Rows of documents (size and signature of the set) and rows of the tasks' frequency sketches (cid: the task)."""

    def run(batches):
        sketch, task = np.zeros(counters, np.uint32), TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, limit=SET_BYTES):
                found, bounds = shingles(part.column("text"), words)
                sketch += np.bincount(_slot(found, counters), minlength=counters).astype(np.uint32)
                none = pa.nulls(part.num_rows)
                columns = [part.column("doc_id"), np.diff(bounds).astype(np.int32), _sums(found, bounds, np.uint64(salt)), _sums(found, bounds, _SECOND), none.cast(pa.int32()), none.cast(pa.binary()), *_marks(found, bounds)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in SURVEY.split(", ")])
        cuts = [k for k in range(counters // SLICE) if sketch[k * SLICE : (k + 1) * SLICE].any()]
        none = pa.nulls(len(cuts))
        packed = [zlib.compress(sketch[k * SLICE : (k + 1) * SLICE].tobytes(), 1) for k in cuts]
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int32()), pa.array([task] * len(cuts), pa.int64()), none.cast(pa.int64()), pa.array(cuts, pa.int32()), pa.array(packed, pa.binary()), *[none.cast(pa.int64())] * MARK_WORDS],
            [x.split()[0] for x in SURVEY.split(", ")],
        )

    return staged(text_only(docs).mapInArrow(frugal(run), SURVEY), "ngram-survey")


def merged_sketch(survey: DataFrame, counters: int) -> np.ndarray:
    """Sum of all sketches: 4 bytes a counter, whatever the input. A task adds FAN_IN of them, in as many rounds as it takes."""

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, source, packed in zip(*(batch.column(c).to_pylist() for c in ("slice", "source", "counts"))):
                part = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
                held[k, source] = held[k, source] + part if (k, source) in held else part
        for (k, source), total in held.items():
            packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([source], pa.int64()), pa.array([packed], pa.binary())], ["slice", "source", "counts"])

    rows = survey.filter("slice is not null").select("slice", F.col("cid").alias("source"), "counts")
    sources = 1 + (rows.agg(F.max("source")).first()[0] or 0)
    while True:
        rows = rows.withColumn("source", F.floor(F.col("source") / FAN_IN).cast("long"))
        sources = -(-sources // FAN_IN)
        rows = rows.repartition(counters // SLICE * sources, "slice", "source").mapInArrow(frugal(run), "slice int, source long, counts binary")
        if sources == 1:
            break
        rows = staged(rows, "ngram-sketch")
    out = np.zeros(counters, np.uint32)
    for row in rows.collect():
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out


def matches_wanted(estimates: np.ndarray, bounds: np.ndarray, required: np.ndarray) -> np.ndarray:
    """l of each set: estimates are of its shingles in order, ``required`` the overlap that a link needs."""
    n = np.diff(bounds)
    running = np.concatenate([[0.0], np.cumsum(estimates)])
    best, wanted = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for l in range(1, MAX_MATCHES + 1):  # noqa: E741
        ends = bounds[:-1] + np.minimum(n, n - required + l)
        postings = running[ends] - running[bounds[:-1]]
        cost = postings + postings / l * (4 + n / 16)
        better = (cost < best * 0.95) & (l <= required)
        best, wanted = np.where(better, cost, best), np.where(better, l, wanted)
    return wanted


def prefixes(docs: DataFrame, words: int, percent: int, salt: int, sketch: np.ndarray) -> DataFrame:
    """token, cid, n, l, pos and hot of the prefix shingles of every set; a task gives each set once."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        sketch = shared.value
        noise = int(sketch.mean())
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch, limit=SET_BYTES):
                found, bounds = shingles(part.column("text"), words)
                n = np.diff(bounds)
                cid = _sums(found, bounds, np.uint64(salt))
                first = np.zeros(len(n), bool)
                first[np.unique(cid, return_index=True)[1]] = True
                some = np.flatnonzero(first & (n > 0) & ~np.isin(cid, seen))
                seen = np.union1d(seen, cid[some])
                n, cid = n[some], cid[some]
                found = found[spread(bounds[:-1][some], n)]
                bounds = np.concatenate([[0], np.cumsum(n)])
                estimate = np.maximum(sketch[_slot(found, len(sketch))].astype(np.int64) - noise, 1)
                order = np.lexsort((estimate, np.repeat(np.arange(len(n)), n)))  # stable: ties stay in order of the hash
                required = -(-percent * n // 100)
                l = matches_wanted(estimate[order].astype(np.float64), bounds, required)  # noqa: E741
                size = np.minimum(n, n - required + l)
                taken = spread(bounds[:-1], size)
                token, hot = found[order][taken].view(np.int64), estimate[order][taken] >= HOT
                columns = [token, np.repeat(cid, size), *(np.repeat(x, size).astype(np.int32) for x in (n, l)), spread(np.zeros(len(n), np.int64), size).astype(np.int32), hot]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["token", "cid", "n", "l", "pos", "hot"])

    return text_only(docs).mapInArrow(frugal(run), POSTINGS)


POSTINGS = "token long, cid long, n int, l int, pos int, hot boolean"


def postings(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Prefix shingles that some other set of a fitting size has too; groups pass by as a sorted stream.

    Hot shingles are all kept, and dealt out by set, since a group of theirs may hold a third of all sets.
    ``lost`` counts a set's prefix shingles before this one that no set it may still link with has in its prefix. What
    two sets share up to a common prefix shingle lies in both prefixes, so lost shingles are in no partner that has this.
    """

    def run(batches):
        carry, linked = None, False  # the last row waits for its next one
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            token, cid = table.column("token").to_numpy(), table.column("cid").to_numpy()
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])  # sets that several tasks gave
            table, token = table.filter(pa.array(keep)), token[keep]
            n = table.column("n").to_numpy().astype(np.int64)
            pair = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            flag = table.column("hot").to_numpy().copy()
            flag[:-1] |= pair
            flag[1:] |= pair
            flag[0] |= linked
            carry, linked = table.slice(table.num_rows - 1), bool(flag[-1])
            yield from table.slice(0, table.num_rows - 1).filter(pa.array(flag[:-1])).to_batches()
        if linked:
            yield from carry.to_batches()

    ordered = _salted(rows, "cid").repartition(parts, "token", "salt").drop("salt").sortWithinPartitions("token", "n", "cid")
    return staged(with_lost(ordered.mapInArrow(frugal(run), POSTINGS), percent), "ngram-postings")


def with_lost(posts: DataFrame, percent: int) -> DataFrame:
    """Adds what a set has lost before each posting, and leaves out postings that can't lead to a link any more."""
    place = F.row_number().over(Window.partitionBy("cid").orderBy("pos"))
    return posts.withColumn("lost", F.col("pos") + 1 - place).filter(100 * (F.col("n") - F.col("lost")) >= percent * F.col("n"))


def _salted(rows: DataFrame, by: str) -> DataFrame:
    """Rows with the piece of their shingle that they go to, if it is hot."""
    return rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash(by), F.lit(HOT_SALTS))).otherwise(0))


def with_shingle(posts: DataFrame, facts: DataFrame) -> DataFrame:
    """Postings with what ``facts`` say, in one row, of their shingle; those of a hot one are spread, not in one task."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    facts = facts.withColumn("salt", F.explode(salts)).drop("hot")
    return _salted(posts, "cid").join(facts, ["token", "salt"]).drop("salt")


def _pieces(rows: DataFrame, by: str, mine: str, other: str) -> DataFrame:
    """Each row once for every piece of the other side at a hot shingle."""
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_PIECES - 1))).otherwise(F.array(F.lit(0)))
    own = F.when(F.col("hot"), F.pmod(F.hash(by), F.lit(HOT_PIECES))).otherwise(0)
    return rows.withColumn(mine, own).withColumn(other, F.explode(every)).drop("hot")


def still_open(posts: DataFrame, roots: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Postings of shingles that untested pairs of different components share; the others are lost to what is left."""
    posts = posts.drop("root", "lost").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    groups = posts.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("cid").alias("a"), F.max("cid").alias("b"), F.count("*").alias("size")).filter("r <> s")
    done = untested(groups.filter("size = 2"), tested).unionByName(groups.filter("size > 2"))
    return staged(with_lost(posts.join(done.select("token"), "token", "left_semi"), percent), "ngram-open")


def whole_sets(docs: DataFrame, words: int, salt: int, wanted: DataFrame) -> DataFrame:
    """cid and whole set of the classes whose smallest doc_id is in ``wanted`` (and perhaps of a few others).

    Few documents are told by a broadcast filter of fixed size, many by a join on their ids.
    """

    def pack(batches):
        held = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column("bit").to_numpy()
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(held), SLICE):
            if held[k : k + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(held[k : k + SLICE].tobytes(), 1)], pa.binary())], ["at", "bits"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    if wanted.count() > FILTER_BITS // 8:
        table[:] = 255
        ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
        docs = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        wanted = wanted.limit(0)
    for row in wanted.select(bit).repartition(4).mapInArrow(pack, "at int, bits binary").collect():  # of fixed size
        piece = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        table[row["at"] : row["at"] + len(piece)] |= piece
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table, seen = shared.value, np.zeros(0, np.int64)
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array(((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))
            for part in chunks(batch, limit=SET_BYTES):
                found, bounds = shingles(part.column("text"), words)
                n, cid = np.diff(bounds), _sums(found, bounds, np.uint64(salt))
                first = np.zeros(len(n), bool)
                first[np.unique(cid, return_index=True)[1]] = True
                rows = np.flatnonzero(first & (n > 0) & ~np.isin(cid, seen))
                seen = np.union1d(seen, cid[rows])
                ends = np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32)
                values = found[spread(bounds[:-1][rows], n[rows])].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cid[rows]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["cid", "set"])

    return staged(text_only(docs, bit).mapInArrow(frugal(run), "cid long, set array<long>"), "ngram-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets link."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def may_link(n: str, lost_n: str, m: str, lost_m: str, percent: int):
    """Whether sets of sizes n and m, of which so much is lost, can still be similar enough."""
    common = F.least(F.col(n) - F.col(lost_n), F.col(m) - F.col(lost_m))
    return 100 * common >= percent * (F.col(n) + F.col(m) - common)


def marks_fit(n: str, m: str, percent: int):
    """Whether two sets' marks (m0.. and o0..) differ in few enough bits for a link; never refuses one."""
    differing = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(x.replace("m", "o")))) for x in MARKS), F.lit(0))
    return (100 + percent) * differing <= (100 - percent) * (F.col(n) + F.col(m))


def _as_other(marks: DataFrame, name: str) -> DataFrame:
    return marks.select(F.col("cid").alias(name), F.col("n").alias("m"), *(F.col(x).alias(x.replace("m", "o")) for x in MARKS))


def hub_pairs(posts: DataFrame, marks: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Each class with one hub, the one it shares most prefix shingles with.

    The hub of a shingle is the set that has lost least there: the middle of a group of near copies.
    """
    hub = posts.groupBy("token").agg(F.min(F.struct("lost", F.xxhash64("cid").alias("h"), "cid", "n", "root")).alias("hub"), F.first("hot").alias("hot"))
    hub = hub.select("token", "hot", F.col("hub.cid").alias("a"), F.col("hub.n").alias("m"), F.col("hub.lost").alias("lost_m"), F.col("hub.root").alias("hub_root"))
    hub = staged(hub, "ngram-hubs")  # no aggregate in the join's stage, so that a hot shingle's postings can be split
    met = with_shingle(posts, hub).filter((F.col("root") != F.col("hub_root")) & may_link("n", "lost", "m", "lost_m", percent))
    met = untested(met.groupBy("a", F.col("cid").alias("b")).count(), tested)
    met = met.join(_as_other(marks, "a"), "a").join(marks.withColumnRenamed("cid", "b"), "b").filter(marks_fit("n", "m", percent))
    return met.groupBy("b").agg(F.max(F.struct("count", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")


def untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    if tested is None:
        return pairs
    known = tested.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    return pairs.join(known, (F.greatest("a", "b") == F.col("x")) & (F.least("a", "b") == F.col("y")), "left_anti")


def all_pairs(posts: DataFrame, marks: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Candidates of different components: pairs that share as many prefix shingles as the smaller l asks for.

    At each shingle one side leaves out the component that has most sets there, so that sets of one large component
    are not compared with each other.
    """
    most = posts.groupBy("token", "root").agg(F.count("*").alias("count"), F.first("hot").alias("hot")).groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.first("hot").alias("hot"))
    most = staged(most, "ngram-most")  # as for hubs
    posts = with_shingle(posts, most).withColumn("main", F.col("root") == F.col("most")).drop("most").join(marks.drop("n"), "cid")
    left = posts.filter("not main")
    left = left.select("token", "hot", F.col("cid").alias("x"), F.col("n").alias("m"), F.col("lost").alias("lost_m"), F.col("l").alias("k"), F.col("root").alias("r"), *(F.col(c).alias(c.replace("m", "o")) for c in MARKS))
    apart = (F.col("main") | (F.col("x") < F.col("cid"))) & (F.col("r") != F.col("root")) & may_link("n", "lost", "m", "lost_m", percent) & marks_fit("n", "m", percent)
    met = _pieces(left, "x", "i", "j").join(_pieces(posts, "cid", "j", "i"), ["token", "i", "j"]).filter(apart)
    met = met.groupBy(F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("k", "l")).alias("asked"))
    return untested(met.filter("shared >= asked").select("a", "b"), tested)


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """cid and root (the smallest cid of the component) of every node of the edges (a, b)."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = staged(small.select("e.a", "e.b").filter("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # settled: each node points at its root; roots point nowhere
    return edges.select(F.col("a").alias("cid"), F.col("b").alias("root"))


def linked_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cid) of every row, and (cid, root) of the classes that link with others."""
    counters = sketch_size(docs)
    for salt in range(1, 20):
        survey = surveyed(docs, words, salt, counters)
        rows = survey.filter("slice is null").select("doc_id", "n", "cid", "other")
        marked = survey.filter("slice is null and n > 0").groupBy("cid").agg(F.min("n").alias("n"), *(F.min(m).alias(m) for m in MARKS))
        classes = rows.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("other").alias("o"), F.max("other").alias("o2"))
        if not classes.filter("n <> n2 or o <> o2").take(1):  # else two sets share a signature: take other ones
            break
    else:
        raise RuntimeError("sets share signatures under every salt")
    sketch = merged_sketch(survey, counters)
    classes = classes.select("cid", "doc_id")
    size = survey.agg(F.sum("n")).first()[0] or 0
    parts = int(8 + size * (100 - percent) // 100 // 400_000)
    posts = postings(prefixes(docs, words, percent, salt, sketch), percent, parts).withColumn("root", F.col("cid"))
    marks = marked.join(posts.select("cid").distinct(), "cid", "left_semi")
    edges, tested, roots = None, None, docs.sparkSession.createDataFrame([], "cid long, root long")
    for step in range(HUB_ROUNDS + 1):
        pairs = staged(all_pairs(posts, marks, tested, percent) if step == HUB_ROUNDS else hub_pairs(posts, marks, tested, percent), "ngram-pairs")
        if not pairs.take(1):
            if step < HUB_ROUNDS:
                continue
            break
        both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
        sets = whole_sets(docs, words, salt, classes.join(both, F.col("cid") == F.col("a"), "left_semi").select("doc_id"))
        links = staged(verified(pairs, sets, percent), "ngram-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = links if edges is None else edges.unionByName(links)
        roots = stars(edges)
        if step < HUB_ROUNDS:
            posts = still_open(posts, roots, tested, percent)
    return rows.select("doc_id", "n", "cid"), roots


def components_of(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and class_id of every row."""
    rows, roots = linked_classes(docs, words, percent)
    ids = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc"))
    members = roots.unionByName(roots.select(F.col("root").alias("cid"), "root").distinct())  # roots point nowhere
    linked = staged(ids.join(members, "cid"), "ngram-linked")
    # a component may hold a third of all classes: they learn its smallest id in salted pieces
    least = linked.groupBy("root").agg(F.min("doc").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))))
    salted = linked.withColumn("salt", F.pmod(F.hash("cid"), F.lit(ROOT_SALTS)))
    found = salted.join(least.hint("merge"), ["root", "salt"]).select("cid", "least")
    ids = ids.join(found.withColumn("_linked", F.lit(True)), "cid", "left").select("cid", F.when(F.col("_linked"), F.col("least")).otherwise(F.col("doc")).alias("least"))
    ids = staged(ids, "ngram-ids")  # so that the rows of a large class can be split in the join
    out = rows.join(ids, "cid", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.when(~alone, F.col("cid")).alias("class_id")
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, with all columns.

    Rows without doc_id, and rows that repeat a kept id, stay.
    """
    gone = components_of(docs, words, percent).filter("doc_id <> component_id").select("doc_id")
    gone = staged(gone, "ngram-gone")
    return docs.join(gone, "doc_id", "left_anti")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(documents(spark, sf_dir)).drop("class_id")


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), p AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (SELECT a AS doc_id, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.doc_id = s.doc_id), doc_id)) AS component_id FROM s
"""
