"""Bulk-synchronous best-fit packing of tokenised documents into fixed-length sequences.

1. Tokenise: a worker encodes a word once and keeps the ids of words it has met, within a bound; a document is its ids
   and an end id. Only documents longer than a sequence are cut, into full pieces and a rest.
2. Range-sort: pieces fall into size classes (their length), gaps into size classes (their room). A piece's rank in
   its class comes from counts by (class, salt) and a row number inside each salt, so a class that holds a third of
   all pieces is still spread over many tasks. Ranks deal every class out evenly to cells of bounded size.
3. Sweep, in rounds of one task a cell, all cells at once: from the largest class down, the pieces of a class go to
   the smallest gaps that hold them (their successors), conflicts are resolved by rank (piece r takes the r-th place),
   gaps are updated, and what finds no gap opens new sequences, but no more than the cell's pieces are sure to need:
   the rest waits. Between rounds, the gaps and waiting pieces of sixteen cells are joined in one; the last round opens
   what is needed. Cells hold runs of equal rooms and lengths, never rows. What a cell leaves over grows with the cells
   that were joined in it, so there are two such rounds at most, after which a cell stands for 256: a task reads what
   sixteen cells left, whatever the input. Each last cell opens at most one sequence more than one for all would: one in
   some ten million pieces.
4. Place: pieces meet the segments of their cell by rank, cell by cell.

With one cell this is the packing of sequential best-fit decreasing exactly; with several, pieces that wait see the
gaps that all cells have left.

Null text counts as empty: one piece, the end id. Equal rows are packed each. An empty table gives an empty
result. Extra columns are ignored. Null doc_id is kept as null. Very long texts are cut, never truncated.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, frugal, shipped, split_words, spread, staged, text_only

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Pieces of one size class that one task ranks, about.
RANK_ROWS = 500_000
#: Pieces of a cell, about, and cells that become one in the next round.
CELL_PIECES = 50_000
JOINED_CELLS = 16
#: Rounds in which cells are joined, at most.
ROUNDS = 2
#: Bytes of text whose words are looked up at a time.
BATCH_BYTES = 8_000_000
#: Words that a worker keeps the ids of, words that are encoded as one text, and ids that are laid out at a time.
KEPT_WORDS = 1 << 20
JOINED_WORDS = 2_000
GROUP_IDS = 500_000
#: Stands between words that are encoded as one text; a word that has it is encoded alone.
_MARK = "\x01"


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, and each text's bounds in them."""
    parts = [part for _, part in grouped_ids(texts, path, end_id)]
    sizes = np.concatenate([np.diff(bounds) for _, bounds in parts]) if parts else np.zeros(0, np.int64)
    return np.concatenate([ids for ids, _ in parts]) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def grouped_ids(texts: pa.Array, path: str, end_id: int = END_ID):
    """(first text, (ids, bounds)) of runs of texts of about GROUP_IDS ids.

    No match of this vocabulary's pattern holds white space, so words between ASCII white space are independent.
    """
    flat, bounds = split_words(texts, lower=False)
    coded = flat.dictionary_encode()
    del flat
    pool, lengths = _distinct_ids(coded.dictionary, path)
    pool, lengths = np.append(pool, np.uint32(end_id)), np.append(lengths, 1)
    starts = np.cumsum(lengths) - lengths
    index = np.insert(coded.indices.to_numpy(), bounds[1:], len(lengths) - 1)
    bounds = bounds + np.arange(len(bounds))
    ends = np.concatenate([[0], np.cumsum(lengths[index])])[bounds]
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP_IDS, side="right")) - 1)
        some = index[bounds[at] : bounds[stop]]
        yield at, (pool[spread(starts[some], lengths[some])], ends[at : stop + 1] - ends[at])
        at = stop


def _distinct_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other, and how many each has.

    The vocabulary lowers letters and splits between a letter and a full stop or comma, so ``Word,`` and ``word`` share
    one encoding. Only ASCII words are lowered here: elsewhere composition comes before lowering.
    """
    plain = pc.match_substring_regex(words, r"^[\x00-\x7f]*$")
    words = pc.if_else(plain, pc.ascii_lower(words), words)
    stop = pc.match_substring_regex(words, r"\pL\.$").to_numpy(zero_copy_only=False).astype(bool)
    comma = pc.match_substring_regex(words, r"\pL,$").to_numpy(zero_copy_only=False).astype(bool)
    marked = stop | comma
    core = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
    flat, of_core = _known(path).ids(core.dictionary.to_pylist())
    index = core.indices.to_numpy().astype(np.int64)
    taken = of_core[index]
    pool = flat[spread((np.cumsum(of_core) - of_core)[index], taken)]
    marks = [tokenizer(path).encode(m, add_special_tokens=False).ids[0] for m in ".,"]
    pool = np.insert(pool, np.cumsum(taken)[marked], np.where(stop, *marks)[marked])
    return pool, taken + marked


def encoded(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other, and how many each has; many words are encoded as one text."""
    bpe = tokenizer(path)
    (mark,) = bpe.encode(_MARK, add_special_tokens=False).ids
    counts, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for k in range(0, len(words), 16 * JOINED_WORDS):
        groups = [words[a : a + JOINED_WORDS] for a in range(k, min(len(words), k + 16 * JOINED_WORDS), JOINED_WORDS)]
        texts = ["".join([f"{w} {_MARK} " for w in group]) for group in groups]
        for group, found in zip(groups, bpe.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(ids == mark)
            if len(ends) == len(group):
                counts.append(np.diff(ends, prepend=-1) - 1)
                parts.append(np.delete(ids, ends))
            else:  # some word has the mark
                alone = [e.ids for e in bpe.encode_batch_fast(group, add_special_tokens=False)]
                counts.append(np.fromiter(map(len, alone), np.int64, len(alone)))
                parts.append(np.fromiter(chain.from_iterable(alone), np.uint32, int(counts[-1].sum())))
    return np.concatenate(parts), np.concatenate(counts)


@lru_cache(2)
def _known(path: str) -> KnownWords:
    return KnownWords(path)


class KnownWords:
    """Ids of words that a worker has met, by 128-bit hash, sorted; beyond the bound the least met half is forgotten."""

    def __init__(self, path: str):
        self.path = path
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), ">u8").reshape(-1, 2).astype(np.uint64)
        low, high = both[:, 0], both[:, 1]
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.searchsorted(self.low, low)
        hit = np.flatnonzero(at < len(self.low))
        hit = hit[(self.low[at[hit]] == low[hit]) & (self.high[at[hit]] == high[hit])]
        self.met[at[hit]] += 1
        start[hit], size[hit] = self.start[at[hit]], self.size[at[hit]]
        new = np.ones(len(words), bool)
        new[hit] = False
        new = np.flatnonzero(new)
        flat, counts = encoded([words[k] for k in new], self.path)
        start[new], size[new] = len(self.pool) + np.cumsum(counts) - counts, counts
        self.pool = np.concatenate([self.pool, flat])
        out = self.pool[spread(start, size)]
        new = new[np.argsort(low[new])]
        at = np.searchsorted(self.low, low[new])
        self.low, self.high = np.insert(self.low, at, low[new]), np.insert(self.high, at, high[new])
        self.start, self.size = np.insert(self.start, at, start[new]), np.insert(self.size, at, size[new])
        self.met = np.insert(self.met, at, 1)
        if len(self.low) > KEPT_WORDS:
            self._forget()
        return out, size

    def _forget(self) -> None:
        stays = np.sort(np.argsort(-self.met, kind="stable")[: KEPT_WORDS // 2])
        self.pool = self.pool[spread(self.start[stays], self.size[stays].astype(np.int64))]
        self.low, self.high, self.size, self.met = self.low[stays], self.high[stays], self.size[stays], self.met[stays] // 2
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size


def pieces(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    shipped(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=BATCH_BYTES):
                for first, (ids, bounds) in grouped_ids(part.column("text"), path, end_id):
                    yield cut(part.column("doc_id").slice(first, len(bounds) - 1), ids, bounds)

    def cut(doc_ids, ids, bounds):
        view = memoryview(ids.astype("<u4").tobytes())
        sizes = np.diff(bounds)
        counts = -(-sizes // capacity)
        piece = spread(np.zeros(len(counts), np.int64), counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        start = piece * capacity
        length = np.minimum(capacity, sizes[owner] - start)
        at = bounds[:-1][owner] + start
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
        columns = [doc_ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_only(docs).mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(classes: dict[int, list[tuple]], capacity: int, gaps=(), limit: int | None = None, base: int = 0):
    """Segments, gaps left, and pieces held back.

    classes: length -> runs (cell, first rank, pieces); gaps: runs (room, first sequence, sequences). At most ``limit``
    sequences are opened, numbered from ``base``; what would need more is held back. A segment (cell, length, rank,
    pieces, sequence, side, offset, skip) puts its i-th piece in sequence ``sequence + (skip + i) // side``, at
    ``offset + (skip + i) % side * length``.
    """
    open_gaps: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    rooms: list[int] = []
    out, held, opened = [], [], 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_gaps:
                open_gaps[room] = []
                bisect.insort(rooms, room)
            open_gaps[room].append((first, n))

    for gap in gaps:
        free(*gap)
    for length in sorted(classes, reverse=True):
        runs = list(classes[length])[::-1]
        left = sum(n for _, _, n in runs)

        def put(n: int, sequence: int, side: int, offset: int) -> None:
            skip = 0
            while skip < n:
                cell, rank, most = runs.pop()
                taken = min(most, n - skip)
                out.append((cell, length, rank, taken, sequence, side, offset, skip))  # noqa: B023
                skip += taken
                if taken < most:
                    runs.append((cell, rank + taken, most - taken))  # noqa: B023

        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_gaps[room].pop()
                if not open_gaps[room]:
                    del open_gaps[room], rooms[k]
            else:
                n = -(-left // (capacity // length))
                n = n if limit is None else min(n, limit - opened)
                if not n:
                    held += [(length, *run) for run in runs[::-1]]
                    break
                room, first, opened = capacity, base + opened, opened + n
            side = room // length
            whole = min(n, left // side)
            offset = capacity - room
            if whole:
                put(whole * side, first, side, offset)
                free(room - side * length, first, whole)
                left -= whole * side
            if left and whole < n:  # fewer than fill one sequence
                put(left, first + whole, side, offset)
                free(room - left * length, first + whole, 1)
                left, whole = 0, whole + 1
            free(room, first + whole, n - whole)
    return out, [(room, *run) for room in rooms for run in open_gaps[room]], held


#: kind 0, segments: cell is that of their pieces. 1, gaps: size is the room, rank unused. 2, pieces held back: origin is their cell.
ROUND = "kind int, cell long, origin long, size long, rank long, n long, sequence long, side long, offset long, skip long"


def _swept(cell: int, step: int, classes: dict, gaps: list, capacity: int, last: bool) -> pa.RecordBatch:
    need = sum(length * n for length, runs in classes.items() for _, _, n in runs) - sum(room * n for room, _, n in gaps)
    segments, gaps, held = sweep(classes, capacity, gaps, None if last else max(0, need // capacity), (step << 58) + (cell << 34))
    rows = [(0, c, c, length, *rest) for c, length, *rest in segments]
    rows += [(1, cell, cell, room, 0, n, first, 0, 0, 0) for room, first, n in gaps]
    rows += [(2, cell, origin, length, rank, n, 0, 0, 0, 0) for length, origin, rank, n in held]
    table = np.array(rows, np.int64).reshape(-1, 10).T
    names = [x.split()[0] for x in ROUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(table[0].astype(np.int32)), *map(pa.array, table[1:])], names)


def swept(spark: SparkSession, counts: dict[int, int], cells: int, capacity: int) -> DataFrame:
    """Segments of all rounds. Round 0 deals a class's pieces out by rank: piece r goes to cell r % cells."""
    shared = spark.sparkContext.broadcast(counts)  # a number a class: its size depends on the capacity, not on the rows
    last = cells == 1

    def begin(batches):
        for batch in batches:
            for cell in batch.column("id").to_pylist():
                mine = {length: (n - cell + cells - 1) // cells for length, n in shared.value.items()}
                yield _swept(cell, 0, {length: [(cell, 0, n)] for length, n in mine.items() if n}, [], capacity, last)

    rounds = [staged(spark.range(0, cells, 1, cells).mapInArrow(frugal(begin), ROUND), "sweep")]
    step, now = 0, cells
    while now > 1 and step < ROUNDS:
        step, now = step + 1, -(-now // JOINED_CELLS)
        left = rounds[-1].filter("kind > 0").withColumn("cell", F.floor(F.col("cell") / JOINED_CELLS))
        left = left.repartitionById(now, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "size", "origin", "rank", "sequence")
        rounds.append(staged(left.mapInArrow(frugal(_again(step, now == 1 or step == ROUNDS, capacity)), ROUND), "sweep"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.filter("kind = 0").drop("kind", "origin")


def _again(step: int, last: bool, capacity: int):
    """A later round: gaps and held-back pieces of joined cells."""

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        for cell, mine in groupby(rows, lambda r: r["cell"]):
            classes, gaps = defaultdict(list), []
            for r in mine:
                if r["kind"] == 1:
                    gaps.append((r["size"], r["sequence"], r["n"]))
                else:
                    classes[r["size"]].append((r["origin"], r["rank"], r["n"]))
            yield _swept(cell, step, classes, gaps, capacity, last)

    return run


def ranked(table: DataFrame, rows: int) -> DataFrame:
    """``rank`` of each piece in its size class, from 0, without gathering a class in one task."""
    salts = 32 * max(1, rows // RANK_ROWS)
    salted = table.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))  # of a written table: the same in each run
    before = salted.groupBy("length", "salt").count()
    before = before.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("within") - 1 + F.col("before")).drop("salt", "within", "before")


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _placed(mine: pa.Table, segments: pa.Table) -> pa.Table:
    """Pieces of one cell with their sequences and offsets."""
    if not mine.num_rows:
        return pa.table({c: mine.column(c) for c in PIECE} | {"sequence_id": pa.array([], pa.int64()), "offset": pa.array([], pa.int64())})
    size, first, sequence, side, offset, skip = (segments.column(c).to_numpy() for c in ("size", "rank", "sequence", "side", "offset", "skip"))
    keys = (size << np.int64(40)) + first
    order = np.argsort(keys)
    length, rank = mine.column("length").to_numpy(), mine.column("rank").to_numpy()
    at = order[np.searchsorted(keys[order], (length << np.int64(40)) + rank, side="right") - 1]
    i = skip[at] + rank - first[at]
    return pa.table({c: mine.column(c) for c in PIECE} | {"sequence_id": pa.array(sequence[at] + i // side[at]), "offset": pa.array(offset[at] + i % side[at] * length)})


def pack(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its place there."""
    table = staged(pieces(docs, capacity, path, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = sum(counts.values())
    cells = max(1, -(-rows // CELL_PIECES))
    segments = swept(docs.sparkSession, counts, cells, capacity)
    dealt = ranked(table, rows).select(*PIECE, F.pmod("rank", F.lit(cells)).cast("long").alias("cell"), F.floor(F.col("rank") / cells).cast("long").alias("rank"))
    return dealt.groupBy("cell").cogroup(segments.groupBy("cell")).applyInArrow(
        _placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
