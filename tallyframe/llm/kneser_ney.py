"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words. A first pass counts words by 64-bit hash and numbers them, the frequent ones first (ids from 1; 0 is the start
mark). Files of sorted word hashes with ids and counts lie in the shared folder, where all later tasks map them.

Counting. Tasks add up n-grams of ids in memory; what they flush is cut by shard and shuffled as sorted, packed arrays.
An n-gram's shard follows its second-last word, so all that lower orders need is in that shard too: its contexts end
with that word, and so do its endings' contexts. One task therefore merges a shard and derives every order down to two
words from it. A word that fills a shard alone is hot (the start mark always is): its n-grams are spread by the whole
n-gram, and what contexts and lower orders need of them is added up by one more shuffle an order. Single words'
predecessors are added up last, by id. Where there are very many shards, n-grams reach them through several shuffles
of at most ``FAN`` cuts each, and are added up on the way.

Counts. The highest order counts n-grams; lower ones count distinct predecessors (continuation counts), but n-grams
that begin with the start mark, which nothing precedes, are counted themselves. The first words of a text have the
start mark and the words before them as their context, however short.

Arrays. A shard keeps its n-grams' hashes in order, cut into buckets by their first bits: a directory holds the buckets'
starts, the array the 32 bits that follow (all 64 where two of a shard's n-grams agree so far). What was seen is always
found; an n-gram that was not seen is taken for another one with a chance of some 4 in 10**9.

Scoring. Workers memory-map the arrays (the shared folder must be mounted) and look up sorted queries by binary
search; no worker holds the model. At each order p(w|u) = max(c - D(c), 0) / c(u) + g(u) p'(w), with p' of the context
without its first word; the words' own distribution is interpolated with the uniform one over the vocabulary and one
unknown word. Discounts come from counts of counts of their order. Probabilities over all words and the unknown one
sum to one.

Documents whose crc32(doc_id as text) mod 10 is 0 are held out; a null doc_id counts as the empty text, so it is
held out. Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end. Null text counts as empty: the end
alone. Repeated rows are trained on and scored each. An empty table gives an empty result; without training rows the
model is uniform. Extra columns are ignored. Texts of any length are scored whole.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, distinct_hashes, documents, fresh_path, frugal, mix, mounted, shipped, split_words, spread, staged

#: Words of context and one, in op2_kneser_ney.
ORDER = 3
#: N-grams (or words) that a task adds up before it flushes.
BUFFER = 2_000_000
#: Training tokens of a shard, about; a word with more is hot.
SHARD_TOKENS = 3_000_000
#: Characters of training text for each file of words.
WORD_FILE_CHARS = 100_000_000
#: Shards that n-grams are dealt to in one shuffle, at most.
FAN = 2_048
#: Bytes of text that become n-grams at a time.
TEXT_BYTES = 6_000_000
#: Files that a worker keeps mapped.
MAPPED = 4_096
#: Hashes of the marks; no word has white space, so they are no word's.
START, END = (np.uint64(0x5B6A1D0F93C2E417), np.uint64(0xC4D2E9A3570B861D))
_SEED, _SPREAD = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
#: Classes of counts by which words are numbered: four for each doubling.
CLASSES = 4 * 64


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and the end, each token's place among them, and each text's bounds."""
    flat, bounds = split_words(texts)
    coded = flat.dictionary_encode()
    hashes = np.append(distinct_hashes(coded.dictionary), END)
    local = np.insert(coded.indices.to_numpy(), bounds[1:], len(hashes) - 1)
    return hashes, local, bounds + np.arange(len(bounds))


def before(ids: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The order - 1 ids before each token, the nearest last; 0 before a text."""
    out = []
    for back in range(order - 1, 0, -1):
        column = np.zeros_like(ids)
        column[back:] = ids[:-back]
        for j in range(back):
            at = bounds[:-1] + j
            column[at[at < bounds[1:]]] = 0
        out.append(column)
    return out


def gram(columns) -> np.ndarray:
    """One hash of the words of each n-gram."""
    key = mix(_SEED, columns[0].astype(np.uint64))
    for c in columns[1:]:
        key = mix(key, c.astype(np.uint64))
    return key


def _slot(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _summed(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and the sums of their values."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], order[at], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


# --- rows that are shuffled ---------------------------------------------------------------------------------------

ROWS = "shard int, kind int, data binary"
#: Rows of counts of counts; of words' predecessors; 2 k: of n-grams of k words; 2 k + 1: of contexts of order k.
OFTEN, WORDS = 0, 2


def _planes(column: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a number, as many as the largest needs, and those of all numbers plane by plane."""
    width = max(1, (int(column.max()).bit_length() + 7) // 8) if len(column) else 1
    return width, np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _apart(column: np.ndarray, resets: np.ndarray | None) -> np.ndarray:
    """Differences to the number before, modulo 2**64; numbers themselves where ``resets``."""
    column = column.astype(np.uint64)
    out = column.copy()
    out[1:] -= column[:-1]
    return out if resets is None else np.where(resets, column, out)


def _lead(width: int, contexts: bool) -> tuple[int, int | None]:
    """The column that n-grams are dealt by, and one beside it."""
    p = width - 1 if contexts else max(0, width - 2)
    return p, p - 1 if p else p + 1 if width > 1 else None


def _encoded(columns: np.ndarray, values: list[np.ndarray], contexts: bool) -> bytes:
    """Packed columns: the first sort column as differences, the second one too inside equal first ones."""
    p, s = _lead(len(columns), contexts)
    new = np.ones(columns.shape[1], bool)
    new[1:] = columns[p][1:] != columns[p][:-1]
    wide = [_apart(c, None if j == p else new) if j in (p, s) else c for j, c in enumerate(columns)]
    # a difference below zero takes eight bytes; columns in disorder (ids beyond the sort key's bits) stay as they are
    plain = [int(j in (p, s) and bool((w >> np.uint64(63)).any())) for j, w in enumerate(wide)]
    parts = [_planes(c if f else w) for c, w, f in zip(columns, wide, plain)] + [_planes(v) for v in values]
    head = np.array([columns.shape[1], len(columns), len(values), *plain, *(w for w, _ in parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *(x for _, x in parts)]))


def _decoded(data: bytes, contexts: bool, kind=np.uint64) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, width, many = np.frombuffer(raw, "<i8", 3)
    plain = np.frombuffer(raw, "<i8", width, 24)
    sizes = np.frombuffer(raw, "<i8", width + many, 24 + 8 * width)
    at, found = 24 + 8 * int(2 * width + many), []
    for size in sizes.tolist():
        out = np.zeros((n, 8), np.uint8)
        out[:, :size] = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T
        found.append(out.view("<u8")[:, 0])
        at += size * n
    p, s = _lead(width, contexts)
    columns = found[:width]
    if not plain[p]:
        columns[p] = np.cumsum(columns[p], dtype=np.uint64)
    if s is not None and not plain[s]:
        first = np.flatnonzero(np.concatenate([[True], columns[p][1:] != columns[p][:-1]]))
        running = np.cumsum(columns[s], dtype=np.uint64)
        base = running[first] - columns[s][first]
        columns[s] = running - np.repeat(base, np.diff(np.append(first, n)))
    return np.stack([c.astype(kind) for c in columns]), [v.astype(np.int64) for v in found[width:]]


def _dealt(kind: int, columns: np.ndarray, values: list[np.ndarray], shard: np.ndarray, shards: int) -> list[tuple]:
    """A row a shard. Rows are sorted by shard and leading words; equal neighbours become one."""
    if not columns.shape[1]:
        return []
    contexts = kind % 2 == 1
    p, s = _lead(len(columns), contexts)
    head = max(1, (shards - 1).bit_length())
    part = (64 - head) * 2 // 5
    limit = np.uint64((1 << part) - 1)
    sort = shard.astype(np.uint64) << np.uint64(64 - head)
    sort |= np.minimum(columns[p].astype(np.uint64), limit) << np.uint64(64 - head - part)
    if s is not None:
        sort |= np.minimum(columns[s].astype(np.uint64), limit) << np.uint64(64 - head - 2 * part)
    if len(columns) > 2:
        rest = columns[-1] if p != len(columns) - 1 else columns[0]
        sort |= rest.astype(np.uint64) & np.uint64((1 << (64 - head - 2 * part)) - 1)
    order = np.argsort(sort)
    columns, shard = columns[:, order], shard[order]
    new = np.ones(len(order), bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0) | (shard[1:] != shard[:-1])
    at = np.flatnonzero(new)
    values = [np.add.reduceat(v[order], at) for v in values]
    columns, shard = columns[:, at], shard[at]
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    return [(int(shard[a]), kind, _encoded(columns[:, a:b], [v[a:b] for v in values], contexts)) for a, b in zip(cuts, cuts[1:])]


def _batch(rows: list[tuple], schema: str = ROWS) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _by_shard(batches):
    """Rows of one shard after the other; a shard's rows come together."""
    shard, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != shard:
                yield shard, held
                held = []
            shard = row[0]
            held.append(row)
    if held:
        yield shard, held


def _of_kind(rows: list[tuple], kind: int, dtype) -> tuple[np.ndarray, list[np.ndarray]] | None:
    parts = [_decoded(data, kind % 2 == 1, dtype) for _, k, data in rows if k == kind]
    if not parts:
        return None
    return np.concatenate([c for c, _ in parts], axis=1), [np.concatenate(v) for v in zip(*(v for _, v in parts))]


# --- files --------------------------------------------------------------------------------------------------------


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file that appears whole: a lost or repeated task leaves none or the same."""
    at, listed = 0, []
    for key, a in arrays.items():
        listed.append((key, a.dtype.str, a.shape, at))
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(listed).encode()
    head += b" " * (-len(head) % 8)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.array([len(head)], "<i8").tobytes() + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(part, f"{folder}/{name}.arrays")


def _mapped(path: str) -> dict[str, np.ndarray] | None:
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int(np.frombuffer(view, "<i8", 1)[0])
    return {key: np.frombuffer(view, kind, int(np.prod(shape)), 8 + size + at).reshape(shape) for key, kind, shape, at in json.loads(view[8 : 8 + size])}


def _least(values: np.ndarray) -> np.ndarray:
    """In the smallest kind of unsigned number that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))


def _save_table(folder: str, name: str, key: np.ndarray, values: list[np.ndarray]) -> None:
    """Sorted hashes in buckets, and for each the row of its values among the distinct ones."""
    bits = max(0, (len(key) // 8).bit_length() - 1)
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    low = key << np.uint64(bits)
    short = (low >> np.uint64(32)).astype(np.uint32)
    if not ((short[1:] == short[:-1]) & (bucket[1:] == bucket[:-1])).any():
        low = short
    usual = np.flatnonzero(values[0] <= 1)[:1]  # most were seen once: row 0
    rare = np.flatnonzero(np.any([v != v[usual] for v in values], axis=0)) if len(usual) else np.arange(len(key))
    _, at, code = np.unique(gram([v[rare].astype(np.uint64) for v in values]), return_index=True, return_inverse=True)
    codes = np.zeros(len(key), np.int64)
    codes[rare] = code + 1
    rows = np.concatenate([usual if len(usual) else np.zeros(min(1, len(key)), np.int64), rare[at]])
    table = np.stack([v[rows] for v in values], axis=1) if len(key) else np.zeros((0, len(values)), np.int64)
    _save(folder, name, {"starts": _least(np.searchsorted(bucket, np.arange((1 << bits) + 1))), "low": low, "codes": _least(codes), "values": _least(table)})


def _places(table: dict[str, np.ndarray], key: np.ndarray) -> np.ndarray:
    """Place of each hash in a table, or -1: binary search inside its bucket."""
    starts, held = table["starts"], table["low"]
    if not len(held):
        return np.full(len(key), -1, np.int64)
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    low = key << np.uint64(bits)
    if held.dtype == np.uint32:
        low = (low >> np.uint64(32)).astype(np.uint32)
    a, b = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    end = b
    for _ in range(int((b - a).max()).bit_length() if len(key) else 0):
        middle = (a + b) >> 1
        less = (a < b) & (held[np.minimum(middle, len(held) - 1)] < low)
        a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
    hit = a < end
    hit[hit] = held[a[hit]] == low[hit]
    return np.where(hit, a, -1)


# --- the model ----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    folder: str
    order: int
    tokens: int
    words: int
    word_files: int
    cold: int  # shards by second-last word
    hot: int  # shards by whole n-gram
    last_hot: int  # ids up to this one are hot words
    discounts: list[np.ndarray] = field(default_factory=list)  # of each order from 1: once, twice, more
    predecessors: int = 0
    spare: float = 1.0  # of the words' distribution, for the uniform one
    _maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def _map(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self._maps:
            if len(self._maps) >= MAPPED:
                self._maps.clear()
            self._maps[name] = _mapped(f"{self.folder}/{name}.arrays")
        return self._maps[name]

    def kind(self):
        return np.uint32 if self.words + 2 < 2**32 else np.uint64

    def word(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (words + 1 where unknown) and counts of words."""
        ids, counts = np.full(len(hashes), self.words + 1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        file = _slot(hashes[order], self.word_files)
        cuts = np.append(np.flatnonzero(np.diff(file, prepend=-1)), len(file))
        for a, b in zip(cuts, cuts[1:]):
            held = self._map(f"words-{file[a]}") if b > a else None
            if held is not None:
                mine = order[a:b]
                at = np.minimum(np.searchsorted(held["keys"], hashes[mine]), len(held["keys"]) - 1)
                hit = held["keys"][at] == hashes[mine]
                ids[mine[hit]], counts[mine[hit]] = self._map(f"ids-{file[a]}")["ids"][at[hit]], held["counts"][at[hit]]
        return ids.astype(self.kind()), counts

    def shard(self, columns, key: np.ndarray, contexts: bool) -> np.ndarray:
        """Shards of n-grams, or of contexts."""
        lead = columns[_lead(len(columns), contexts)[0]]
        cold = _slot(mix(_SPREAD, lead.astype(np.uint64)), self.cold)
        return np.where(lead <= self.last_hot, self.cold + _slot(key, self.hot), cold)

    def _find(self, columns, kind: str, order: int, fields: list[int]) -> list[np.ndarray]:
        """Values of n-grams or contexts (0 where absent); queries go through each shard in order."""
        key = gram(columns)
        shard = self.shard(columns, key, kind == "contexts")
        head = np.uint64(max(1, (self.cold + self.hot - 1).bit_length()))
        sort = (shard.astype(np.uint64) << (np.uint64(64) - head)) | (key >> head)
        by = np.argsort(sort)
        key, shard = key[by], shard[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        key, shard = key[at], shard[at]
        cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        found = [np.zeros(len(key), np.int64) for _ in fields]
        for a, b in zip(cuts, cuts[1:]):
            table = self._map(f"{kind}-{order}-{shard[a]}")
            if table is not None:
                place = _places(table, key[a:b])
                hit = np.flatnonzero(place >= 0)
                values = table["values"][table["codes"][place[hit]]]
                for column, f in zip(found, fields):
                    column[a + hit] = values[:, f]
        out = []
        for column in found:
            whole = np.empty(len(by), np.int64)
            whole[by] = column[which]
            out.append(whole)
        return out

    def _of_words(self, ids: np.ndarray) -> np.ndarray:
        """p of each word without context."""
        seen = np.zeros(len(ids), np.int64)
        part = ids.astype(np.int64) % self.word_files
        for k in np.unique(part):
            held = self._map(f"predecessors-{k}")
            if held is not None:
                mine = np.flatnonzero(part == k)
                at = ids[mine].astype(np.int64) // self.word_files
                mine, at = mine[at < len(held["n"])], at[at < len(held["n"])]
                seen[mine] = held["n"][at]
        return (seen - _discount(seen, self.discounts[0])) / max(self.predecessors, 1) + self.spare / (self.words + 1)

    def log10(self, context: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of each token after those before it (hashes, a row a place, or one row), and the token's count."""
        rows = [*np.atleast_2d(context), tokens]
        hashes, local = np.unique(np.concatenate(rows), return_inverse=True)
        ids, counts = self.word(hashes)
        ids[hashes == START] = 0
        columns = list(ids[local].reshape(len(rows), -1))
        return self.log10_of_ids(columns, self._of_words(columns[-1])), counts[local].reshape(len(rows), -1)[-1]

    def log10_of_ids(self, columns: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """log10 p of the last column after the others; ``p`` is without context."""
        seen = columns[-1] <= self.words
        for n in range(2, self.order + 1):
            total, *after = self._find(columns[-n:-1], "contexts", n, [0, 1, 2, 3])
            known = np.flatnonzero(total)
            left = np.ones(len(p))
            left[known] = sum(d * x[known] for d, x in zip(self.discounts[n - 1], after)) / total[known]
            # without its first word an n-gram that was seen was seen as well; begins of texts are only in lower orders
            at = known[seen[known]]
            count = np.zeros(len(p), np.int64)
            count[at] = self._find([c[at] for c in columns[-n:]], "grams", n, [0])[0]
            p = (count - _discount(count, self.discounts[n - 1])) / np.maximum(total, 1) + left * p
            seen = count > 0
        return np.log10(p)


def _discount(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], discounts])[np.minimum(counts, 3)]


def discounts_of(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of things counted once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, 0.05, [0.95, 1.95, 2.95])


def _class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.int64), CLASSES - 1)


def vocabulary(texts: DataFrame, folder: str, files: int) -> tuple[int, int, int, int]:
    """Writes the files of words; returns tokens, distinct words, the last hot id, and how many tokens are hot."""
    spark = texts.sparkSession

    def count(batches):
        def flush(held):
            key, _, (n,) = _summed(np.concatenate([k for k, _ in held]), [np.concatenate([n for _, n in held])])
            cuts = np.searchsorted(_slot(key, files), np.arange(files + 1))
            return _batch([(k, WORDS, np.concatenate([key[a:b], n[a:b].view(np.uint64)]).tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, limit=TEXT_BYTES):
                hashes, local, _ = tokenised(part.column("text"))
                n = np.bincount(local, minlength=len(hashes))
                held.append((hashes[n > 0], n[n > 0]))
                size += len(held[-1][0])
                if size >= BUFFER // 2:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def merge(batches):
        for k, rows in _by_shard(batches):
            pairs = [np.frombuffer(data, np.uint64).reshape(2, -1) for _, _, data in rows]
            key, _, (n,) = _summed(np.concatenate([p[0] for p in pairs]), [np.concatenate([p[1] for p in pairs]).view(np.int64)])
            _save(folder, f"words-{k}", {"keys": key, "counts": _least(n)})
            of = _class(n)
            yield _batch([(k, np.bincount(of, minlength=CLASSES).tolist(), np.bincount(of, weights=n, minlength=CLASSES).astype(np.int64).tolist())], "file int, words array<long>, tokens array<long>")

    dealt = texts.mapInArrow(frugal(count), ROWS).repartitionById(files, F.col("shard")).sortWithinPartitions("shard")
    found = staged(dealt.mapInArrow(frugal(merge), "file int, words array<long>, tokens array<long>"), "classes")
    held = found.select("file", F.posexplode(F.arrays_zip("words", "tokens")).alias("class", "n")).select("file", "class", "n.words", "n.tokens")
    sums = {r["class"]: r for r in held.groupBy("class").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()}  # CLASSES rows
    sizes = np.array([sums[c]["words"] if c in sums else 0 for c in range(CLASSES)], np.int64)
    tokens = np.array([sums[c]["tokens"] if c in sums else 0 for c in range(CLASSES)], np.int64)
    # ids go down the classes, and through the files inside a class; each file is told how many words of a class lie before it
    firsts = 1 + np.cumsum(sizes[::-1])[::-1] - sizes
    before = F.coalesce(F.sum("words").over(Window.partitionBy("class").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = held.select("file", "class", before.alias("n")).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "n"))), lambda x: x["n"]).alias("before"))
    wide = np.uint32 if sizes.sum() + 2 < 2**32 else np.uint64

    def number(batches):
        for batch in batches:
            for k, start in zip(batch.column("file").to_pylist(), batch.column("before")):
                held = _mapped(f"{folder}/words-{k}.arrays")
                of = _class(held["counts"])
                order = np.argsort(of, kind="stable")
                n = np.bincount(of, minlength=CLASSES)
                ids = np.empty(len(of), wide)
                ids[order] = (firsts + start.values.to_numpy())[of[order]] + spread(np.zeros(CLASSES, np.int64), n)
                _save(folder, f"ids-{k}", {"ids": ids})
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["id"])

    told.repartitionById(files, F.col("file")).mapInArrow(frugal(number), "id long").agg(F.count("*")).first()
    hot = np.arange(CLASSES) >= 4 * np.log2(SHARD_TOKENS)
    return int(tokens.sum()), int(sizes.sum()), int(sizes[hot].sum()), int(tokens[hot].sum())


def train(docs: DataFrame, order: int = 2) -> Model:
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    shipped(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    chars, rows = texts.agg(F.sum(F.length("text")), F.count("*")).first()
    files = int(1 + (chars or 0) // WORD_FILE_CHARS)
    folder = mounted(fresh_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    tokens, words, last_hot, hot_tokens = vocabulary(texts, folder, files)
    cold = max(1, -(-(tokens - hot_tokens) // SHARD_TOKENS))
    hot = max(1, -(-(hot_tokens + rows) // SHARD_TOKENS))
    model = Model(folder, order, tokens, words, files, cold, hot, last_hot)
    shards, dtype = cold + hot, model.kind()
    widths = [1]
    while -(-shards // widths[0]) > FAN:
        widths.insert(0, widths[0] * FAN)

    def cut(columns, values, width):
        group = model.shard(columns, gram(columns), False) // width
        return _batch(_dealt(2 * order, columns, values, group, -(-shards // width)))

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, limit=TEXT_BYTES):
                hashes, local, bounds = tokenised(part.column("text"))
                ids = model.word(hashes)[0][local]
                held.append(np.stack([*before(ids, bounds, order), ids]))
                size += len(ids)
                if size >= BUFFER:
                    columns, held, size = np.concatenate(held, axis=1), [], 0
                    yield cut(columns, [np.ones(columns.shape[1], np.int64)], widths[0])
        if size:
            columns = np.concatenate(held, axis=1)
            yield cut(columns, [np.ones(columns.shape[1], np.int64)], widths[0])

    def again(width):
        """Deals the n-grams of a group of shards to smaller groups."""

        def run(batches):
            held, size = [], 0
            for _, rows in _by_shard(batches):
                for _, _, data in rows:
                    held.append(_decoded(data, False, dtype))
                    size += held[-1][0].shape[1]
                    if size >= BUFFER:
                        yield cut(np.concatenate([c for c, _ in held], axis=1), [np.concatenate([v[0] for _, v in held])], width)
                        held, size = [], 0
                if size:
                    yield cut(np.concatenate([c for c, _ in held], axis=1), [np.concatenate([v[0] for _, v in held])], width)
                    held, size = [], 0

        return run

    def level(n, shard, key, columns, c, often):
        """Writes the n-grams of order n, whose hashes are in order; returns their contexts, and what order n - 1 gets."""
        # texts' first words have no context of this length
        full = ~((columns[0] == 0) & (columns[1] == 0)) if n > 2 else np.ones(len(key), bool)
        some = bool(full.all())
        _save_table(folder, f"grams-{n}-{shard}", key if some else key[full], [c if some else c[full]])
        often[4 * (n - 2) : 4 * (n - 1)] += np.bincount(np.minimum(c[full], 5), minlength=6)[1:5]
        ends = np.where(full, 1, c) if n > 2 else np.ones(len(key), np.int64)
        inner = columns[:-1] if some else columns[:-1, full]
        c = c if some else c[full]
        one, two = (c == 1).astype(np.int64), (c == 2).astype(np.int64)
        ckey, at, sums = _summed(gram(inner), [c, one, two, 1 - one - two])
        return (ckey, inner[:, at], sums), (columns[1:], ends)

    def words_of(ids, n):
        """Rows of predecessors, by id."""
        key, _, (n,) = _summed(ids.astype(np.uint64), [n])
        return _dealt(WORDS, key[None, :], [n], hot + (key % np.uint64(files)).astype(np.int64), hot + files)

    def hot_level(n, shard, key, columns, c, often):
        (ckey, inner, sums), (lower, ends) = level(n, shard, key, columns, c, often)
        out = _dealt(2 * n + 1, inner, sums, _slot(ckey, hot), hot + files)
        if n == 2:
            return out + words_of(lower[0], ends)
        key, at, (ends,) = _summed(gram(lower), [ends])
        return out + _dealt(2 * (n - 1), lower[:, at], [ends], _slot(key, hot), hot + files)

    def counts_of_counts(often, shard):
        return [(hot + shard % files, OFTEN, often.tobytes())] if often.any() else []

    def first(batches):
        for shard, rows in _by_shard(batches):
            columns, (c,) = _of_kind(rows, 2 * order, dtype)
            del rows
            key, at, (c,) = _summed(gram(columns), [c])
            columns = columns[:, at]
            often = np.zeros(4 * (order - 1), np.int64)
            if shard >= cold:
                yield _batch(hot_level(order, shard, key, columns, c, often) + counts_of_counts(often, shard))
                continue
            for n in range(order, 1, -1):
                (ckey, _, sums), (columns, c) = level(n, shard, key, columns, c, often)
                _save_table(folder, f"contexts-{n}-{shard}", ckey, sums)
                if n > 2:
                    key, at, (c,) = _summed(gram(columns), [c])
                    columns = columns[:, at]
            yield _batch(words_of(columns[0], c) + counts_of_counts(often, shard))

    def later(n):
        """Hot n-grams of order n, contexts of order n + 1, and words' predecessors so far."""

        def run(batches):
            for shard, rows in _by_shard(batches):
                out = [r for r in rows if r[1] == OFTEN]
                if (found := _of_kind(rows, 2 * n + 3, dtype)) is not None:
                    key, _, sums = _summed(gram(found[0]), found[1])
                    _save_table(folder, f"contexts-{n + 1}-{cold + shard}", key, sums)
                if (found := _of_kind(rows, 2 * n, dtype)) is not None and n > 1:
                    key, at, (c,) = _summed(gram(found[0]), found[1])
                    often = np.zeros(4 * (order - 1), np.int64)
                    out += hot_level(n, cold + shard, key, found[0][:, at], c, often) + counts_of_counts(often, shard)
                if (found := _of_kind(rows, WORDS, dtype)) is not None and n > 1:
                    out += words_of(found[0][0], found[1][0])
                elif found is not None:
                    part = shard - hot
                    seen = np.zeros(max(0, -(-(words + 1 - part) // files)), np.int64)
                    at = found[0][0].astype(np.int64) // files
                    seen += np.bincount(at, weights=found[1][0], minlength=len(seen)).astype(np.int64)
                    _save(folder, f"predecessors-{part}", {"n": _least(seen)})
                    out.append((shard, WORDS, np.concatenate([[seen.sum()], np.bincount(np.minimum(seen, 5), minlength=6)[1:]]).astype("<i8").tobytes()))
                yield _batch(out)

        return run

    rows = texts.mapInArrow(frugal(count), ROWS)
    for wide, narrow in zip(widths, widths[1:]):
        rows = rows.repartitionById(-(-shards // wide), F.col("shard")).sortWithinPartitions("shard").mapInArrow(frugal(again(narrow)), ROWS)
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(frugal(first), ROWS)
    for n in range(order - 1, 0, -1):
        rows = rows.repartitionById(hot + files, F.col("shard")).sortWithinPartitions("shard").mapInArrow(frugal(later(n)), ROWS)
    totals, often = np.zeros(6, np.int64), np.zeros(4 * (order - 1), np.int64)
    for kind, numbers in _totals(rows).items():
        (often if kind == OFTEN else totals)[:] = numbers
    model.discounts = [discounts_of(totals[1:5].tolist()), *(discounts_of(often[4 * k : 4 * k + 4].tolist()) for k in range(order - 1))]
    model.predecessors = int(totals[0])
    if model.predecessors:
        model.spare = float(model.discounts[0] @ [totals[1], totals[2], totals[3:].sum()] / model.predecessors)
    return model


def _totals(rows: DataFrame) -> dict[int, list[int]]:
    """Sums of the last rows' numbers, by kind."""

    def add(batches):
        held = defaultdict(int)
        for batch in batches:
            for _, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                held[kind] = held[kind] + np.frombuffer(data, "<i8")
        yield _batch([(k, v.tolist()) for k, v in held.items()], "kind int, numbers array<long>")

    each = rows.mapInArrow(add, "kind int, numbers array<long>").select("kind", F.posexplode("numbers").alias("at", "n"))
    out: dict[int, list[int]] = defaultdict(list)
    for r in each.groupBy("kind", "at").agg(F.sum("n").alias("n")).orderBy("kind", "at").collect():
        out[r["kind"]].append(r["n"])
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # without the arrays, which workers map

    def run(batches):
        model = shared.value
        base = np.log10(model.tokens + 0.1 * (model.words + 1))
        for batch in batches:
            for part in chunks(batch, limit=TEXT_BYTES):
                hashes, local, bounds = tokenised(part.column("text"))
                ids, counts = model.word(hashes)
                alone = model._of_words(ids)
                columns = before(ids[local], bounds, model.order)
                logs = model.log10_of_ids([*columns, ids[local]], alone[local])
                n, first = np.diff(bounds), bounds[:-1]
                total = np.add.reduceat(logs, first)
                basic = np.add.reduceat((np.log10(counts + 0.1) - base)[local], first)
                columns = [n, np.add.reduceat((counts > 0).astype(np.int64)[local], first), np.full(len(n), model.tokens), basic, total, 10 ** (-total / n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *map(pa.array, columns)], [x.split()[0] for x in SCORES.split(", ")])

    return docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(run), SCORES)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs.filter(~held_out()), ORDER))
