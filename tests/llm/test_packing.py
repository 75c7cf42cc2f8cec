import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import packing
from tallyframe.llm.packing import default_path, pack, sweep, token_ids, tokenizer


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def packed(segments, capacity):
    """Room of each sequence; places must be gapless and every piece placed once."""
    used, seen = defaultdict(list), set()
    for cell, length, rank, n, first, side, offset, skip in segments:
        for i in range(n):
            assert (cell, length, rank + i) not in seen
            seen.add((cell, length, rank + i))
            used[first + (skip + i) // side].append((offset + (skip + i) % side * length, length))
    rooms = {}
    for sequence, places in used.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        rooms[sequence] = capacity - at
    return rooms, seen


def some_lengths(rng):
    capacity = rng.choice([10, 37, 100])
    return capacity, [min(capacity, 1 + int(rng.expovariate(1 / rng.choice([2, 9, 30])))) for _ in range(rng.randint(1, 150))]


def test_sweep_equals_sequential_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        capacity, lengths = some_lengths(rng)
        classes = {n: [(0, 0, lengths.count(n))] for n in set(lengths)}
        segments, gaps, held = sweep(classes, capacity)
        rooms, seen = packed(segments, capacity)
        assert len(seen) == len(lengths) and not held
        assert sorted(rooms.values()) == best_fit_decreasing(lengths, capacity)
        assert sorted(room for room, _, n in gaps for _ in range(n)) == sorted(r for r in rooms.values() if r)


def test_sweep_into_gaps_within_a_limit():
    rng = random.Random(3)
    for _ in range(60):
        capacity, lengths = some_lengths(rng)
        classes = {n: [(7, 0, 1), (9, 5, lengths.count(n) - 1)] if lengths.count(n) > 1 else [(7, 0, 1)] for n in set(lengths)}
        limit = sum(lengths) // capacity
        segments, gaps, held = sweep(classes, capacity, limit=limit, base=1000)
        again = defaultdict(list)
        for length, *run in held:
            again[length].append(tuple(run))
        more, _, none = sweep(again, capacity, gaps, base=5000)
        assert not none and all(1000 <= s[4] + (s[7] + s[3] - 1) // s[5] < 1000 + limit for s in segments)
        rooms, seen = packed(segments + more, capacity)
        assert len(seen) == len(lengths) and len(rooms) <= len(best_fit_decreasing(lengths, capacity)) + 1


def test_rounds_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "JOINED_CELLS", 3)
    rng = random.Random(4)
    lengths = [min(256, 1 + int(rng.expovariate(1 / 60))) for _ in range(4000)]
    rows = packing.swept(spark, dict(Counter(lengths)), 23, 256).collect()
    rooms, seen = packed([(r.cell, r["size"], r["rank"], r.n, r.sequence, r.side, r["offset"], r.skip) for r in rows], 256)
    assert seen == {(r % 23, length, r // 23) for length, n in Counter(lengths).items() for r in range(n)}
    assert len(rooms) <= -(-sum(lengths) // 256) + 1
    assert packing.swept(spark, {}, 1, 256).count() == 0


def test_known_words_stay_within_their_bound(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    known, bpe = packing.KnownWords(default_path()), tokenizer(default_path())
    for k in range(12):
        words = [f"word{j}" for j in range(k * 9, k * 9 + 30)] + ["common", "\x01", "a\x01b", "\u00a0", "don't", "é"]
        ids, size = known.ids(words)
        at = np.concatenate([[0], np.cumsum(size)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [bpe.encode(w, add_special_tokens=False).ids for w in words]
        assert len(known.low) <= 40 and len(known.pool) == known.size.sum()


def test_token_ids_equal_whole_text_encoding():
    texts = ["", "Hello  World's\n\tit's 123", "É́ Σς ΑΣ", "a b c", "日本語 x", "x" * 3000, "--- !!!'S we'LL", "e ́x", "<|endoftext|>", "\x1cq \x85 z", "Word, word. WORD. É. é́. H̱. h., 'S. 1. 1, a.b. ß, .. , x.,"]
    ids, bounds = token_ids(pa.array(texts), default_path())
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer(default_path()).encode(t, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("cell_pieces", [50_000, 40])
def test_pack_rows(spark, monkeypatch, cell_pieces):
    monkeypatch.setattr(packing, "CELL_PIECES", cell_pieces)
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "don't", "42", "élan"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 300]))), 7) for k in range(60)]
    rows += [(100, None, 1), (100, None, 1), (101, "word " * 5000, 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack(docs, capacity=256).collect()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) == len(best_fit_decreasing([r.length for r in got], 256))
    assert sum(r.length for r in got) == sum(len(tokenizer(default_path()).encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    long = sorted(by_doc[101], key=lambda r: r.piece)
    ids = tokenizer(default_path()).encode("word " * 5000, add_special_tokens=False).ids + [1]
    assert [r.start for r in long] == list(range(0, len(ids), 256))
    assert [r.ids_crc32 for r in long] == [zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes()) for k in range(0, len(ids), 256)]
    assert len(by_doc[100]) == 2 and len(by_doc[None]) == 1
    assert pack(docs.limit(0)).count() == 0


def test_tasks_of_the_last_round_read_no_more_with_more_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "JOINED_CELLS", 4)
    rng = random.Random(8)
    most = {}
    for cells in (16, 256):
        lengths = [min(512, int(rng.lognormvariate(4.5, 1.0)) + 1) for _ in range(400 * cells)]
        kept = []
        keep = packing.staged
        monkeypatch.setattr(packing, "staged", lambda df, name: kept.append(keep(df, name)) or kept[-1])
        segments = packing.swept(spark, dict(Counter(lengths)), cells, 512).collect()
        monkeypatch.setattr(packing, "staged", keep)
        left = [r for r in kept[-2].filter("kind > 0").select("cell").collect()]
        most[cells] = max(Counter(r["cell"] // 4 for r in left).values())
        assert len(kept) == 3 and sum(r["n"] for r in segments) == len(lengths)
        # every sequence holds what it may, and there are hardly more than there must be
        used = Counter()
        for r in segments:
            for i in range(r["n"]):
                used[r["sequence"] + (r["skip"] + i) // r["side"]] += r["size"]
        assert max(used.values()) <= 512 and len(used) <= -(-sum(lengths) // 512) + cells // 16 + 1
    assert most[256] <= 1.5 * most[16]
