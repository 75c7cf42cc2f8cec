import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyframe.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int"


def brute(turns, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(lambda: [[], [], set()])
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]][0].append(c)
            if d:
                nodes[path[: d - 1]][2].add(path[:d])
        nodes[path][1].append(c)
    out = []

    def walk(k):
        members, ends, kids = nodes[k]
        below = [walk(x) for x in kids]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(members) - 1) * (len(k[-1][1]) if k else 0)
        text = ",".join(map(str, sorted(ends)))
        out.append((min(members), len(k), min(nodes[k[:-1]][0]) if k else None, len(members), len(kids), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
        return leaves, saved

    if own:
        walk(())
    return sorted(out, key=repr)


def found(spark, turns, rebuild=True):
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], SCHEMA).repartition(7)
    convs = pt.paths(df)
    return sorted(map(tuple, pt.trie(pt.rebuilt(convs) if rebuild else convs).collect()), key=repr)


def conversations(seed, n, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "hello", "ünï", "x" * 50][:words])))
    return rows


@pytest.mark.parametrize("limit, run", [(20_000, 1_000), (40, 3), (5, 1)])
def test_equals_brute_force(spark, monkeypatch, limit, run):
    monkeypatch.setattr(pt, "BUCKET_TURNS", limit)
    monkeypatch.setattr(pt, "RUN_IDS", run)
    monkeypatch.setattr(pt, "SALTS", 3)
    turns = conversations(1, 230) + [(-7, None, "user", "first"), (-7, 1, None, None), (-7, None, None, None), (None, 1, "user", "lost"), (500, 3, "a", "b"), (500, 3, "a", "b")]
    assert found(spark, turns) == brute(turns)


def test_deep_shared_prefix_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(pt, "BUCKET_TURNS", 50)
    calls = []
    keep = pt.staged
    monkeypatch.setattr(pt, "staged", lambda df, name: calls.append(name) or keep(df, name))
    turns = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(40)]
    turns += [(c, 40 + t, "user", f"own {c // 3}") for c in range(30) for t in range(c % 4)]
    assert found(spark, turns, rebuild=False) == brute(turns, rebuild=False)
    assert calls.count("large") < 6


def test_copies_are_one_entry(spark, monkeypatch):
    monkeypatch.setattr(pt, "RUN_IDS", 10)
    turns = [(c, t, "user", "same") for c in range(400) for t in range(2)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], SCHEMA).repartition(5)
    rows = pt.entries(pt.paths(df)).collect()
    assert len(rows) == 1 and (rows[0].n, rows[0].first) == (400, 0)
    assert rows[0].ends == hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    # conversation 1 has no base; its only turn is cut away where h is at least 1
    turns = [(c, 0, "user", "only") for c in (1, 2, 3, 4)]
    got = found(spark, turns)
    assert got == brute(turns) and any(r[1] == 0 and r[3] == 4 for r in got)
    assert any(zlib.crc32(str(c).encode()) % 6 for c in (1, 2, 3, 4))


def test_one_long_conversation(spark):
    turns = [(9, t, "user", f"{t}") for t in range(3000)]
    got = found(spark, turns, rebuild=False)
    assert len(got) == 3001 and {r[5] for r in got} == {1}
