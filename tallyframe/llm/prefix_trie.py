"""Prefix trie of conversations: shared first turns are found, counted and priced once.

A turn is a unit of 40 characters: the digest of role and text, and the text's length. A conversation is its units in a
row (its path), so texts are read once and never travel. Equal paths become one entry with their number and smallest
conv_id; the ids of a run of equal paths are hashed as a sorted stream, in parts where a run crosses tasks, so a third of
all rows in one sequence is no large group anywhere.

Entries go to buckets by the digest of their first turn. In a bucket, ``applyInPandas`` grows pointer tries, dictionaries of
numbered children, and walks the numbers backwards: an iterative postorder, since a child is made after its parent. The
subtrie of one first turn that holds more than BUCKET_TURNS turns is not grown: it is split by the next turn, again and
again. A round first runs down the turns that all entries of the subtrie share, then parts them, so rounds follow branches,
not depth. Nodes above the buckets are put together from sums over their children, the deepest first.

Rows are ordered by turn (null first; equal turns by digest). Null role and null text are empty strings; repeated rows are
repeated turns; rows without conv_id belong to no conversation and give nothing. Long texts only cost their digest; a
conversation is one row of 40 bytes a turn. An empty table gives no nodes; conversations that rebuilding leaves without
turns are members of the root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, read_table, shipped, staged

#: Characters of a turn's unit: 32 of its digest and 8 of its length.
UNIT = 40
#: Turns of a bucket, about, and of the largest subtrie that is grown whole.
BUCKET_TURNS = 20_000
#: Parts in which entries of one subtrie meet what belongs to it.
SALTS = 32
#: Ids in a part of a run that crosses tasks.
RUN_IDS = 1_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def unit(role: Column, text: Column) -> Column:
    """Digest and length of a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(digest, F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 8, "0"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id and path of each conversation in the order of its turns."""
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", unit(F.col("role"), F.col("text")).alias("unit"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "unit"))).alias("t"))
    return held.select("conv_id", F.array_join(F.transform("t", lambda x: x["unit"]), "").alias("path"))


def rebuilt(convs: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each path with its first h units exchanged for those of conversation c - c % every; h = crc32(c) % heads."""
    base = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.left("path", F.lit((heads - 1) * UNIT)).alias("head"))
    rows = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads * UNIT).cast("int")
    own = F.substring("path", cut + 1, F.length("path"))
    return rows.select("conv_id", F.concat(F.coalesce(F.left("head", cut), F.lit("")), own).alias("path"))


def _given(path: str, ids: list[int], whole: bool) -> tuple:
    text = ",".join(map(str, ids))
    return path, len(ids), ids[0], hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text


def _table(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.values())], list(schema))


_PART = {"path": pa.string(), "n": pa.int64(), "first": pa.int64(), "ends": pa.string(), "part": pa.string()}


def _runs(batches):
    """Entries of a sorted task's runs of equal paths; of runs that may go on elsewhere, or are long, ids in parts."""
    path, ids, whole, out = None, [], False, []
    for batch in batches:
        for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if p != path:
                if path is not None:
                    out.append(_given(path, ids, whole))
                path, ids, whole = p, [], path is not None
            elif len(ids) == RUN_IDS:
                out.append(_given(path, ids, False))
                ids, whole = [], False
            ids.append(c)
        if len(out) > 1_000:
            yield _table(out, _PART)
            out = []
    if path is not None:
        yield _table([*out, _given(path, ids, False)], _PART)


def _joined(batches):
    """Entries of parts in order: one digest runs over all parts of a path."""
    path, n, first, sha = None, 0, 0, None
    kinds = {k: _PART[k] for k in ("path", "n", "first", "ends")}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["path"] != path:
                if path is not None:
                    out.append((path, n, first, sha.hexdigest()))
                path, n, first, sha = r["path"], 0, r["first"], hashlib.sha256()
            sha.update(("," * (n > 0) + r["part"]).encode())
            n += r["n"]
        if out:
            yield _table(out, kinds)
    if path is not None:
        yield _table([(path, n, first, sha.hexdigest())], kinds)


def entries(convs: DataFrame) -> DataFrame:
    """path, n, first and ends (digest of the ascending ids) of each distinct path."""
    rows = convs.withColumn("p", F.md5("path")).repartitionByRange("p", "conv_id").sortWithinPartitions("p", "conv_id")
    found = staged(rows.select("path", "conv_id").mapInArrow(frugal(_runs), "path string, n long, first long, ends string, part string"), "runs")
    parts = found.filter("part is not null").repartition(F.md5("path")).sortWithinPartitions(F.md5("path"), "first")
    joined = parts.select("path", "n", "first", "part").mapInArrow(frugal(_joined), "path string, n long, first long, ends string")
    return found.filter("part is null").drop("part").unionByName(joined)


def _met(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """``rows`` joined by key with a row of ``few``: each of these is there once for every salt, so that a hot key is many."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(few, ["key", "salt"], how).drop("salt")


def _units(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(f".{{{UNIT}}}"), 0)


def _shared(a: Column, b: Column) -> Column:
    """How many first units the least and the greatest of some paths share, which is what all of them share."""
    same = F.zip_with(_units(a), _units(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def split(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Tables of the nodes above the buckets, one a round; entries for the buckets with the node they hang on; entries that end above.

    A node above: key, up (key of the node that it hangs on), up_conv, above (turns before its chain), chain (units that all
    of its entries share from there; its last is the node that has the children), n_convs and conv_id.
    """
    root = rows.agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id")).filter("n_convs is not null")
    root = root.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("up_conv"), F.lit(-1).alias("above"), F.lit("0" * UNIT).alias("chain"), "n_convs", "conv_id")
    above, ready, ended = [staged(root, "above")], [], []
    smallest = above[0].select("conv_id").scalar()
    rows = rows.select("path", "n", "first", "ends", F.lit(0).alias("cut"), F.lit("").alias("up"), smallest.alias("up_conv"))
    while True:
        ended.append(rows.filter(F.length("path") == F.col("cut") * UNIT).select("up", "ends"))
        below = rows.filter(F.length("path") > F.col("cut") * UNIT).withColumn("key", F.md5(F.left("path", (F.col("cut") + 1) * UNIT)))
        sizes = below.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.length("path") / UNIT - F.col("cut")).alias("turns"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"))
        large = staged(sizes.filter((F.col("rows") > 1) & (F.col("turns") > BUCKET_TURNS)).select("key", "n_convs", "conv_id"), "large")
        if large.isEmpty():
            return above, [*ready, below], _union(ended)
        met = _met(below, large, "left")
        ready.append(met.filter("conv_id is null").drop("n_convs", "conv_id"))
        deep = staged(met.filter("conv_id is not null"), "deep")
        spans = deep.groupBy("key").agg(F.min("path").alias("a"), F.max("path").alias("b"), *(F.any_value(c).alias(c) for c in ("up", "up_conv", "cut", "n_convs", "conv_id")))
        spans = spans.withColumn("depth", _shared(F.col("a"), F.col("b")))
        chain = F.substring("a", F.col("cut") * UNIT + 1, (F.col("depth") - F.col("cut")) * UNIT)
        above.append(staged(spans.select("key", "up", "up_conv", F.col("cut").alias("above"), chain.alias("chain"), "n_convs", "conv_id"), "above"))
        depths = above[-1].select("key", (F.col("above") + F.length("chain") / UNIT).cast("int").alias("depth"))
        rows = _met(deep, depths, "inner").select("path", "n", "first", "ends", F.col("depth").alias("cut"), F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grown(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a bucket's tries; ``up`` of those that hang on a node above."""
    tops: dict = {}
    kids, parent, depth, length, n, low, ends, up, up_conv = [], [], [], [], [], [], [], [], []
    for path, count, first, end, cut, key, conv in zip(*(frame[c].tolist() for c in ("path", "n", "first", "ends", "cut", "up", "up_conv"))):
        at, found = -1, tops.setdefault(key, {})
        for k in range(cut, len(path) // UNIT):
            unit = path[k * UNIT : (k + 1) * UNIT]
            node = found.get(unit)
            if node is None:
                node = found[unit] = len(kids)
                kids.append({})
                parent.append(at)
                depth.append(k + 1)
                length.append(int(unit[32:], 16))
                n.append(0)
                low.append(first)
                ends.append(NO_ENDS)
                up.append(key if at < 0 else None)
                up_conv.append(conv)
            n[node] += count
            low[node] = min(low[node], first)
            at, found = node, kids[node]
        ends[at] = end
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for i in range(len(kids) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * length[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = [up_conv[i] if p < 0 else low[p] for i, p in enumerate(parent)]
    columns = [low, depth, above, n, [len(k) for k in kids], leaves, saved, ends, up]
    return pd.DataFrame(dict(zip(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "up"), columns)))


def _finished(above: list[DataFrame], grown: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes above the buckets, the deepest first: sums over children, then along each chain."""
    tops = grown.filter("up is not null").select("up", "n_leaves", "saved_tokens")
    out = []
    for level in reversed(above):
        sums = tops.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        rows = level.join(sums.withColumnRenamed("up", "key"), "key", "left").fillna(0, ["n_children", "saved"]).fillna(1, ["n_leaves"])
        rows = rows.join(ended.withColumnRenamed("up", "key"), "key", "left")
        rows = rows.select("*", F.posexplode(_units(F.col("chain"))).alias("i", "unit"))
        size = F.conv(F.right("unit", F.lit(8)), 16, 10).cast("long")
        below = Window.partitionBy("key").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
        last = F.col("i") == F.length("chain") / UNIT - 1
        rows = rows.select(
            "conv_id",
            (F.col("above") + 1 + F.col("i")).cast("long").alias("depth"),
            F.when(F.col("i") == 0, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("saved") + (F.col("n_convs") - 1) * F.sum(size).over(below)).alias("saved_tokens"),
            F.coalesce(F.when(last, F.col("ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
            F.when(F.col("i") == 0, F.col("up")).alias("up"),
        )
        rows = staged(rows, "finished")
        out.append(rows)
        tops = tops.unionByName(rows.filter("up is not null").select("up", "n_leaves", "saved_tokens"))
    return _union(out)


def trie(convs: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations (conv_id, path)."""
    shipped(convs.sparkSession)
    rows = staged(entries(convs), "entries")
    turns = rows.agg(F.sum(F.length("path") / UNIT)).first()[0] or 0
    above, ready, ended = split(rows)
    bucket = F.pmod(F.xxhash64("key"), F.lit(int(turns // BUCKET_TURNS) + 1))
    grown = _union([r.select("path", "n", "first", "ends", "cut", "up", "up_conv", bucket.alias("bucket")) for r in ready])
    grown = staged(grown.groupBy("bucket").applyInPandas(_grown, f"{NODES}, up string"), "grown")
    return _finished(above, grown, ended).unionByName(grown).drop("up")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(paths(read_table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS u FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT *, xor(4294967295, list_reduce(flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(c AS VARCHAR), '')]),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295)) % 6 AS h FROM (SELECT c, u FROM own)
), r AS (SELECT h.c, list_concat(coalesce(b.u[1:h.h], []), h.u[h.h + 1:]) AS u FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100
), p AS (SELECT c, len(u) AS l, d, sha256(CAST(u[1:d] AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(u[1:d - 1] AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN length(u[d].t) ELSE 0 END AS n
  FROM (SELECT c, u, unnest(generate_series(0, len(u))) AS d FROM r)
), g AS (SELECT k, d, any_value(up) AS up, any_value(n) AS n, min(c) AS c, count(*) AS members, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d), '')) AS ends FROM p GROUP BY k, d
), f AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.up = g.k AND x.d = g.d + 1) AS n_children FROM g
), s AS (SELECT DISTINCT a.k AS top, b.k AS k FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d
), t AS (SELECT s.top, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.members - 1) * f.n) AS saved FROM s JOIN f ON f.k = s.k GROUP BY s.top
)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.members AS n_convs, f.n_children, t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN t ON t.top = f.k LEFT JOIN f u ON u.k = f.up AND u.d = f.d - 1
"""
