import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyframe.llm import syncmers
from tallyframe.llm.syncmers import K, anchors, fingerprints


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 9)
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma", "delta", "é", "zeta", "eta", "theta"]
    rows = [(k * 7 % 1009, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 9, 40, 200])))) for k in range(120)]
    rows += [(5000, None), (5001, "x" * 3000), (5002, "ünï " * 4000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, marks string").repartition(5)

    names = sorted({w for _, t in rows for w in re.findall("[^\x20\x09-\x0d]{1,32}", (t or "").lower())} | {"x" * 32, "x" * 24})
    # pieces that cuts of the edit leave of words are hashed as well
    names = sorted({w[a:b] + v[:c] for w in names for v in [*names, ""] for a in (0,) for b in range(len(w) + 1) for c in range(len(v) + 1) if len(w) < 30 and len(v) < 30} | set(names) | {"x" * n for n in range(33)})
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in names], "w string").select("w", F.hash("w").alias("h")).collect()}

    def chosen(text):
        h = [hashes[w] for w in re.findall("[^\x20\x09-\x0d]{1,32}", text.lower())]
        if len(h) < K:
            return [tuple(h)] if h else []
        return [tuple(h[i : i + K]) for i in range(len(h) - K + 1) if min(h[i : i + K]) in (h[i], h[i + K - 1])]

    def like(a, b):
        return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))

    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(chosen(text))
        assert abs(r.near_next - like(chosen(text), chosen(nxt))) < 1e-9
        if all(w in hashes for w in re.findall("[^\x20\x09-\x0d]{1,32}", edited.lower())):
            assert abs(r.near_edited - like(chosen(text), chosen(edited))) < 1e-9
    found = anchors(docs).filter("doc_id = 5002").count()
    assert found == len(chosen("ünï " * 4000))


def test_only_texts_without_words_have_no_anchor(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randint(0, 999)}" for _ in range(5 + k % 3))) for k in range(120)] + [(900, None), (901, " \n"), (902, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in syncmers.op10_closed_syncmers(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r.fingerprint == ""} == {900, 901}
    # texts that differ are not alike for want of anchors
    assert all(got[k].near_next < 1 for k in range(1, 120))
    plain = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    assert any(plain[k] == "" for k in range(120)) and all(plain[k] in ("", got[k].fingerprint) for k in plain)
    assert {r.doc_id for r in anchors(docs, filled=True).collect()} == {k for k in got if k not in (900, 901)}


def test_ties_missing_ids_and_small_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "q"), (None, None), (3, "")], "doc_id long, text string")
    got = fingerprints(docs).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert {r.near_next for r in got if r.doc_id == 1} == {1.0, 0.0}
    one = fingerprints(docs.filter("doc_id = 3")).collect()
    assert one[0].near_edited == 1.0 and one[0].near_next == 1.0 and one[0].fingerprint == ""
    assert fingerprints(docs.limit(0)).count() == 0


def test_no_id_is_hot(spark, monkeypatch):
    """A third of the rows without id, a third with one id, of which half are one text: all buckets are of one size."""
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 50)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "same text" if k % 2 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = syncmers.with_next(docs).withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in found.groupBy("p").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 400
    # each row's next text is the one of the row that follows in the stated order
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = sorted((r[0] or -1, r[1], order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    assert sorted((r.doc_id or -1, r.text, r.next_text) for r in found.collect()) == want
