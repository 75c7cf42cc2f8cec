import random
import re

import corpus_pipeline
from corpus_pipeline import STAGES, run
from tests.llm.test_exact_dedup import brute as brute_copies
from tests.llm.test_ngram_join import brute as brute_near
from tests.llm.test_packing import best_fit_decreasing


def table(spark, path):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(150)]
    rows, labels = [], []
    for k in range(260):
        kind = rng.choice([0, 1, 2, 2, 2, 2])
        text = rng.choices(words, k=rng.randint(20, 90))
        if kind == 0:
            text = [w + "###" for w in text]
        if kind == 1:
            text[rng.randrange(len(text))] = "badword"
        if k > 60 and rng.random() < 0.3:
            old, kind = rng.choice(rows[:50])[1].split(), None
            if rng.random() < 0.5:
                old[rng.randrange(len(old))] = "edited"
            text = old
        if rng.random() < 0.2:
            text.append("mail a.b@c.example")
        rows.append((k, " ".join(text), "en", f"s{k % 3}", len(" ".join(text))))
        if kind is not None:
            labels.append((k, int(kind > 0), int(kind == 1)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {k: (q, t) for k, q, t in labels}


def test_stages_one_after_the_other(spark, tmp_path):
    sf = str(tmp_path)
    labels = table(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, None
    for k, (name, stage) in enumerate(STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out-{k}")
        docs = spark.read.parquet(f"{sf}/out-{k}")
        if k < 4:
            assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 0:
            good = {d for d, (q, t) in labels.items() if q and not t}
            assert len(good - left) <= 0.02 * len(good) and len(left & (set(labels) - good)) <= 0.1 * len(labels)
        if k == 1:
            assert left == {r[0] for r in brute_copies(before) if r[3]}
        if k == 2:
            assert left == {d for d, _, c in brute_near(before, 5, 80) if d == c}
        if k == 3:
            assert left == {d for d, _ in before}
            for r in docs.collect():
                assert "@" not in (r.text or "") and (r.text is None or r.n_chars == len(r.text))
                kept = dict(before)[r.doc_id]
                assert r.text == (kept and re.sub(r"[a-z.]+@[a-z.]+", "[EMAIL]", kept))
    sizes = [r.length for r in docs.collect()]
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in before}
    assert docs.select("sequence_id").distinct().count() == len(best_fit_decreasing(sizes, 4096))


def test_run_and_empty_tables(spark, tmp_path):
    sf = str(tmp_path / "a")
    table(spark, sf)
    assert run(spark, sf).count() > 50
    empty = str(tmp_path / "b")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert run(spark, empty).count() == 0
    assert len(corpus_pipeline.STAGES) == 5
