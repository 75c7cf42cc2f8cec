import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import fill_in_middle as fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=700))
def test_rank_and_select_equal_counting(bits):
    bits = np.array(bits, bool)
    v = fim.BitVector(bits)
    places = np.arange(len(bits) + 1)
    assert v.rank(places).tolist() == [int(bits[:i].sum()) for i in places]
    ones = np.flatnonzero(bits)
    assert v.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tallyframe.llm.common.CHUNK_BYTES", 2000)
    texts = ["", None, " ", "one", " one", "one \t", "a b c d e f", "é ü　x  日本 語\n\n", "has <P> mark", "<S>", "<", "<P", "a< b> <M c", "x" * 5000, "w \n" * 9000, "\x00 \x0b\x0c y", "𝄞 𝄞𝄞 "]
    rows = [(k, texts[k % len(texts)] if k < 200 else " ".join(map(str, range(k)))) for k in range(260)]
    rows += [(None, "no id here"), (None, None), (7, "again"), (7, "again"), (-5, "minus id a b c")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, form string, n int").repartition(5)
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=repr)
    assert got == sorted(((i, *expected(i, t), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_no_shuffle(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = fim.transform(docs)
    assert out.count() == 0 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_rates_are_parameters(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    assert {r.form for r in fim.transform(docs, rate=100, spm=100).select("form").distinct().collect()} == {"spm"}
    assert {r.form for r in fim.transform(docs, rate=0).select("form").distinct().collect()} == {"plain"}
    a, b = (fim.transform(docs, seed=s, rate=100).select("doc_id", "output") for s in (1, 2))
    assert a.exceptAll(b).count() > 50
