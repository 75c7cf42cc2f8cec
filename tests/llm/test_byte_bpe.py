import hashlib
import random

import numpy as np
import pyarrow as pa
import tiktoken

from tallyframe.llm.byte_bpe import codec, decode, default_files, digests, encode


def reference():
    c = codec(*default_files())
    return tiktoken.Encoding("own", pat_str=default_files()[1], mergeable_ranks=c.ranks, special_tokens={})


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\nb", "  x", "it's we'll", "éàü ß", "日本語 テキスト", "aaaaaaaa", "....... ...", "xooooo !!!!!!!",
    "<|endoftext|> x", "emoji 👩‍👩‍👧 🏳️‍🌈", "0000000 99999", "a b c", "ends ", "\t\ttabs", "x" * 5000, "ooo" * 700 + " h" * 300, "\x1c \x85",
]


def test_matches_the_rank_definition():
    enc, ref = codec(*default_files()), reference()
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "a", "o", "oo", "h", "ha", ".", "..", "!", "é", "ß", "0", "9", "'s", "the", "ing", "-", "ㅋ", "・", " ", "~", "_", "F", "ff"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    ids, bounds = enc.encode_arrow(pa.array(texts))
    for k, text in enumerate(texts):
        got = ids[bounds[k] : bounds[k + 1]].tolist()
        assert got == ref.encode_ordinary(text), text
        assert enc.decode(np.array(got)) == text.encode()
    assert enc.encode_arrow(pa.array([], pa.string()))[0].size == 0


def test_digests_and_round_trip(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(99, None, "x"), (99, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ref = reference()
    got = {r.doc_id: r for r in digests(docs).collect()}
    for k, t in enumerate(TEXTS):
        want = ref.encode_ordinary(t)
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[99].n_tokens == 0
    assert {r.doc_id: r.text for r in decode(encode(docs)).collect()}[20] == TEXTS[20]
    assert digests(docs.limit(0)).count() == 0
