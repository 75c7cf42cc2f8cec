"""Fill-in-the-middle transformation by succinct rank and select over packed boundary bits.

A unit is one match of ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: a word with the white space before it, or
the white space at the end. White space is ASCII, so units end at the same bytes as at code points. For a slice of an
Arrow batch, one bit a byte says whether a unit ends there and one whether a code point starts there; both vectors are
packed and carry a directory of the ones before each block of 64 bytes. Ones up to a text's end minus those up to its
start give its number of units, ``select`` of two ranks gives the byte cuts, ``rank`` over the other vector the lengths
in code points. The form and the draws are SQL expressions; so are output and restoration, which cut bytes.

Draws come from the digest of ``seed:doc_id``: two boundaries, whether the text is transformed (``rate`` in 100), and in
which order (``spm`` in 100: suffix first). Texts that hold a mark of their own stay plain, so restoration is exact.

Null text counts as empty and stays plain with no units. Rows without doc_id draw from ``seed:`` alone. Rows that repeat
a doc_id draw alike, and each gives a row. Long texts are slices of their own; memory is a few times the longest text.
Empty tables give empty results. Extra columns are ignored, whatever their names. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, frugal, text_only

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a block of the directory.
BLOCK = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Place of the j-th one of each byte's bits, first bit first.
_SELECT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> (7 - i) & 1]
    _SELECT[_byte, : len(_ones)] = _ones


class BitVector:
    """Packed bits with the number of ones before each block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits)
        self.packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8) + BLOCK // 8, np.uint8)])
        ones = np.bitwise_count(self.packed).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        self.directory = np.concatenate([[0], np.cumsum(ones)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = places // BLOCK
        rows = self.packed.reshape(-1, BLOCK // 8)[block]
        bits = np.arange(BLOCK) < (places % BLOCK)[:, None]
        return self.directory[block] + np.bitwise_count(rows & np.packbits(bits, axis=1)).sum(axis=1, dtype=np.int64)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Place of the one that has so many ones before it."""
        block = np.searchsorted(self.directory, ranks, side="right") - 1
        rows = self.packed.reshape(-1, BLOCK // 8)[block]
        upto = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        left = ranks - self.directory[block]
        byte = (upto <= left[:, None]).sum(axis=1)
        at = np.arange(len(ranks))
        before = np.where(byte > 0, upto[at, byte - 1], 0)
        return block * BLOCK + byte * 8 + _SELECT[rows[at, byte], left - before]


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: units, bytes and code points of prefix and middle; the cuts are first and second modulo units + 1."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    ends = np.empty(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    full = offsets[1:] > offsets[:-1]
    lasts = offsets[1:][full] - 1
    ends[lasts] = True
    units = BitVector(ends)
    points = BitVector((data & 0xC0) != 0x80)
    ranks = units.rank(offsets)
    n = ranks[1:] - ranks[:-1]
    a, b = first % (n + 1), second % (n + 1)
    starts, base = offsets[:-1], ranks[:-1]

    def cut(k: np.ndarray) -> np.ndarray:
        at = starts.copy()
        some = k > 0
        at[some] = units.select(base[some] + k[some] - 1) + 1
        return at

    low, high = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    before, p, q = points.rank(starts), points.rank(low), points.rank(high)
    return n, low - starts, high - low, p - before, q - p


def _located(batches):
    for batch in batches:
        for part in chunks(batch):
            texts = part.column("text").cast(pa.string())
            found = cuts(texts, part.column("h1").to_numpy(), part.column("h2").to_numpy())
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found)], [*part.schema.names, "n", "prefix_bytes", "middle_bytes", "p_chars", "m_chars"])


def _draw(seed: int, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output of every row."""
    rows = text_only(docs, *(_draw(seed, k).alias(f"h{k + 1}") for k in range(4)))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), "h1", "h2")
    kinds = rows.schema.simpleString()[len("struct<") : -1]
    found = rows.mapInArrow(frugal(_located), f"{kinds},n:bigint,prefix_bytes:bigint,middle_bytes:bigint,p_chars:bigint,m_chars:bigint")
    data = F.col("text").cast("binary")
    low, high = F.col("prefix_bytes").cast("int"), (F.col("prefix_bytes") + F.col("middle_bytes")).cast("int")
    part = lambda start, length: F.substring(data, start + 1, length).cast("string")
    prefix, middle, suffix = part(F.lit(0), low), part(low, F.col("middle_bytes").cast("int")), part(high, F.lit(2**31 - 1))
    spm_text = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm_text = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    shaped = F.col("form") != "plain"
    return found.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(shaped, F.col("p_chars")).alias("prefix_chars"),
        F.when(shaped, F.col("m_chars")).alias("middle_chars"),
        F.when(F.col("form") == "spm", spm_text).when(F.col("form") == "psm", psm_text).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; marks begin and end with characters of their own, so no cut makes one."""
    parts = F.split(output, "<[PSM]>", -1)  # the part before the first mark is empty
    return F.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1,
  CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
