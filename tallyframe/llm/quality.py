"""Ordinal quality classifier: cumulative-link (proportional odds) regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, thresholds in order. x are hashed
words (without the punctuation around them) and their first four and five characters, the punctuation they end with,
and buckets of a text's shape (repeats, capitals, symbols, distinct words). Expected grade = sum of the tail probabilities P(grade >= k);
selection asks for the tail probability of the top grade.

Grades come from ``labels``: 0 poor, 1 good but toxic, 2 good and clean. Training uses at most ``max_rows``
labelled documents (the smallest hashes of doc_id); features in fewer than ``min_docs`` of them, or that are no
sign of a lower grade, get no weight.
Every document is then scored on its whole text.

Null text counts as empty and is scored like any text. A doc_id with several labels takes the lowest quality and
the highest toxicity; labels with a null are left out; labels without a document do nothing. Without any usable
label every document is kept with null scores. Equal texts get equal scores. Extra columns are ignored by
``scored`` and carried by ``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, frugal, read_table, shipped, split_words, text_only, word_hashes

DIMENSIONS = 1 << 20
MAX_ROWS = 8_000
#: Bytes of text whose features are found at a time.
BATCH_BYTES = 5_000_000
MIN_DOCS = 4
#: A feature is used if the documents that have it fall short of a grade by so many standard errors.
SCREEN = 3.5
GRADES = 3
KEEP_PROBABILITY = 0.5
_EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])


def _hashed(words: pa.Array, salt: int) -> np.ndarray:
    return ((word_hashes(words) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(DIMENSIONS - 256)).astype(np.int64) + 256


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document, feature), each once, in document order. Features under 256 are shape buckets."""
    n = len(texts)
    flat, bounds = split_words(texts, lower=False)
    coded = flat.dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    core = pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    tail = pc.fill_null(pc.struct_field(pc.extract_regex(words, r"(?P<t>[^\pL\pN]+)$"), "t"), "")
    # a word, its first characters (stems keep their meaning under endings), and what it ends with
    ids = [_hashed(core, 1), _hashed(pc.utf8_slice_codeunits(core, 0, 4), 3), _hashed(pc.utf8_slice_codeunits(core, 0, 5), 4), _hashed(tail, 2)]
    letters = pc.greater(pc.binary_length(core), 0).to_numpy(zero_copy_only=False)
    upper = pc.match_substring_regex(words, r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$").to_numpy(zero_copy_only=False)
    tailed = pc.match_substring_regex(words, r"[^\pL\pN\s.,;:!?'\")\]][^\pL\pN\s.,;:'\")\]]*$|!!+$").to_numpy(zero_copy_only=False)
    size = np.diff(bounds)

    def share(of_token: np.ndarray) -> np.ndarray:
        return np.bincount(owner[of_token], minlength=n) / np.maximum(size, 1)

    same = np.zeros(len(index), bool)
    same[1:] = (index[1:] == index[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.unique(owner * np.int64(len(words) + 1) + index)
    distinct = np.bincount(pairs // (len(words) + 1), minlength=n) / np.maximum(size, 1)
    shapes = [share(same), share(~letters[index]), share(upper[index]), share(tailed[index]), distinct]
    shape = [16 * k + np.searchsorted(_EDGES, s) for k, s in enumerate(shapes)]
    shape += [96 + np.minimum(np.log2(size + 1).astype(np.int64), 20) * 8 + np.minimum((8 * distinct).astype(np.int64), 7)]
    docs = np.arange(n)
    pairs = pairs[pairs % (len(words) + 1) < len(words)]
    owner, index = pairs // (len(words) + 1), pairs % (len(words) + 1)  # each word of a text once
    every = np.unique(np.concatenate([docs * DIMENSIONS + s for s in shape] + [owner * DIMENSIONS + i[index] for i in ids]))
    return every // DIMENSIONS, every % DIMENSIONS


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # by feature
    thresholds: np.ndarray  # in order, one less than grades

    def tails(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) for k = 1.. of n documents."""
        score = np.bincount(doc, weights=self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def loss(p: np.ndarray, doc: np.ndarray, col: np.ndarray, grade: np.ndarray, used: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its penalty, and the gradient.

    p: weights, the first threshold, and the logs of the gaps between thresholds, so that they stay in order.
    """
    n, rows = len(grade), np.arange(len(grade))
    w, gaps = p[:used], np.exp(p[used + 1 :])
    theta = np.concatenate([[-np.inf], p[used] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
    score = np.bincount(doc, weights=w[col], minlength=n)
    high, low = _sigmoid(theta[grade + 1] - score), _sigmoid(theta[grade] - score)
    mass = np.maximum(high - low, 1e-9)
    d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
    g_theta = np.zeros((n, GRADES + 1))
    g_theta[rows, grade + 1] -= d_high
    g_theta[rows, grade] += d_low
    g_theta = g_theta[:, 1:-1].sum(axis=0) / n
    back = np.cumsum(g_theta[::-1])[::-1]
    g_w = np.bincount(col, weights=((d_high - d_low) / n)[doc], minlength=used) + l2 * w / n
    return -np.log(mass).mean() + l2 * (w @ w) / (2 * n), np.concatenate([g_w, back[:1], back[1:] * gaps])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, min_docs: int = MIN_DOCS, l2: float = 0.02, steps: int = 1500) -> OrdinalModel:
    """Maximum penalised likelihood by Adam; deterministic."""
    n, cuts = len(grade), GRADES - 1
    seen = np.bincount(feature, minlength=DIMENSIONS)
    score, odds = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for k in range(1, GRADES):
        rate = np.clip((grade >= k).mean(), 1e-3, 1 - 1e-3)
        above = np.bincount(feature, weights=(grade >= k)[doc], minlength=DIMENSIONS)
        below = (seen * rate - above) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
        odds = np.where(below > score, np.log((above + 0.5) / (seen - above + 0.5)) - np.log(rate / (1 - rate)), odds)
        score = np.maximum(score, below)
    used = np.flatnonzero((seen >= min_docs) & (score >= SCREEN))
    place = np.full(DIMENSIONS, -1, np.int64)
    place[used] = np.arange(len(used))
    kept = place[feature] >= 0
    doc, col = doc[kept], place[feature[kept]]
    share = np.array([np.clip((grade <= k).mean(), 1e-3, 1 - 1e-3) for k in range(cuts)])
    first = np.log(share / (1 - share))
    # weights start at each feature's own log odds: words that only occur beside others keep their say
    p = np.concatenate([np.clip(odds[used], -8, 0), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, g = loss(p, doc, col, grade, len(used), l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (1 if step < steps // 2 else 0.3)
    weights = np.zeros(DIMENSIONS, np.float64)
    weights[used] = p[: len(used)]
    return OrdinalModel(weights, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each labelled document."""
    usable = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    worst = usable.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return worst.select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("t") > 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> OrdinalModel | None:
    """The model of at most ``max_rows`` labelled documents; of rows that repeat an id, the text of least hash is taken."""
    sample = graded(labels).join(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so that it may be broadcast

    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=BATCH_BYTES):
                doc, feature = features(part.column("text"))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))], ["grade", "features"])

    rows = text_only(docs).join(F.broadcast(sample), "doc_id")
    # a row an id, added up before the shuffle: however often an id is repeated, no more than the sample comes to the driver
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("grade", "text").mapInArrow(frugal(run), "grade int, features array<int>")
    found = rows.toArrow()
    if not found.num_rows:
        return None
    lists = found.column("features").combine_chunks()
    doc = np.repeat(np.arange(found.num_rows), pc.list_value_length(lists).to_numpy())
    # rows arrive in any order; sorting makes the sums, and so the model, the same in each run
    grade, feature = found.column("grade").to_numpy().astype(np.int64), pc.list_flatten(lists).to_numpy().astype(np.int64)
    key = np.bincount(doc, weights=(feature * 2654435761 % 1000003).astype(np.float64), minlength=len(grade))
    rank = np.argsort(np.lexsort((grade, key)))
    order = np.lexsort((feature, rank[doc]))
    out = np.empty_like(grade)
    out[rank] = grade
    return fit(rank[doc][order], feature[order], out)


def _judge(model: OrdinalModel, spark: SparkSession):
    """A function from texts to tail probabilities, for tasks; only used weights are sent."""
    used = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.thresholds))

    def start():
        used, weights, thresholds = shared.value
        dense = np.zeros(DIMENSIONS)
        dense[used] = weights
        model = OrdinalModel(dense, thresholds)
        return lambda texts: model.tails(*features(texts), len(texts))

    return start


def scored(docs: DataFrame, model: OrdinalModel | None, keep: float = KEEP_PROBABILITY) -> DataFrame:
    """doc_id, expected_grade, tail probabilities and whether the document is selected."""
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select("doc_id", null.alias("expected_grade"), null.alias("p_good"), null.alias("p_clean"), F.lit(True).alias("keep"))
    start = _judge(model, docs.sparkSession)

    def run(batches):
        judge = start()
        for batch in batches:
            for part in chunks(batch, limit=BATCH_BYTES):
                tails = judge(part.column("text"))
                columns = map(pa.array, (tails.sum(axis=1), tails[:, 0], tails[:, 1], tails[:, 1] >= keep))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "expected_grade", "p_good", "p_clean", "keep"])

    return text_only(docs).mapInArrow(frugal(run), "doc_id long, expected_grade double, p_good double, p_clean double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, keep: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of ``docs`` that the classifier selects, with all their columns."""
    model = train(docs, labels)
    if model is None:
        return docs
    start = _judge(model, docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        judge = start()
        for batch in batches:
            for part in chunks(batch.rename_columns([f"c{k}" for k in range(batch.num_columns)]), f"c{at}", BATCH_BYTES):
                tails = judge(pc.fill_null(part.column(at), ""))
                yield part.filter(pa.array(tails[:, 1] >= keep)).rename_columns(batch.schema.names)

    shipped(docs.sparkSession)
    return docs.mapInArrow(frugal(run), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, read_table(spark, sf_dir, "labels")))
