"""Toxic passages as maximum-scoring segments.

A token's score is its log-odds between toxic and clean labelled texts under a
Dirichlet prior, less a toll that makes a clean text's mean score negative.  One
linear scan (Ruzzo and Tompa) finds every maximal segment of a text.  In clean
texts the segments' scores follow an extreme-value law: the number of segments
of score S or more in n tokens is K n exp(-lambda S).  lambda solves
E[exp(lambda s)] = 1 over clean tokens, K is counted on clean texts, and a
passage is significant when its expected number is small.  A text's statistic
sums -log of these numbers over its segments; a logistic curve takes it to a
probability.  lambda, K and the curve are fitted on training texts scored by
models that have not seen them (inner folds).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import fresh, ship, small_batches, small_side, stored, training_fold

WORD = re.compile(r"[^\W\d_]+")
#: log2 of the hashed token buckets; the model has so many numbers, whatever the corpus.
BUCKET_BITS = 18
INNER = 2
#: Strength of the Dirichlet prior in texts, shared between the classes in proportion to their sizes.
PRIOR = 4.0
#: What each token costs a segment.
TOLL = 1.5
#: A passage is significant when fewer are expected in a clean text of this length.
SIGNIFICANT = 0.05
#: Scaled score from which segments of clean texts are counted for K.
COUNTED_FROM = 1.0
#: The statistic in steps of 0.1 within these bounds is all that the curve's fit reads.
LOWEST, HIGHEST = -20.0, 60.0
#: Words whose scores or buckets a Python worker remembers.
MEMO = 200_000
SEGMENTS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("strength", T.DoubleType())]))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last + 1, sum) of all maximal scoring segments, in order, in linear time.

    ``back[i]`` is the nearest earlier candidate that starts at a lower running
    sum than candidate i; what lies between needs no further look.
    """
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []
    for t in np.flatnonzero(score > 0).tolist():
        start, a, b = t, float(total[t]), float(total[t + 1])
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= a:
                j = back[j]
            if j < 0 or high[j] >= b:
                break
            start, a = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:]
            j = back[j]
            del back[len(low):]
        first.append(start)
        last.append(t + 1)
        low.append(a)
        high.append(b)
        back.append(j)
    return [(i, k, b - a) for i, k, a, b in zip(first, last, low, high, strict=True)]


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & ((1 << BUCKET_BITS) - 1)


@dataclass
class Model:
    """``tables[f]``: token scores learned without inner fold f, the last from
    all folds; ``scale``: lambda; ``rate``: log K; ``curve``: of the probability."""
    tables: np.ndarray
    scale: float
    rate: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int) -> DataFrame:
    """(toxic, fold, text): the labelled rows outside fold 0.  Several labels of
    one id count as their majority, toxic where they are even."""
    ids = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~training_fold(id_col, folds, 0)).groupBy(id_col)
           .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).alias("toxic")).select(F.col(id_col).alias("id"), "toxic"))
    ids = stored(ids, "toxicity-labels")
    inner = F.floor(F.crc32(F.col("id").cast("string").cast("binary")) / folds) % INNER
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return stored(texts.join(small_side(ids, ids.count()), "id").select("toxic", inner.cast("int").alias("fold"), "text"), "toxicity-training")


def _counts(training: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a token that are toxic, that are clean, and occurrences in clean
    texts, by inner fold and bucket; sums over all training rows."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, INNER, size), np.int64)
        memo: dict[str, int] = {}
        for b in batches:
            for toxic, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if len(memo) > MEMO:
                    memo.clear()
                at = []
                for w in WORD.findall(text.as_py()):
                    if (k := memo.get(w)) is None:
                        k = memo[w] = _bucket(w)
                    at.append(k)
                where, n = np.unique(np.array(at, np.int64), return_counts=True)
                sums[0 if toxic else 1, fold, where] += 1
                if not toxic:
                    sums[2, fold, where] += n
        fold, bucket = np.nonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(bucket.astype(np.int32)), *[pa.array(sums[i, fold, bucket]) for i in range(3)]],
                                         ["fold", "bucket", "toxic", "clean", "tokens"])

    ship(training.sparkSession)
    small_batches(training.sparkSession)
    rows = (training.mapInArrow(count, "fold int, bucket int, toxic long, clean long, tokens long")
            .groupBy("fold", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("tokens").alias("tokens")).toArrow())
    out = np.zeros((3, INNER, size), np.float32)
    for b in rows.to_batches():
        fold, bucket, *values = [c.to_numpy() for c in b.columns]
        for i, v in enumerate(values):
            out[i, fold, bucket] = v
    return out[0], out[1], out[2]


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds of a token against those of all tokens, zero without evidence."""
    t, c = float(toxic.sum(dtype=np.float64)), float(clean.sum(dtype=np.float64))
    if not t or not c:
        return np.zeros(toxic.shape)
    return np.log((toxic + PRIOR * t / (t + c)) / (clean + PRIOR * c / (t + c))) - np.log(t / c)


def decay(score: np.ndarray, n: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda score) = 1 over ``n`` tokens a score; 1
    where there is none as no score, or all on the mean, is above zero."""
    use = n > 0
    score, n = score[use].astype(float), n[use].astype(float)
    n /= max(n.sum(), 1)
    if not len(score) or score.max() <= 0 or score @ n >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while n @ np.exp(high * score) < 1:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if n @ np.exp(mid * score) < 1 else (low, mid)
    return (low + high) / 2


def _scan(rows: DataFrame, carry: list[str], fold: str | None, text: str, model: Model) -> DataFrame:
    """Columns ``carry`` of ``rows`` with their number of tokens and maximal
    segments: code points from start to end, strength lambda S.  ``fold`` picks
    the table of a row, without it the last holds."""
    spark = rows.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.tables, model.scale))
    kept = rows.select(*[F.col(f"`{c}`") for c in carry])
    added = fresh(kept, "n_tokens", "segments", "row_text", "row_fold")
    schema = T.StructType([*kept.schema.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], SEGMENTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, scale = shared.value
        memos: list[dict[str, float]] = [{} for _ in tables]
        for b in batches:
            counts, found = [], []
            for text, at in zip(b.column(len(carry)), b.column(len(carry) + 1).to_pylist(), strict=True):
                words = WORD.findall(text.as_py())
                table, memo = tables[at], memos[at]
                if len(memo) > MEMO:
                    memo.clear()
                score = []
                for w in words:
                    if (s := memo.get(w)) is None:
                        s = memo[w] = float(table[_bucket(w)])
                    score.append(s)
                counts.append(len(words))
                values = np.array(score)
                parts = maximal_segments(values) if len(values) and values.max() > 0 else []
                if parts:
                    place = [m.span() for m in WORD.finditer(text.as_py())]
                    parts = [{"start": place[i][0], "end": place[k - 1][1], "strength": scale * s} for i, k, s in parts]
                found.append(parts)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(carry)], pa.array(counts, pa.int64()),
                                              pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("strength", pa.float64())])))], schema.names)

    which = F.lit(len(model.tables) - 1) if fold is None else F.col(f"`{fold}`")
    texts = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return (rows.select(*[F.col(f"`{c}`") for c in carry], texts.alias(added[2]), which.cast("int").alias(added[3]))
            .mapInArrow(run, schema))


def _surprise(strength: Column, n: Column, rate: float) -> Column:
    """-log of the number of such segments expected in a clean text of n tokens."""
    return strength - rate - F.log(n + 1.0)


def _statistic(n: Column, segments: Column, rate: float) -> Column:
    """Sum over the segments that fewer than one are expected of, else the largest of the others, zero at most."""
    sums = F.aggregate(segments, F.lit(0.0), lambda a, x: a + F.greatest(_surprise(x["strength"], n, rate), F.lit(0.0)))
    most = _surprise(F.coalesce(F.array_max(F.transform(segments, lambda x: x["strength"])), F.lit(0.0)), n, rate)
    return F.least(F.greatest(F.when(sums > 0, sums).otherwise(F.least(most, F.lit(0.0))), F.lit(LOWEST)), F.lit(HIGHEST))


def logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the probability of toxic over x, by Newton steps with a weak pull to a flat curve."""
    n, k = toxic + clean, toxic.sum() / max(1.0, (toxic + clean).sum())
    k = min(max(k, 1e-3), 1 - 1e-3)
    beta = np.array([np.log(k / (1 - k)), 0.0])
    if not toxic.sum() or not clean.sum():
        return float(beta[0]), 0.0
    design = np.c_[np.ones(len(x)), x]

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(n @ np.logaddexp(0, z) - toxic @ z + 0.05 * (b @ b))

    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (toxic - n * p) - 0.1 * beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model:
    """The model of all labelled rows outside fold 0; what reaches the driver is
    buckets x inner folds and a histogram, whatever the corpus."""
    training = _labelled(docs, labels, id_col, text_col, label_col, folds)
    toxic, clean, tokens = _counts(training)
    parts = [(toxic.sum(axis=0) - toxic[f], clean.sum(axis=0) - clean[f]) for f in range(INNER)] + [(toxic.sum(axis=0), clean.sum(axis=0))]
    tables = np.stack([log_odds(t, c) - TOLL for t, c in parts]).astype(np.float32)
    model = Model(tables, decay(tables[:INNER].ravel(), tokens.ravel()))
    seen = stored(_scan(training, ["toxic"], "fold", "text", model), "toxicity-segments")
    count, length = (seen.where(~F.col("toxic")).agg(
        F.sum(F.size(F.filter("segments", lambda x: x["strength"] >= COUNTED_FROM))), F.sum(F.col("n_tokens") + 1)).first())
    model.rate = float(np.log((count or 0) + 0.5) + COUNTED_FROM - np.log((length or 0) + 1.0))
    step = F.round(_statistic(F.col("n_tokens"), F.col("segments"), model.rate), 1).alias("x")
    bins = seen.select("toxic", step).groupBy("x").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).toPandas()
    model.curve = logistic(bins["x"].to_numpy(float), bins["toxic"].to_numpy(float), bins["clean"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score (0 to 1, the probability of
    toxic), predicted (score >= 0.5), n_tokens and passages (start, end, strength,
    expected), the significant ones in order.

    Null and empty texts have no token and no passage; they get the score of the
    least evidence there is.  Repeated rows each get a row, equal texts equal
    scores.  Without labels of both classes no passage is found and every score
    is the labels' share of toxic, 0.001 at least and 0.999 at most (0.001
    without any label).  An empty table gives an empty result; columns other
    than the id are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n, segments = F.col("n_tokens"), F.col("segments")
    a, b = model.curve
    p = 1 / (1 + F.exp(-(a + b * _statistic(n, segments, model.rate))))
    expected = F.transform(segments, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["strength"].alias("strength"),
                                                        F.exp(-_surprise(x["strength"], n, model.rate)).alias("expected")))
    return (_scan(rows, ["id"], None, "text", model)
            .select(F.col("id").alias(id_col), p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted"), n.alias("n_tokens"),
                    F.filter(expected, lambda x: x["expected"] <= SIGNIFICANT).alias("passages")))
