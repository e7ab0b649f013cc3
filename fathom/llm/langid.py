"""Language identification as a mixture of languages.

Training sums character trigram counts of all labelled training texts into a
fixed number of hashed buckets per language.  A document's words are then
emissions of a mixture: expectation-maximisation estimates the proportions of
a set of languages from the trigram likelihoods, and the set grows by one
language at a time as long as the likelihood gains more than a penalty.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import fresh, ship, small_batches, training_fold

WORD = re.compile(r"[^\W\d_]+")
#: log2 of the hashed trigram buckets; the model has so many numbers a language (256 kB), whatever the corpus.
BUCKET_BITS = 16
SMOOTHING = 0.5
#: Log likelihood that a further language has to gain, a log of the word count.
PENALTY = 3.0
#: How far a trigram's mean log likelihood may lie below that of the languages' own training texts.
LEAST_FIT = -4.0
ROUNDS = 30
#: Words whose likelihoods a Python worker remembers; words counted before they are summed into buckets.
MEMO = 100_000


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter of the words, blanks beside them included; index of each word's first letter."""
    chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    mid = np.flatnonzero(chars[1:-1] != 32) + 1
    h = (chars[mid - 1] * np.uint64(0x9E3779B97F4A7C15) + chars[mid]) * np.uint64(0xC2B2AE3D27D4EB4F) + chars[mid + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    first = np.cumsum([0, *[len(w) for w in words[:-1]]])
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), first


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, the log probabilities of their trigram buckets and their means over the training texts.
    Counts come from every row; what reaches the driver is languages x buckets."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, np.int64))
        words: dict[str, Counter] = defaultdict(Counter)

        def flush() -> None:
            for lang, c in words.items():
                if c:
                    bucket, first = trigrams(list(c))
                    n = np.diff(np.r_[first, len(bucket)])
                    sums[lang] += np.bincount(bucket, np.repeat(np.fromiter(c.values(), np.int64, len(c)), n), 1 << BUCKET_BITS).astype(np.int64)
            words.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                words[lang.as_py()].update(WORD.findall(text.as_py().lower()))
            if sum(map(len, words.values())) > MEMO:
                flush()
        flush()
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((1 << BUCKET_BITS, len(langs)))
    table[counts["bucket"], [langs.index(x) for x in counts["lang"]]] = counts["n"]
    logs = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (1 << BUCKET_BITS)))
    return langs, logs, (table * logs).sum(axis=0) / np.maximum(table.sum(axis=0), 1)


def mixture(ll: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Proportions of the languages, the probability of the set's best one and
    the set's log likelihood, from log likelihoods (distinct words x languages) and word counts."""
    single = n @ ll
    best = int(np.argmax(single))
    chosen, value, share = [best], float(single[best]), np.ones(1)
    bound = float(n @ ll.max(axis=1))  # no mixture is likelier
    need = PENALTY * np.log(n.sum() + 1.0)
    sure = float(1 / np.exp(np.clip(single - single[best], -700, 0)).sum())
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    while bound - value > need and len(chosen) < ll.shape[1]:
        tried = []
        for x in range(ll.shape[1]):
            if x in chosen:
                continue
            cols = [*chosen, x]
            q, theta = p[:, cols], np.append(share * 0.9, 0.1)
            for _ in range(ROUNDS):  # expectation, maximisation
                r = q * theta
                new = n @ (r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)) / n.sum()
                done = np.abs(new - theta).max() < 1e-4
                theta = new
                if done:
                    break
            tried.append((float(n @ (np.log(np.maximum(q @ theta, 1e-300)) + top[:, 0])), -x, cols, theta))
        gain = max(tried)
        if gain[0] - value <= need:
            break
        value, _, chosen, share = gain
    out = np.zeros(ll.shape[1])
    out[chosen] = share
    return out, sure if len(chosen) == 1 else 1.0, value


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], carry: list[str], text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its columns ``carry`` and lang_pred,
    score, proportions, fit (named otherwise where ``carry`` has that name).

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned.  The score is the predicted language's proportion, for a
    single language its probability against the others.  The fit is the mean log
    likelihood of a trigram in the whole set of languages, less that of their
    training texts; null where ``und``.  Ties go to the first
    language in code-point order.  Repeated rows each get a row.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model[0], model[1].astype(np.float32), model[2]))
    rows = docs.select(*[F.col(f"`{c}`") for c in carry])
    added = fresh(rows, "lang_pred", "score", "proportions", "fit", "text_read")
    kinds = [T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType()), T.DoubleType()]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=False)]])
    # A carried text travels once.
    carried = text_col in carry and isinstance(rows.schema[text_col].dataType, T.StringType)
    at_text = carry.index(text_col) if carried else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, usual = shared.value
        memo: dict[str, int] = {}
        known = np.zeros((0, len(langs)), np.float32)
        for b in batches:
            preds, scores, shares, fits = [], [], [], []
            for text in b.column(at_text):
                words = WORD.findall(text.as_py().lower()) if text.is_valid and langs else []
                c = Counter(words)
                for w in [w for w in c if not any(map(str.isalpha, w))]:
                    del c[w]
                if not c:
                    preds.append("und")
                    scores.append(0.0)
                    shares.append([])
                    fits.append(None)
                    continue
                new = [w for w in c if w not in memo]
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    known, new = known[:0], list(c)
                if new:
                    bucket, first = trigrams(new)
                    at = len(memo)
                    memo.update(zip(new, range(at, at + len(new)), strict=True))
                    if at + len(new) > len(known):
                        known = np.concatenate([known[:at], np.zeros((max(len(new), at, 1024), len(langs)), np.float32)])
                    known[at:at + len(new)] = np.add.reduceat(table[bucket], first)
                ll = known[np.fromiter(map(memo.__getitem__, c), np.int64, len(c))].astype(float)
                n = np.fromiter(c.values(), float, len(c))
                theta, sure, value = mixture(ll, n)
                fits.append(float(value / (n @ np.fromiter(map(len, c), float, len(c))) - theta @ usual))
                best = int(np.argmax(theta))
                preds.append(langs[best])
                scores.append(min(1.0, float(theta[best]) * sure))
                shares.append([(langs[i], float(theta[i])) for i in np.flatnonzero(theta)])
            yield pa.RecordBatch.from_arrays([*b.columns[:len(carry)], pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(shares, pa.map_(pa.string(), pa.float64())), pa.array(fits, pa.float64())], schema.names)

    text = [] if carried else [F.col(text_col).cast("string").alias(added[4])]
    return docs.select(*[F.col(f"`{c}`") for c in carry], *text).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """:func:`predict` for all rows with a model learned from the rows with a
    language outside fold 0; adds held_out (the row is in fold 0)."""
    held = training_fold(id_col, folds, 0)
    out = predict(docs, train(docs.where(~held), text_col, lang_col), [id_col], text_col)
    return out.withColumn("held_out", held)


def keep_identified(docs: DataFrame, least: float = LEAST_FIT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """The rows of ``docs`` whose text is in identified languages, in however many:
    not ``und``, and the fit of all of them is at least ``least``; all their columns."""
    model = train(docs.where(~training_fold(id_col, folds, 0)), text_col, lang_col)
    out = predict(docs, model, docs.columns, text_col)
    lang, _, _, fit = out.columns[len(docs.columns):len(docs.columns) + 4]
    return out.where((F.col(lang) != "und") & (F.col(fit) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
