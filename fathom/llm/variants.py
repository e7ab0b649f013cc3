"""Spelling variants of a corpus's words, found over a reduced alphabet.

Letters are hashed to a few symbols, which turns words into reduced words over
a small alphabet.  A word within one edit of another is, reduced, within one
edit of the other's reduced word, so the full one-edit neighbourhood of each
reduced word, joined with the reduced vocabulary, has every near pair; the pair
is then verified on the original strings.

A reduced word travels as a 64-bit polynomial of its symbols, of which all
neighbours follow from prefix sums.  Two reduced words with one polynomial only
make a pair that the verification drops.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ship, small_batches, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: log2 of the bits of the set that tells which reduced words there are (4 MB, whatever the vocabulary).
SET_BITS = 25
#: Distinct words that a task counts before it hands them on; words whose neighbours it has at a time.
MEMO = 200_000
CHUNK = 2_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def counted_words(docs: DataFrame, id_col: str, text_col: str, least_length: int, damage: int) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, ``least_length`` code points or longer.

    Where ``damage`` divides the crc32 of ``<id>:<run>``, the run has lost the
    code point at that number modulo its length; 0 damages none.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
            words.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Counter(RUN.findall(text.as_py().translate(LOWER)))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in found.items():
                    if damage and not (h := zlib.crc32(w.encode(), start)) % damage:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                    if len(w) >= least_length:
                        words[w] += n
                if len(words) > MEMO:
                    yield flush()
        if words:
            yield flush()

    rows = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols(words: list[str], k: int) -> np.ndarray:
    """Words of one length as rows of symbols 1 to ``k``, a hash of each letter."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    return ((letters * np.uint64(BASE) >> np.uint64(32)) % np.uint64(k) + np.uint64(1)).reshape(len(words), -1)


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(length, BASE, np.uint64)])


def _key(polynomial: np.ndarray) -> np.ndarray:
    x = (polynomial ^ (polynomial >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def reduced_keys(s: np.ndarray) -> np.ndarray:
    return _key(s @ _powers(s.shape[1])[:-1])


def neighbourhoods(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every reduced word within one edit of a row: each once,
    the row's own among them."""
    m, n = s.shape
    w = _powers(n)
    up = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(s * w[:n], axis=1, dtype=np.uint64)], axis=1)
    whole = up[:, -1:]
    rows, keys = [np.arange(m)], [whole[:, 0]]
    rest = whole - up  # of the symbols from a place on
    # A symbol deleted from a run of equal ones gives one word: its first stands for the run.
    first = np.c_[np.ones((m, 1), bool), s[:, 1:] != s[:, :-1]]
    r, c = np.nonzero(first)
    rows.append(r)
    keys.append((up[:, :-1] + rest[:, 1:] * np.uint64(INVERSE))[r, c])
    for x in range(1, k + 1):
        x = np.uint64(x)
        r, c = np.nonzero(s != x)
        rows.append(r)
        keys.append((whole + (x - s) * w[:n])[r, c])
        # A symbol inserted before one like it is the same as inserted after it.
        r, c = np.nonzero(np.c_[s != x, np.ones((m, 1), bool)])
        rows.append(r)
        keys.append((up + x * w + rest * np.uint64(BASE))[r, c])
    return np.concatenate(rows), _key(np.concatenate(keys))


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        # Neighbours of long words are many: the longer, the fewer at a time.
        step = max(1, CHUNK * 10 // int(n))
        for i in range(0, len(at), step):
            yield at[i:i + step]


def near_pairs(vocabulary: DataFrame, k: int = SYMBOLS) -> DataFrame:
    """(word, other, other_n): all ordered pairs of the vocabulary's (word, n) that differ by one inserted, deleted or replaced code point."""
    spark = vocabulary.sparkSession
    ship(spark)
    slots = 1 << SET_BITS

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            keys = np.zeros(len(words), np.uint64)
            for at in _by_length(words):
                keys[at] = reduced_keys(symbols([words[i] for i in at], k))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0), b.column(1)], ["key", "other", "other_n"])

    reduced = stored(vocabulary.select("word", "n").mapInArrow(reduce, "key long, other string, other_n long"), "variants-reduced")

    # Neighbours that no word reduces to go before they travel.  The set has a
    # fixed size: one bit a slot, 64 slots a row.
    parts = (reduced.selectExpr(f"(key & {slots - 1}) >> 6 AS at", "shiftleft(1L, cast(key & 63 AS int)) AS bit")
             .groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas())
    table = np.zeros(slots // 64, np.int64)
    table[parts["at"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64)
    there = spark.sparkContext.broadcast(table.view(np.uint64))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = there.value
        for b in batches:
            words = b.column(0).to_pylist()
            for at in _by_length(words):
                row, key = neighbourhoods(symbols([words[i] for i in at], k), k)
                place = key & np.uint64(slots - 1)
                found = (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[found].view(np.int64)), b.column(0).take(pa.array(at[row[found]]))], ["key", "word"])

    probes = vocabulary.select("word").mapInArrow(probe, "key long, word string")
    gap = F.abs(F.char_length("word") - F.char_length("other"))
    return (probes.join(reduced, "key").where((gap <= 1) & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
            .select("word", "other", "other_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5,
             ratio: int = 5, damage: int = 0, k: int = SYMBOLS) -> DataFrame:
    """One row a distinct word of the corpus: word, form, root, n, n_near, form_n.

    Words are lower-cased (A-Z only) runs of Latin letters, ``least_length`` code
    points or longer and ``least_n`` times in the corpus; n_near counts the words
    one edit away.  The form is the near word of largest n (ties: the smallest in
    code-point order) if it has ``ratio`` times the word's n, else null, as
    form_n.  The root is the last word on the way from form to form, the word
    itself without a form.  Null and empty texts and an empty table have no
    words; repeated rows and equal texts count each time; a null id counts as the
    text ''; other columns are ignored.
    """
    words = stored(counted_words(docs, id_col, text_col, least_length, damage).where(F.col("n") >= least_n), "variants-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words, k).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "variants-forms")
    # The n grows at each step, so the way ends; each round doubles the steps.
    links = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")), "variants-roots")
        if not links.where("moved").take(1):
            break
        links = links.select("word", "root")
    return (found.join(links.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
