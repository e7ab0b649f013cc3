"""Best-fit packing by linear grouping.

A piece is at most ``capacity`` tokens long, so the whole packing problem is a
histogram of at most ``capacity`` lengths, whatever the number of documents.
The driver solves that histogram (its work is bounded by the capacity, not by
the data): large lengths are rounded up within groups of equal cardinality,
full configurations of the few rounded sizes are chosen, the actual lengths
take the places of the rounded ones, and the small lengths go best-fit into
what is left.  The solution says for each length which ranks of it go to which
sequences; the tasks then place every piece by its rank among its length.
Ranks come from per-partition counts, so a length that a third of all pieces
share is never gathered.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import ship, stored, text_of

CAPACITY = 2048
#: Lengths above this share of the capacity are large.
LARGE = 1 / 16
#: Groups of equal cardinality that large lengths are rounded within.
GROUPS = 256
#: Words whose ids a task remembers (about 75 MB); past that it starts anew.
MEMO = 300_000
#: Marks that, behind letters, are a pre-token of their own.
MARKS = b".,;:!?*%$&#)\"|"
#: Texts whose new words are tokenized together.
TOGETHER = 64


def _letters(word: bytes) -> bool:
    """True if the word is letters only, also as the tokenizer normalises it."""
    return word.isalpha() or unicodedata.normalize("NFC", word.decode()).lower().isalpha()


class WordIds(dict):
    """Ids of a white-space delimited word as little-endian bytes, remembered.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order.  It also lower-cases and sets letters
    apart from marks behind them, so such words share an entry.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bytes_of = [i.to_bytes(4, "little") for i in range(len(self.ends))]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower() if word.isascii() else word
        stem = low.rstrip(MARKS)
        if stem and stem != low and _letters(stem):
            ids = self[stem] + self[low[len(stem):]]
        elif low != word:
            ids = self[low]
        else:
            ids = self._encode(word.decode()).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def learn(self, words: set[bytes]) -> None:
        """Tokenize the new words among ``words`` that are letters only: ASCII ones
        by the tokenizer's model itself, the others in one go.
        Each gives one pre-token, and only a pre-token's last id ends a word."""
        if len(self) + len(words) > MEMO:
            self.clear()
        new = {(w.lower() if w.isascii() else w).rstrip(MARKS) for w in words if w not in self}
        new = [w for w in new if w not in self and len(w) <= 64 and (w.isalpha() or not w.isascii())]
        texts = []
        for t in map(bytes.decode, new):
            if t.isascii():  # lower-case letters pass the steps before the model unchanged
                self[t.encode()] = b"".join([self.bytes_of[i.id] for i in self.model.tokenize(t)])
            elif t.isalpha():
                texts.append(t)
        if not texts:
            return
        ids = self._encode(" ".join(texts))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(texts):
            data, lo = ids.tobytes(), 0
            for t, hi in zip(texts, (cuts * 4).tolist(), strict=True):
                self[t.encode()] = data[lo:hi]
                lo = hi


_MEMOS: dict[int, WordIds] = {}


def _memo(definition: str) -> WordIds:
    key = zlib.crc32(definition.encode())
    if key not in _MEMOS:
        _MEMOS[key] = WordIds(definition)
    return _MEMOS[key]


def token_bytes(texts: list[bytes], memo: WordIds) -> Iterator[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers."""
    for lo in range(0, len(texts), TOGETHER):
        words = [t.split() for t in texts[lo:lo + TOGETHER]]
        memo.learn(set().union(*words))
        for w in words:
            yield b"".join(map(memo.__getitem__, w))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): every document's ids
    and ``end_id``, cut every ``capacity`` tokens; ``rank`` counts the pieces of
    a length within the partition ``part``.  ``with_ids`` adds the ids.
    ``tokenizer`` is the path of a tokenizer file, which the driver reads.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType
    fields = [("doc_id", id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
              ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType())]
    fields += [("ids", T.BinaryType())] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, seen = _memo(definition.value), TaskContext.get().partitionId(), Counter()
        for b in batches:
            at, cols = [], [[] for _ in fields[1:]]
            for i, ids in enumerate(token_bytes(b.column(1).to_pylist(), memo)):
                ids += end
                for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[lo:lo + 4 * capacity]
                    n = len(cut) // 4
                    at.append(i)
                    for col, v in zip(cols, (piece, lo // 4, n, zlib.crc32(cut), part, seen[n], cut), strict=False):
                        col.append(v)
                    seen[n] += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())),
                                              *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], [f for f, _ in fields])
        memo.clear()  # the worker goes on to other tasks; it keeps the tokenizer only

    schema = T.StructType([T.StructField(*f) for f in fields])
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def _configuration(sizes: list[int], left: dict[int, int], first: int, room: int) -> Counter:
    """The multiset of rounded sizes with ``first`` in it that fills ``room`` the most,
    with the large ones preferred; no more of a size than are left."""
    use, room = Counter({first: 1}), room - first
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by, n_of = np.full(room + 1, -1), np.zeros(room + 1, np.int64)
    for i, s in enumerate(sizes):
        have = left[s] - (s == first)
        if s > room or have <= 0:
            continue
        for k in range(1, min(have, room // s) + 1):
            new = np.zeros_like(reach)
            new[s * k:] = reach[:room + 1 - s * k] & (by[:room + 1 - s * k] != i)
            new &= ~reach
            by[new], n_of[new] = i, k
            reach |= new
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        s, k = sizes[by[at]], int(n_of[at])
        use[s] += k
        at -= s * k
    return use


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number, first sequence, pieces a sequence, offset): the
    next ``number`` pieces of a length fill consecutive sequences from the first
    one on, so many each, from this offset.  Sequences number from 0."""
    counts = {x: n for x, n in histogram.items() if n}
    taken: Counter = Counter()
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins: list[tuple[int, int, int]] = []  # room, first sequence, number
    made = 0

    def place(length: int, number: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, taken[length], number, sequence, each, offset))
        taken[length] += number

    # Round up within groups of equal cardinality: a group's size is its longest length.
    big = sorted((x for x in counts if x > large * capacity), reverse=True)
    total, seen, group, size = sum(counts[x] for x in big), 0, -1, 0
    stock: dict[int, list[list[int]]] = {}  # rounded size: [length, pieces], longest first
    for x in big:
        rest = counts[x]
        while rest:  # a common length spans groups
            g = seen * groups // total
            if g != group:
                group, size = g, x
            n = min(rest, -(-(g + 1) * total // groups) - seen)
            stock.setdefault(size, []).append([x, n])
            seen, rest = seen + n, rest - n

    # Few-size configurations, each used as often as the sizes last.
    left = {s: sum(n for _, n in v) for s, v in stock.items()}
    sizes = sorted(stock, reverse=True)
    for s in sizes:
        while left[s]:
            use = _configuration(sizes, left, s, capacity)
            times = min(left[x] // k for x, k in use.items())
            places = [x for x in sorted(use, reverse=True) for _ in range(use[x])]
            for x, k in use.items():
                left[x] -= k * times
            while times:  # actual lengths take the places: as many sequences alike as every place allows
                alike = min(times, *(max(1, stock[x][0][1] // k) for x, k in use.items()))
                offset = 0
                for x in places:
                    head = stock[x][0]
                    place(head[0], alike, made, 1, offset)
                    offset += head[0]
                    head[1] -= alike
                    if not head[1]:
                        stock[x].pop(0)
                bins.append((capacity - offset, made, alike))
                made += alike
                times -= alike

    # Small lengths best-fit: the least room that takes the length; the sequence stays the best until it is full.
    rooms: dict[int, list[tuple[int, int]]] = {}
    for room, sequence, number in bins:
        rooms.setdefault(room, []).append((sequence, number))
    for x in sorted((x for x in counts if x <= large * capacity), reverse=True):
        rest = counts[x]
        while rest:
            room = min((r for r in rooms if r >= x), default=0)
            if not room:
                room, number = capacity, max(1, rest // (capacity // x))
                rooms[room] = [(made, number)]
                made += number
            sequence, number = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = min(room // x, rest)
            used = min(number, rest // each)
            place(x, used * each, sequence, each, capacity - room)
            if used < number:
                rooms.setdefault(room, []).append((sequence + used, number - used))
            rooms.setdefault(room - each * x, []).append((sequence, used))
            rest -= used * each
    return runs


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id,
    offset, and with ``with_ids`` the ids (little-endian unsigned 32-bit).

    Null and empty texts are the end id alone.  Repeated rows and rows without
    an id are documents of their own.  An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces")
    counts = stored(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, number long, sequence long, each long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    runs = runs.withColumnRenamed("length", "run_length")
    # The runs number a few times the capacity at most, whatever the input.
    out = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo"))
                      & (F.col("rank") < F.col("lo") + F.col("number")))
    nth = F.col("rank") - F.col("lo")
    return out.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from pieces with ids.
    A group is one sequence, so at most its capacity."""
    whole = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_join(F.transform(whole, lambda x: F.hex(x["ids"])), "").alias("ids")).withColumn("ids", F.unhex("ids"))
