"""Language-model scoring by partial matching (PPM).

A byte-context trie of fixed order is learned from the training texts: counts
of every byte after every context of up to ``ORDER`` bytes.  A byte's
probability comes from the longest known context that has seen it; each longer
one is escaped: every distinct successor gives half a count to the escape.
Symbols that an escaped context has seen are excluded from the shorter ones.

Texts are dealt out to buckets of bounded size.  A bucket asks for the distinct
successions and words of its own texts only, so the model is never held whole
anywhere: the trie is summed and solved per hash of the last two context bytes,
and each bucket gets back the log probabilities of what it asked for.  Every
step streams: a task holds the distinct keys of one bucket or one part, never
its texts or all requests.  Orders 1 and 0 (at most 65,792 counts) are the only
part that every task has.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import ship, small_batches, stored, text_of, training_fold

#: Context bytes; a succession (contexts and the byte after them) takes 8 bits more than these.
ORDER = 5
#: Bytes that no UTF-8 text has: before a text's first byte, after its last.
START, END = 0xFE, 0xFF
#: Bytes of text in a bucket on average, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 12
#: Parts of the model: one for so many bytes of text, between these numbers.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 32 << 20, 24, 4096
#: Successions counted at once.
STEP = 1 << 21
#: Rows of a request, of the model and of an answer: packed keys of one bucket and one part.
CODES, WORDS = 0, 1


def _slices(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Slices of the texts, ``ORDER`` bytes of context before each, about ``STEP`` bytes at once; the place of each slice's text."""
    places, held, size = [], [], 0
    for i, t in enumerate(texts):
        t = b"".join((bytes([START]) * ORDER, t, bytes([END])))
        for at in range(0, len(t) - ORDER, STEP):
            places.append(i)
            held.append(t[at:at + STEP + ORDER])
            size += len(held[-1])
            if size >= STEP:
                yield places, held
                places, held, size = [], [], 0
    if held:
        yield places, held


def successions(slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``ORDER`` context bytes and the byte after them for all places of the slices; the first of each."""
    a = np.frombuffer(b"".join(slices), np.uint8)
    code = np.zeros(max(len(a) - ORDER, 0), np.int64)
    for j in range(ORDER + 1):
        code = (code << 8) | a[j:j + len(code)]
    size = np.array([len(x) for x in slices], np.int64)
    start, length = np.cumsum(size) - size, size - ORDER
    across = np.concatenate([np.arange(x, x + ORDER) for x in start[1:] - ORDER]) if len(slices) > 1 else np.zeros(0, np.int64)
    keep = np.ones(len(code), bool)
    keep[across] = False
    return code[keep], np.cumsum(length) - length


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of ascending runs, ascending, and the sums of their counts."""
    code, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(code), 1), bool), code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count[order], first) if len(first) else count


class _Sums:
    """Counts of successions, merged as they come."""

    def __init__(self) -> None:
        self.parts, self.pending = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add(self, code: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((code, count))
        self.pending += len(code)
        if self.pending > max(STEP, len(self.parts[0][0])):
            self.parts, self.pending = [_merged(self.parts)], 0

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.parts)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _pack_codes(code: np.ndarray) -> bytes:
    # Ascending codes as differences, equal bytes of all together.
    return _pack(np.ascontiguousarray(np.diff(code, prepend=0).view(np.uint8).reshape(-1, 8).T))


def _unpack_codes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpack(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


class _Table:
    """Values by distinct codes: a hash table with linear probing, looked up many at a time."""

    def __init__(self, code: np.ndarray, value: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(code)).bit_length())
        self.code, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot = self._slot(code)
        while len(code):
            free = self.code[slot] < 0
            self.code[slot[free]] = code[free]  # of several that want a slot one gets it
            placed = self.code[slot] == code
            self.value[slot[placed]] = value[placed]
            code, value, slot = code[~placed], value[~placed], (slot[~placed] + 1) & (len(self.code) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, code: np.ndarray) -> np.ndarray:
        """Values of codes that are all there."""
        slot = self._slot(code)
        wrong = np.flatnonzero(self.code[slot] != code)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.code) - 1)
            wrong = wrong[self.code[slot[wrong]] != code[wrong]]
        return self.value[slot]


def _part(code: np.ndarray, parts: int) -> np.ndarray:
    """Part of a succession, by its last two context bytes."""
    return (((code >> 8) & 0xFFFF) * 40503 & 0xFFFFF) % parts


def _nodes(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of distinct successions, the sum of their counts and the number of their successors."""
    ctx, back = np.unique(code >> 8, return_inverse=True)
    return ctx, np.bincount(back, count, len(ctx)), np.bincount(back, minlength=len(ctx)).astype(float)


def _at(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


class Solver:
    """log10 probabilities of successions by the trie of one part: its distinct
    successions, ascending, and their training counts, complete for the last two
    context bytes that occur; ``pairs``: all successions of order 1 and their counts."""

    def __init__(self, code: np.ndarray, count: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> None:
        self.levels: dict[int, tuple] = {}
        for j in range(ORDER, -1, -1):
            if j == ORDER:
                g, c = code, count.astype(float)
            elif j >= 2:
                g, back = np.unique(code & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
                c = np.bincount(back, count, len(g))
            elif j == 1:
                g, c = pairs[0], pairs[1].astype(float)
            else:
                g, back = np.unique(pairs[0] & 0xFF, return_inverse=True)
                c = np.bincount(back, pairs[1], len(g))
            self.levels[j] = (g, c, *_nodes(g, c))
        self.excluded: dict[int, np.ndarray] = {}  # by context of order j + 1: counts at order j of the symbols it has seen
        for j in range(ORDER):
            g, c = self.levels[j][:2]
            up, ctx = self.levels[j + 1][0], self.levels[j + 1][2]
            i, there = _at(g, up & ((1 << 8 * (j + 1)) - 1))
            self.excluded[j] = np.bincount(np.searchsorted(ctx, up >> 8), np.where(there, c[i] if len(c) else 0.0, 0.0), len(ctx))

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each succession; those that training has not seen have one too."""
        levels, excluded = self.levels, self.excluded
        out = np.zeros(len(code))
        open_ = np.arange(len(code))
        prev = np.full(len(code), -1)  # place of the escaped context among those one order up
        for j in range(ORDER, -1, -1):
            g, c, ctx, total, kinds = levels[j]
            x = code[open_] & ((1 << 8 * (j + 1)) - 1)
            i, known = _at(ctx, x >> 8)
            t, d = (total[i], kinds[i]) if len(ctx) else (np.zeros(len(x)), np.zeros(len(x)))
            if j < ORDER:
                was, up = prev >= 0, np.maximum(prev, 0)
                if len(levels[j + 1][2]):
                    t = t - np.where(was, excluded[j][up], 0.0)
                    d = d - np.where(was, levels[j + 1][4][up], 0.0)
            k, seen = _at(g, x)
            seen &= known
            hit = seen & (t > 0)
            out[open_[hit]] += np.log10((c[k[hit]] - 0.5) / t[hit])
            escape = known & ~hit & (t > 0)
            out[open_[escape]] += np.log10(0.5 * d[escape] / t[escape])
            prev = np.where(known, i, -1)[~hit]
            open_ = open_[~hit]
        out[open_] += -np.log10(max(1.0, 256.0 - len(levels[0][0])))  # order -1: even over the symbols not yet excluded
        return out


def _columns(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in b.columns], strict=True)


def _requests(parts: int):
    """Batches of (bucket, text, held) ordered by bucket to a bucket's packed keys and training counts by part."""

    def rows(bucket: int, sums: _Sums, learned: Counter, words: set) -> Iterator[tuple]:
        code, count = sums.get()
        part = _part(code, parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            take = order[edges[p]:edges[p + 1]]
            if len(take):
                yield p, bucket, CODES, _pack_codes(code[take]), _pack(count[take])
        dealt = defaultdict(list)
        for w in sorted(words | learned.keys()):
            dealt[zlib.crc32(w) % parts].append(w)
        for p, found in dealt.items():
            yield p, bucket, WORDS, zlib.compress(b"\n".join(found), 1), _pack(np.array([learned[w] for w in found], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "bucket", "kind", "keys", "counts"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def batch(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for row in found:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        now, state = None, None
        for b in batches:
            of = b.column(0).to_numpy()
            for bucket in dict.fromkeys(of.tolist()):
                if bucket != now:
                    if state is not None:
                        yield from batch(rows(now, *state))
                    now, state = bucket, (_Sums(), Counter(), set())
                sums, learned, words = state
                rows_of = pa.table({"text": b.column(1), "held": b.column(2)}).filter(pa.array(of == bucket))
                texts, test = rows_of["text"].to_pylist(), rows_of["held"].to_pylist()
                for t, h in zip(texts, test, strict=True):
                    (words if h else learned).update(t.lower().split())
                for kind in (False, True):
                    for _, held in _slices([t for t, h in zip(texts, test, strict=True) if h is kind]):
                        u, n = np.unique(successions(held)[0], return_counts=True)
                        sums.add(u, np.zeros_like(n) if kind else n)
        if state is not None:
            yield from batch(rows(now, *state))

    return run


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (part, kind, keys, counts) ordered by the first two to a row for
    each: its distinct keys that training has seen, their counts, the sum and number of them, counts of order 1."""
    pairs_type = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
    names = ["part", "kind", "keys", "counts", "total", "kinds", "pairs"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pairs_type]

    def done(group: tuple, state: _Sums | Counter) -> pa.RecordBatch:
        pairs = []
        if group[1] == CODES:
            code, count = state.get()
            code, count = code[count > 0], count[count > 0]
            keys = _pack_codes(code)
            u, back = np.unique(code & 0xFFFF, return_inverse=True)
            pairs = [{"pair": p, "n": n} for p, n in zip(u.tolist(), np.bincount(back, count, len(u)).astype(np.int64).tolist(), strict=True)]
        else:
            found = sorted(w for w, n in state.items() if n)
            keys, count = zlib.compress(b"\n".join(found), 1), np.array([state[w] for w in found], np.int64)
        row = (*group, keys, _pack(count), int(count.sum()), len(count), pairs)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    now, state = None, None
    for b in batches:
        for part, kind, keys, counts in _columns(b):
            if (part, kind) != now:
                if now is not None:
                    yield done(now, state)
                now, state = (part, kind), _Sums() if kind == CODES else Counter()
            if kind == CODES:
                state.add(_unpack_codes(keys), _unpack(counts))
            else:
                for w, n in zip(zlib.decompress(keys).split(b"\n"), _unpack(counts).tolist(), strict=True):
                    state[w] += n
    if now is not None:
        yield done(now, state)


def _answers(pairs):
    """Batches of (part, kind, bucket, keys, counts) ordered by the first three, the
    model's row (no bucket) first, to the answers: codes with their log10
    probability; known words with their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, None
        for b in batches:
            for part, kind, bucket, keys, counts in _columns(b):
                if bucket is None:
                    now = (part, kind)
                    n = _unpack(counts)
                    model = (_unpack_codes(keys), n) if kind == CODES else dict(zip(zlib.decompress(keys).split(b"\n") if len(n) else [], n.tolist(), strict=True))
                    if kind == CODES:
                        model = (*model, Solver(*model, pairs.value))
                    continue
                assert now == (part, kind)
                if kind == CODES:
                    code = _unpack_codes(keys)
                    values = _pack(model[2].log10(code))
                else:
                    known = [w for w in zlib.decompress(keys).split(b"\n") if w in model]
                    keys, values = zlib.compress(b"\n".join(known), 1), _pack(np.array([model[w] for w in known], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([keys], pa.binary()), pa.array([values], pa.binary())],
                                                 ["bucket", "kind", "keys", "vals"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """One row for each row of ``docs``: id, held_out (in ``fold``), n_tokens,
    n_known, train_tokens, base_score, score.

    Learns from all rows outside ``fold``.  A null text counts as empty: its
    end alone.  Without training rows words are unknown and bytes equally
    likely.  Repeated rows each count and each get a row; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    held = training_fold(id_col, folds, fold)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-size // PART_BYTES)))
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"), held.alias("held"))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    asked = base.select("bucket", "text", "held").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    asked = stored(asked.mapInArrow(_requests(parts), "part int, bucket int, kind int, keys binary, counts binary"), "ppm-requests")
    # A task streams the requests of its parts in order, so it holds the distinct keys of one part.
    sums = asked.select("part", "kind", "keys", "counts").repartition(parts, "part", "kind").sortWithinPartitions("part", "kind")
    sums = stored(sums.mapInArrow(_sum_parts, "part int, kind int, keys binary, counts binary, total long, kinds long, pairs array<struct<pair: long, n: long>>"), "ppm-sums")
    known = sums.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = base.where(~F.col("held")).count()
    n_train, kinds = known[0] + ends, known[1] + (ends > 0)
    pairs = sorted(tuple(r) for r in sums.select(F.explode("pairs").alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n")).collect())  # at most 65,536
    shared = spark.sparkContext.broadcast((np.array([x for x, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64)))
    rows = sums.select("part", "kind", F.lit(None).cast("int").alias("bucket"), "keys", "counts").unionByName(asked)
    rows = rows.select("part", "kind", "bucket", "keys", "counts").repartition(parts, "part", "kind").sortWithinPartitions("part", "kind", F.col("bucket").asc_nulls_first())
    answers = rows.mapInArrow(_answers(shared), "bucket int, kind int, keys binary, vals binary")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    floor = n_train + 0.5 * (kinds + 1)
    unknown, of_end = math.log10(0.5 / floor), math.log10((ends + 0.5) / floor)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, table, chance = None, None, None, None
        for b in batches:
            buckets_of = b.column(0).to_numpy()
            for bucket in dict.fromkeys(buckets_of.tolist()):
                of = pa.Table.from_batches([b]).filter(pa.array(buckets_of == bucket))
                if bucket != now:
                    now, got, table, chance = bucket, [], None, {}
                kind = of["kind"].to_numpy(zero_copy_only=False)
                for k, keys, vals in zip(of["kind"].to_pylist(), of["keys"].to_pylist(), of["vals"].to_pylist(), strict=True):
                    if k == CODES:
                        got.append((_unpack_codes(keys), _unpack(vals, np.float64)))
                    elif k == WORDS:
                        n = _unpack(vals)
                        chance.update(zip(zlib.decompress(keys).split(b"\n") if len(n) else [], np.log10((n + 0.5) / floor).tolist(), strict=True))
                texts = of.filter(pa.array(kind > WORDS))
                if not len(texts):
                    continue
                if table is None:
                    table, got = _Table(*(np.concatenate(x) for x in zip(*got, strict=True))), []
                found = texts["text"].to_pylist()
                tokens, hits, plain, full = (np.zeros(len(found), k) for k in (np.int64, np.int64, float, float))
                for i, t in enumerate(found):
                    values = [chance.get(w, unknown) for w in t.lower().split()]
                    tokens[i] = len(values) + 1
                    hits[i] = len(values) - values.count(unknown) + (ends > 0)
                    plain[i] = math.fsum(values) + of_end
                for places, held in _slices(found):
                    at, first = successions(held)
                    np.add.at(full, places, np.add.reduceat(table.get(at), first))
                cols = [texts["doc_id"].combine_chunks(), texts["held"].combine_chunks(), pa.array(tokens), pa.array(hits),
                        pa.array(np.full(len(found), n_train, np.int64)), pa.array(plain), pa.array(full)]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    # The answers of a bucket come before its texts, which pass through in batches.
    texts = base.select("bucket", F.lit(WORDS + 1).alias("kind"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("vals"), "doc_id", "text", "held")
    back = answers.select("bucket", "kind", "keys", "vals", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("binary").alias("text"), F.lit(None).cast("boolean").alias("held"))
    return back.unionByName(texts).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(apply, schema)
