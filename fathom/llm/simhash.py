"""SimHash near-dedup with bit-sliced comparison.

Fingerprints within ``radius`` bits agree in whole blocks of bits (pigeonhole),
so only fingerprints that share such blocks are compared; the number of blocks
follows the number of distinct fingerprints, which keeps buckets small at any
size, and a bucket that is large all the same is dealt out as pairs of chunks.
Inside a task 64 fingerprints form a block stored as bit planes: one XOR a
plane compares a fingerprint with all 64, carry-save counters add the
differing bits, and a comparison is abandoned once all 64 lanes exceed the
radius.  What leaves a task is a spanning forest of each bucket, never its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import apply_marks, ship, stored, text_key
from fathom.llm.components import components

SEED = 42
#: A bucket above this many fingerprints is compared as pairs of chunks of half of it.
SPLIT = 8192
#: Comparisons (a fingerprint with a block of 64) held at once.
STEP = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ROW = 256 * np.arange(8, dtype=np.uint16)


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text; a bit is 1 if set in over half of the hashes of its word shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    join, h = b" ".join, xxhash.xxh64_intdigest
    grams = map(join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [join(words)]
    hashes = np.fromiter((h(g, SEED) for g in grams), np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _ROW).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp): one row for each row of ``docs``; key stands for the text, fp is signed."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("key", T.BinaryType()),
                           T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(x.as_py(), shingle) for x in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "key", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of all choices of blocks - radius of the blocks that 64 bits are cut into."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(block, blocks - radius)]


def _planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes a block of 64 values: lane i of plane b is bit b of value i."""
    pad = np.zeros(-len(values) % 64, np.uint64)
    x = np.concatenate([values, pad]).reshape(-1, 64)
    lanes = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.stack([(((x >> np.uint64(b)) & np.uint64(1)) * lanes).sum(axis=1, dtype=np.uint64) for b in range(64)])


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def bucket_forest(bucket: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """For values sorted by bucket: index of the root of each value's tree, where
    values of one bucket that differ in at most ``radius`` bits share a tree."""
    n = len(values)
    parent = np.arange(n)
    if n < 2:
        return parent
    planes = _planes(values)
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
    end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    spans = np.where(end > np.arange(n) + 1, (end - 1) // 64 - np.arange(n) // 64 + 1, 0)
    upto = np.cumsum(spans)
    counters = max(1, radius.bit_length())
    offset = (1 << counters) - 1 - radius
    full = ~np.uint64(0)
    for lo in range(0, int(upto[-1]), STEP):
        pair = np.arange(lo, min(lo + STEP, int(upto[-1])))
        row = np.searchsorted(upto, pair, side="right")
        block = row // 64 + pair - (upto[row] - spans[row])
        first, last = np.clip(row + 1 - block * 64, 0, 64), np.clip(end[row] - block * 64, 0, 64)
        ones = lambda k: np.where(k >= 64, full, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        alive = ones(last) & ~ones(first)
        keep = alive != 0
        row, block, alive = row[keep], block[keep], alive[keep]
        count = [np.full(len(row), full if offset >> i & 1 else np.uint64(0)) for i in range(counters)]
        for b in range(64):
            carry = planes[b][block] ^ np.where(values[row] >> np.uint64(b) & np.uint64(1), full, np.uint64(0))
            for i in range(counters):
                count[i], carry = count[i] ^ carry, count[i] & carry
            alive &= ~carry
            if b % 4 == 3 and not (keep := alive != 0).all():  # blocks whose lanes all exceed the radius go
                row, block, alive, count = row[keep], block[keep], alive[keep], [c[keep] for c in count]
        if not len(row):
            continue
        at, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = row[at], block[at] * 64 + lane
        while len(a):
            ra, rb = _find(parent, a), _find(parent, b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return _find(parent, np.arange(n))


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of distinct
    fingerprints ``fp`` of ``nodes`` within ``radius`` bits."""
    spark = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n >> min(int(m).bit_count() for m in _masks(blocks, radius)) > 256:
        blocks += 1
    masks = _masks(blocks, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    large = stored(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SPLIT), "buckets")
    keyed = keyed.join(large, ["t", "key"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("size") / (SPLIT // 2)), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    keyed = (keyed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("fp", F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_b, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rest_b = np.concatenate([rest_b, b.column(0).to_numpy()])
                rest_f = np.concatenate([rest_f, b.column(1).to_numpy()])
                cut = int(np.searchsorted(rest_b, rest_b[-1])) if len(rest_b) else 0  # the last bucket may go on
            else:
                cut = len(rest_b)
            if cut:
                root = bucket_forest(rest_b[:cut], rest_f[:cut].view(np.uint64), radius)
                at = np.flatnonzero(root != np.arange(cut))
                yield pa.RecordBatch.from_arrays([pa.array(rest_f[at]), pa.array(rest_f[root[at]])], ["u", "v"])
                rest_b, rest_f = rest_b[cut:], rest_f[cut:]

    return (keyed.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits),
    component_id (the smallest id reachable over links of at most ``radius``
    bits; null where no document of the component has an id), key (stands for
    the text), component (stands for the component).

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows each get a row.  An empty table gives an empty result; other
    columns are ignored.  Bucket ids are 64-bit hashes: buckets that share one
    are compared together, which adds comparisons but never a link beyond the radius.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    linked = components(stored(links(least, radius), "simhash-links"))
    linked = least.join(linked.withColumnRenamed("node", "fp"), "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(of_root, "root").select("fp", "root", "component_id")
    of = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"),
                                                 F.coalesce("root", "fp").alias("component"))
    return rows.join(of, "fp", "left").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component stays: the one with the smallest id (a null
    id only where no other is there), of several with that id the one with the least text key."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius).withColumnRenamed(id_col, "id")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first"))
    found = found.join(first, "component")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & F.col("key").eqNullSafe(F.col("first.key"))
    return apply_marks(docs, {"id": F.col(id_col), "key": text_key(text_col)}, found.select("id", "key", kept.alias("kept")))
