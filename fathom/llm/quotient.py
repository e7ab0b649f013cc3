"""Exact dedup with counting quotient filters.

Every scan partition packs the 64-bit fingerprints of its normalised texts
into counting quotient filters, one per fingerprint range; the filters of a
range merge without loss because both enumerate their fingerprints in order.
Only documents whose fingerprint counts above one in the merged filter carry
their text to the byte verification.  A text copied into a third of all rows
is one counted entry per partition there and one partial sum per task in the
verification, so no task meets the group row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import apply_marks, ship, small_side, stored, text_of

RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Fingerprints of one merged filter on average.
RANGE_ROWS = 1 << 18
LEAST_RANGES = 64


class QuotientFilter:
    """Counting quotient filter of ``p``-bit fingerprints.

    The leading ``q`` bits of a fingerprint choose its home slot, the slots
    hold the ``r = p - q`` others in ascending order, runs shift right past
    taken slots.  Three bits a slot: some fingerprint has this home; a run
    ends here; this slot continues the count of the remainder before it.
    """

    def __init__(self, p: int, q: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.p, self.q, self.r = p, q, p - q
        self.occupied, self.runend, self.counter, self.slots = occupied, runend, counter, slots

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, p: int) -> QuotientFilter:
        """From ascending distinct unsigned fingerprints and their counts."""
        n = len(fingerprints)
        q = min(p - 1, max(1, int(n).bit_length()))
        r = p - q
        home = (fingerprints >> np.uint64(r)).astype(np.int64)
        rest = fingerprints & np.uint64((1 << r) - 1)
        over = (counts - 1).astype(np.uint64)
        digits, left = np.zeros(n, np.int64), over.copy()
        while left.any():
            digits += left > 0
            left = left >> np.uint64(r) if r < 64 else np.zeros_like(left)
        first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if n else np.zeros(0, np.int64)
        length = np.add.reduceat(digits + 1, first) if n else np.zeros(0, np.int64)
        before = np.cumsum(length) - length
        start = np.maximum.accumulate(home[first] - before) + before if n else before
        size = max(1 << q, int((start + length).max()) if n else 0)
        occupied, runend, counter = (np.zeros(size, bool) for _ in range(3))
        slots = np.zeros(size, np.uint64)
        occupied[home[first]] = True
        runend[start + length - 1] = True
        at = np.cumsum(digits + 1) - (digits + 1)  # place in the sequence of all taken slots
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n])) if n else np.zeros(0, np.int64)
        at = at - before[run] + start[run] if n else at
        slots[at] = rest
        for k in range(1, int(digits.max(initial=0)) + 1):
            here = at[digits >= k] + k
            slots[here] = (over[digits >= k] >> np.uint64(r * (k - 1))) & np.uint64((1 << r) - 1)
            counter[here] = True
        return cls(p, q, occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order and their counts."""
        home, end = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        start = np.maximum(home, np.r_[0, end[:-1] + 1]) if len(home) else home
        length = end - start + 1
        total = int(length.sum())
        taken = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)
        of = np.repeat(home, length)
        is_item = ~self.counter[taken]
        item = np.cumsum(is_item) - 1
        fingerprints = (of[is_item].astype(np.uint64) << np.uint64(self.r)) | self.slots[taken[is_item]]
        counts = np.ones(len(fingerprints), np.int64)
        first = np.flatnonzero(is_item)
        more = np.flatnonzero(~is_item)
        digit = more - first[item[more]] - 1
        np.add.at(counts, item[more], (self.slots[taken[more]] << (digit * self.r).astype(np.uint64)).astype(np.int64))
        return fingerprints, counts

    def to_bytes(self) -> bytes:
        width = (self.r + 7) // 8
        head = np.array([self.p, self.q, len(self.slots)], "<u4").tobytes()
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter))
        return head + bits + self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        p, q, size = (int(x) for x in np.frombuffer(data, "<u4", 3))
        width, step = (p - q + 7) // 8, (size + 7) // 8
        bits = [np.unpackbits(np.frombuffer(data, np.uint8, step, 12 + i * step), count=size).astype(bool) for i in range(3)]
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, size * width, 12 + 3 * step).reshape(size, width)
        return cls(p, q, *bits, wide.view("<u8").ravel())

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with the counts of all: their ascending enumerations are merged and equal fingerprints summed."""
        found = [f.items() for f in filters]
        fps, counts = np.concatenate([x for x, _ in found]), np.concatenate([c for _, c in found])
        order = np.argsort(fps, kind="stable")
        fps, counts = fps[order], counts[order]
        first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
        return cls.build(fps[first], np.add.reduceat(counts, first), filters[0].p)


FILTERS = "`range` long, filter binary, n_distinct long, n_rows long"


def quotient_filters(rows: DataFrame, column: str, bits: int, range_bits: int) -> DataFrame:
    """Merged filters of a column of ``bits``-bit fingerprints, one row for each
    range of their leading ``range_bits`` bits that has any."""
    ship(rows.sparkSession)
    inner = bits - range_bits

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fps, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:  # what is held are distinct fingerprints of one scan partition
            new = b.iloc[:, 0].to_numpy(np.int64).view(np.uint64)
            fps, back = np.unique(np.concatenate([fps, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(len(new), np.int64)]), len(fps)).astype(np.int64)
        if not len(fps):
            return
        part = fps >> np.uint64(inner)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out = []
        for a, b in zip(edges, [*edges[1:], len(fps)], strict=True):
            f = QuotientFilter.build(fps[a:b] & np.uint64((1 << inner) - 1), counts[a:b], inner)
            out.append((int(part[a]), f.to_bytes(), int(b - a), int(counts[a:b].sum())))
        yield pd.DataFrame(out, columns=["range", "filter", "n_distinct", "n_rows"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        f = QuotientFilter.merge([QuotientFilter.from_bytes(x) for x in parts["filter"]])
        fps, counts = f.items()
        return pd.DataFrame([(key[0], f.to_bytes(), len(fps), int(counts.sum()))], columns=["range", "filter", "n_distinct", "n_rows"])

    return rows.select(column).mapInPandas(pack, FILTERS).groupBy("range").applyInPandas(merge, FILTERS)


def repeated_fingerprints(filters: DataFrame, range_bits: int) -> DataFrame:
    """(fp, n): fingerprints whose count in the merged filters is above one."""
    def enumerate_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, data in zip(b["range"], b["filter"], strict=True):
                f = QuotientFilter.from_bytes(data)
                fps, counts = f.items()
                fps = fps[counts > 1] | np.uint64(part << f.p)
                yield pd.DataFrame({"fp": fps.view(np.int64), "n": counts[counts > 1]})

    return filters.mapInPandas(enumerate_, "fp long, n long")


def _normal(text: str):
    return F.regexp_replace(text_of(text), RUN, " ")


def _fingerprint(normal, bits: int):
    return F.shiftrightunsigned(F.xxhash64(normal), 64 - bits) if bits < 64 else F.xxhash64(normal)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, fp.

    Texts are equal when alike after each run of ASCII white space became one
    space; null counts as empty.  Of equal texts the smallest id stays, a null
    id only where no other has the text, and of repeated rows (same id, equal
    text) one.  keep_id is null where all ids of a group are.  An empty table
    gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), _normal(text_col).alias("normal"))
    base = base.withColumn("fp", _fingerprint(F.col("normal"), fingerprint_bits))
    rows = stored(base.select("doc_id", "fp", F.unhex(F.sha2("normal", 256)).alias("sha"),
                              F.monotonically_increasing_id().alias("uid")), "exact-rows")
    ranges = max(LEAST_RANGES, -(-rows.count() // RANGE_ROWS))
    range_bits = min(fingerprint_bits - 2, (ranges - 1).bit_length())
    repeated = stored(repeated_fingerprints(quotient_filters(rows, "fp", fingerprint_bits, range_bits), range_bits), "exact-repeated")
    few = small_side(repeated.select("fp"), repeated.count())

    # Byte verification: the grouping compares whole normalised texts.
    texts = (base.join(few, "fp", "left_semi").withColumn("sha", F.unhex(F.sha2("normal", 256)))
             .groupBy("fp", "sha", "normal").agg(F.count(F.lit(1)).alias("copies"))
             .groupBy("fp", "sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("group_size")))
    texts = texts.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size"))
                             .otherwise(F.raise_error(F.lit("two texts share one SHA-256 digest")).cast("long"))).drop("texts")
    first = (rows.join(few, "fp", "left_semi").groupBy("fp", "sha")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")))
    # Stored, so that the join below has plain inputs, of which AQE splits a text that many rows share.
    groups = stored(first.join(texts, ["fp", "sha"]).select("fp", "sha", "first", "group_size"), "exact-groups")
    out = rows.join(groups, ["fp", "sha"], "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "fp")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns."""
    found = exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), "text_sha256", "kept")
    sha = F.sha2(_normal(text_col), 256)
    return apply_marks(docs, {"id": F.col(id_col), "text_sha256": sha}, found)
