"""Line dedup with a log-template tree.

Lines parse to a leaf of a tree of fixed depth: the number of tokens, then the
leading tokens, variable fields (tokens with digits) as wildcards.  A leading
place with several children has a further leaf with a wildcard in that place.
Only leaves that several documents reach can hold a recurring template.  In a
leaf, a token is constant from a share of the leaf's documents on and any
other is a variable field; the line's template is what is constant.  Shares
run from coarse to fine, the finest is a fixed number of documents, so fields
stay variable however often their values come back in a large corpus.  Lines
whose template recurs across documents are dropped, and long lines that two
documents have word for word.  Counts are partial sums keyed by hashes, so
neither a leaf nor a line that a third of all documents have is gathered, and
no step depends on the order of lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import fresh, ship, small_batches, small_side, stored, text_key

#: Leading tokens on a path of the tree.
DEPTH = 3
#: Documents of different text from which a leaf, a token at a place, a template recurs.
DOCUMENTS = 3
#: Share of a line's tokens that have to be constant.
CONSTANT = 0.5
#: Shares of a leaf's documents from which a token is constant, coarse to fine.
SHARES = (1 / 2, 1 / 8, 1 / 32)
#: A line of so many tokens recurs word for word from two documents on; shorter ones meet by chance.
LONG = 10
#: Shorter lines are never templates.
TOKENS = 3
VARIABLE = re.compile(rb"[0-9]")
#: Odd numbers that set the hashes of tokens apart by their places (the golden ratio's powers in 64 bits), and what stands for a wildcard.
MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64).view(np.int64)
WILDCARD = np.int64(0x00632BE59BD9B4E1)
#: Token hashes that a task remembers before it starts afresh.
MEMO = 100_000
HALF = 1 << 63


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - HALF


#: Stands for every variable field.
FIELD = _hash(b"\0")


class _Tokens(dict):
    """Hash of each token, of all variable fields the same; remembers them."""

    def __missing__(self, token: bytes) -> int:
        plain = token.isalpha() or not VARIABLE.search(token)
        h = self[token] = xxhash.xxh64_intdigest(token) - HALF if plain else FIELD
        return h


def _nodes(heads: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The leaf of each line, then those with a wildcard in one leading place."""
    depth = heads.shape[1]
    of = np.empty((len(counts), depth + 1), np.int64)
    parts = heads * MIX[1:depth + 1]
    of[:, 0] = parts.sum(axis=1) + counts * MIX[0]
    for k in range(depth):
        of[:, k + 1] = of[:, 0] - parts[:, k] + WILDCARD * (k + 1)
    # Mixed, so that the sums do not show in the low bits.
    of ^= of >> 29
    of *= MIX[0]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * (depth + 1)), pa.array(of.ravel()))


def _heads(rows: list[list[int]], depth: int) -> np.ndarray:
    return np.array([h if len(h) == depth else h + [0] * (depth - len(h)) for h in rows], np.int64).reshape(-1, depth)


def _lines(texts: DataFrame, depth: int, tokens: int, long: int) -> DataFrame:
    """(key, line, nodes, whole) of the lines that can be templates; whole stands for a long line word for word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Tokens()
        for b in batches:
            keys, lines, heads, counts, whole = [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, line in enumerate(text.split(b"\n")):
                    found = line.split()
                    n = len(found)
                    if n >= tokens:
                        keys.append(key)
                        lines.append(i)
                        heads.append([memo[t] for t in found[:depth]])
                        counts.append(n)
                        whole.append(_hash(b" ".join(found)) if n >= long else None)
                if len(memo) > MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines, pa.int32()), _nodes(_heads(heads, depth), np.array(counts, np.int64)),
                                              pa.array(whole, pa.int64())], ["key", "line", "nodes", "whole"])

    return texts.mapInArrow(run, "key binary, line int, nodes array<long>, whole long").withColumn("mark", F.xxhash64("key"))


def _places(texts: DataFrame, depth: int, tokens: int) -> DataFrame:
    """(key, line, nodes, places, again) of the lines of different texts: places
    are hashes of the tokens with their places; again has for each node the
    places that an earlier line of the text has in it, NULL where none has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Tokens()
        for b in batches:
            keys, lines, heads, flat, ends, texts_end = [], [], [], [], [0], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, line in enumerate(text.split(b"\n")):
                    found = line.split()
                    if len(found) >= tokens:
                        keys.append(key)
                        lines.append(i)
                        flat.extend(map(memo.__getitem__, found))
                        heads.append(flat[ends[-1]:ends[-1] + depth] if len(found) > depth else flat[ends[-1]:])
                        ends.append(len(flat))
                texts_end.append(len(keys))
                if len(memo) > MEMO:
                    memo.clear()
            offsets = np.array(ends, np.int64)
            nth = np.arange(len(flat), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
            places = np.array(flat, np.int64) + nth * MIX[0]
            nodes = _nodes(_heads(heads, depth), np.diff(offsets))
            again: list[list | None] = [None] * len(keys)
            leaves, start = nodes.to_pylist(), 0
            for end in texts_end:
                seen: dict[int, int | set[int]] = {}
                for r in range(start, end):
                    for j, node in enumerate(leaves[r]):
                        had = seen.setdefault(node, r)
                        if had is r:
                            continue
                        if isinstance(had, int):
                            had = seen[node] = set(places[ends[had]:ends[had + 1]].tolist())
                        mine = places[ends[r]:ends[r + 1]].tolist()
                        if again[r] is None:
                            again[r] = [None] * (depth + 1)
                        again[r][j] = [p for p in mine if p in had]
                        had.update(mine)
                start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(lines, pa.int32()), nodes,
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places)), pa.array(again, pa.list_(pa.list_(pa.int64())))],
                ["key", "line", "nodes", "places", "again"])

    return texts.mapInArrow(run, "key binary, line int, nodes array<long>, places array<long>, again array<array<long>>").withColumn("mark", F.xxhash64("key"))


def _recurring(rows: DataFrame, column: str, documents: int) -> DataFrame:
    """Values of a column that rows of so many different texts have, and that number."""
    return rows.select(column, "mark").distinct().groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= documents)


def _once(texts: DataFrame, marks: DataFrame, rows: int) -> DataFrame:
    """The texts with these marks, one row each; only texts that come again travel."""
    some = texts.withColumn("mark", F.xxhash64("key")).join(small_side(marks, rows), "mark", "left_semi")
    copies = stored(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "copied-texts")
    copies = small_side(copies, copies.count())
    return (some.join(copies, "key", "left_anti").select("key", "text")
            .unionByName(some.join(copies, "key", "left_semi").select("key", "text").dropDuplicates(["key"])))


def _templates(texts: DataFrame, depth: int, documents: int, constant: float, tokens: int, long: int) -> DataFrame:
    """(key, line, rank, template) of every template of a line that recurs, the least rank the coarsest."""
    every = stored(_lines(texts, depth, tokens, long), "lines")
    # Two texts are told apart by the least and the greatest of their marks.
    whole = every.where(F.col("whole").isNotNull()).groupBy("whole").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a != b").select("whole")
    whole = stored(whole, "whole-lines")
    copied = every.join(small_side(whole, whole.count()), "whole", "left_semi")
    # A wildcard needs several children, which are leaves without one.
    wild = F.explode(F.slice("nodes", 2, depth)).alias("node")
    children = every.select("nodes").distinct().select(wild).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    children = stored(children.where(F.col("n") >= documents).select("node"), "children")
    generalised = every.select("mark", wild).join(small_side(children, children.count()), "node", "left_semi")
    nodes = _recurring(every.withColumn("node", F.col("nodes")[0]).select("mark", "node").unionByName(generalised.select("mark", "node")), "node", documents)
    nodes = stored(nodes, "leaves")
    n_nodes = nodes.count()
    # Only the texts that reach such a leaf are read again, for their tokens.
    reach = stored(every.select("mark", F.explode("nodes").alias("node")).join(small_side(nodes, n_nodes), "node", "left_semi").select("mark").distinct(), "reach")
    lines = _places(_once(texts, reach, reach.count()), depth, tokens)
    lines = lines.select("key", "mark", "line", "places", "again", F.posexplode("nodes").alias("at", "node")).join(small_side(nodes, n_nodes), "node")
    lines = lines.select("key", "mark", "line", "node", "n", "at", "places", F.col("again")[F.col("at")].alias("again"))
    lines = stored(lines.withColumn("id", F.monotonically_increasing_id()), "line-places")
    # A text counts once for a token at a place of a leaf; the wildcard's place has no token.
    counted = F.when(F.col("again").isNull(), F.col("places")).otherwise(F.array_except("places", "again"))
    place = lines.select("node", F.when(F.col("at") > 0, F.col("places")[F.col("at") - 1]).alias("skip"), F.explode(counted).alias("place"))
    place = place.where(F.col("skip").isNull() | (F.col("place") != F.col("skip"))).groupBy("node", "place").agg(F.count(F.lit(1)).alias("texts"))
    fixed = stored(place.where(F.col("texts") >= documents), "places")
    # At a share s of the texts a place has 1/s tokens at most, so a leaf's constants by shares are one bounded row.
    shared = fixed.join(small_side(nodes, n_nodes), "node").where(F.col("texts") >= SHARES[-1] * F.col("n"))
    held_by = [f"held_{i}" for i in range(len(SHARES))]
    leaves = stored(shared.groupBy("node").agg(*[F.collect_list(F.when(F.col("texts") >= s * F.col("n"), F.col("place"))).alias(h)
                                                 for s, h in zip(SHARES, held_by, strict=True)]), "leaf-constants")

    def template(rank: int, held: Column, more: bool) -> Column:
        # By shares, more than the leading tokens has to be constant; a wildcard's leaf has shares only.
        enough = (F.size(held) > depth) if more else (F.col("at") == 0)
        return F.when(enough & (F.size(held) >= constant * F.size("places")), F.struct(
            (F.when(F.col("at") == 0, 10).otherwise(0) + rank).alias("rank"), F.xxhash64("node", held).alias("template")))

    # In a leaf of so few texts the finest share is ``documents`` texts at most.
    few = F.col("n") * SHARES[-1] <= documents
    levels = [template(i, F.array_intersect("places", h), True) for i, h in enumerate(held_by)]
    levels.append(F.when(few, template(len(SHARES), F.array_intersect("places", held_by[-1]), False)))
    by_share = lines.join(small_side(leaves, leaves.count() * 4), "node").select("key", "mark", "line", F.explode(F.array_compact(F.array(*levels))).alias("x"))
    # In a larger leaf without a wildcard the tokens of ``documents`` texts are unbounded: those of each line are joined.
    large = lines.where((F.col("at") == 0) & ~few)
    tokens_of = large.select("id", "node", F.explode("places").alias("place")).join(small_side(fixed.select("node", "place"), fixed.count()), ["node", "place"], "left_semi")
    # A group is the tokens of one line.
    tokens_of = tokens_of.groupBy("id").agg(F.collect_list("place").alias("held"))
    by_number = large.join(tokens_of, "id").select("key", "mark", "line", template(len(SHARES), F.array_intersect("places", "held"), False).alias("x"))
    found = by_share.unionByName(by_number.where(F.col("x").isNotNull())).select("key", "mark", "line", "x.rank", "x.template")
    found = stored(found, "templates")
    kept = stored(_recurring(found, "template", documents).select("template"), "recurring-templates")
    of = found.join(small_side(kept, kept.count()), "template", "left_semi").select("key", "line", "rank", "template")
    return of.unionByName(copied.select("key", "line", F.lit(99).alias("rank"), F.col("whole").alias("template")))


def recurring_lines(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, documents: int = DOCUMENTS,
                    constant: float = CONSTANT, tokens: int = TOKENS, long: int = LONG) -> DataFrame:
    """(key, line, rank, template), a row for each template: lines of distinct
    texts (by their key) whose template recurs in ``documents`` texts, or that
    two texts have word for word if of ``long`` tokens; the least rank is the coarsest."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return _templates(texts, depth, documents, constant, tokens, long)


def _but_first(of: DataFrame) -> DataFrame:
    """(key, line) without the first line, by key, of each line's coarsest template."""
    of = stored(of.groupBy("key", "line").agg(F.min(F.struct("rank", "template")).alias("x")).select("key", "line", "x.template"), "line-templates")
    first = of.groupBy("template").agg(F.min(F.struct("key", "line")).alias("first")).select("first.key", "first.line")
    return of.select("key", "line").join(first, ["key", "line"], "left_anti")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", keep_first: bool = False, depth: int = DEPTH,
                         documents: int = DOCUMENTS, constant: float = CONSTANT, tokens: int = TOKENS, long: int = LONG) -> DataFrame:
    """``docs`` without the lines whose template recurs across documents, and
    without long ones that two documents have; adds n_lines and n_dropped.

    Documents with equal texts count as one, so a copied document does not make
    its own lines recur.  ``keep_first`` leaves one line of every template.
    A null text stays null with 0 lines, an empty text has one empty line.
    Repeated rows are treated alike and stay.  An empty table gives an empty
    result; columns of the caller named like an added one are replaced.
    """
    found = recurring_lines(docs, text_col, depth, documents, constant, tokens, long)
    if keep_first:
        found = _but_first(found)
    # A group is the lines of one text.
    drops = stored(found.groupBy("key").agg(F.collect_set("line").alias("lines")), "dropped-lines")
    weight = drops.agg(F.coalesce(F.sum(F.size("lines") + 4), F.lit(0))).first()[0]
    inner, mark, gone, parts = fresh(docs, "line_key", "line_mark", "gone", "parts")
    right = small_side(drops.toDF(mark, gone), weight // 4)
    rows = docs.withColumn(inner, text_key(text_col))
    rows = rows.join(right, F.col(inner) == F.col(mark), "left").withColumn(parts, F.split(text_col, "\n", -1))

    def without(parts: Column, gone: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")

    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(without(F.col(parts), F.col(gone)))
    new = {"n_lines", "n_dropped"}
    return rows.select(*[text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in new],
                       F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
