"""Merkle manifest of a dataset: one tree a group of rows, one root over all groups.

A leaf is the digest of a row's fields.  Leaves of a group stand in the order of
the ids and every ``fanout`` consecutive nodes become their parent until one is
left, the group's subroot; the subroots make the dataset's root likewise.

Superblocks of ``fanout ** block_levels`` consecutive leaves are whole subtrees,
so a group of any size is many small tasks.  Going up, each superblock is
reduced to its root, and the roots are cut into superblocks again until a group
has one node.  Going down, a superblock's nodes are cogrouped with the outer
nodes that their proofs need (the siblings above its root, kept once a
superblock): the cogrouped function finishes the reduction inside the
superblock and joins the inner siblings to the outer ones.  At the leaves it
also folds each leaf up to a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ship, stored
from fathom.operators.ordered import sequence

FANOUT = 8
#: A superblock has FANOUT ** BLOCK_LEVELS leaves at most.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = ("tree", "pos", "size", "node")
#: ``way``: what stands before and after, level by level up to the root.
OUTER = "tree long, block long, way array<string>, subroot string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], fanout: int, most: int, alone: bool) -> list[list[str]]:
    """Node lists of a superblock from the lowest level to its root: ``most``
    levels above the lowest, or, where the superblock is a whole tree
    (``alone``), as many as leave one node."""
    out = [nodes]
    while len(out) <= most and not (alone and len(nodes) == 1):
        nodes = [digest("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[str]:
    """What stands before and after the node ``at`` of the lowest level in its
    run, then the same for its parent, and so on."""
    way = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        way += ["".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])]
        at //= fanout
    return way


def fold(node: str, way: list[str]) -> str:
    for before, after in zip(way[::2], way[1::2], strict=True):
        node = digest(before + node + after)
    return node


def _field(v: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(fields: Sequence[str], **changed: Column) -> Column:
    """Digest of the fields, some of them changed."""
    values = [changed.get(c, F.col(f"`{c}`")).cast("string") for c in fields]
    return F.sha2(F.concat(*map(_field, values)).cast("binary"), 256)


def _blocked(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / span).cast("long"))


def _roots(nodes: DataFrame, fanout: int, deep: int) -> DataFrame:
    """Nodes (tree, pos, size, node), ``size`` of them in a tree -> the roots of
    their superblocks as nodes."""
    span = fanout ** deep

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        n = int(part["size"][0])
        top = levels_of(part["node"].tolist(), fanout, deep, n <= span)[-1]
        return pd.DataFrame({"tree": part["tree"][:1], "pos": part["block"][:1], "size": [-(-n // span)], "node": top})

    return _blocked(nodes.select(*NODE), span).groupBy("tree", "block").applyInPandas(reduce, "tree long, pos long, size long, node string")


def _upwards(nodes: DataFrame, fanout: int, deep: int) -> list[DataFrame]:
    """Node tables from ``nodes`` up, until each tree is one superblock."""
    out = [nodes]
    while out[-1].agg(F.max("size")).first()[0] > fanout ** deep:
        out.append(stored(_roots(out[-1], fanout, deep), "manifest-nodes"))
    return out


def _exchanged(nodes: DataFrame, outer: DataFrame, fanout: int, deep: int, schema: str,
               finish: Callable[[pd.DataFrame, list[list[str]], str], pd.DataFrame]) -> DataFrame:
    """Cogroup a superblock's nodes with its row of outer nodes (tree, block,
    way, subroot), finish its reduction and give ``finish`` the nodes and the
    whole way of each."""
    span = fanout ** deep

    def join(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        inner = levels_of(part["node"].tolist(), fanout, deep, int(part["size"][0]) <= span)
        rest = list(above["way"][0])
        return finish(part, [siblings(inner, i, fanout) + rest for i in range(len(part))], above["subroot"][0])

    return _blocked(nodes, span).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(join, schema)


def _ways(part: pd.DataFrame, ways: list[list[str]], subroot: str) -> pd.DataFrame:
    return pd.DataFrame({"tree": part["tree"], "block": part["pos"], "way": ways, "subroot": subroot})


def _downwards(levels: list[DataFrame], top: DataFrame, fanout: int, deep: int) -> DataFrame:
    """The outer nodes of each superblock of the lowest of ``levels``; ``top``
    has those of each tree: (tree, way, subroot)."""
    outer = top.withColumn("block", F.lit(0).cast("long"))
    for nodes in levels[:0:-1]:
        outer = stored(_exchanged(nodes, outer, fanout, deep, OUTER, _ways), "manifest-outer")
    return outer


def manifest(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", fields: Sequence[str] = FIELDS,
             text_col: str = "text", tampered: Column | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row for each row of ``docs``: id, leaf, subroot, root, proof_sha256,
    folded_root, verified.

    Rows of a group ascend by id; a null id stands first, and rows alike in the
    id ascend by their leaf (repeated rows are equal leaves side by side).  A
    null group is a group of its own, first among the subroots; an empty string
    follows it.  In a leaf a null field counts as ``-``, an empty text as
    ``0:``.  proof_sha256 is the digest of the siblings on the way to the root;
    a row that is alone has none, so it is the digest of nothing and the leaf is
    the root.  folded_root is folded from the leaf and the original siblings;
    where ``tampered`` holds, the leaf is that of the text with A-Z in lower
    case.  Texts of any length go into their leaf only.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    spark, deep = docs.sparkSession, block_levels
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    spoilt = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    lower = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"), leaf(fields).alias("node"),
                       F.when(spoilt, leaf(fields, **{text_col: lower})).alias("spoilt"))
    placed = sequence(rows, by=["grp"], order=["id", "node", "spoilt"], pos_col="pos", count_col="size")
    # Trees are numbered in the order of their groups: null first, then by UTF-8 bytes.
    groups = sequence(placed.select("grp", "size").distinct().withColumn("one", F.lit(0)), by=["one"], order=["grp"], pos_col="tree", count_col="trees")
    trees = stored(groups.select(F.col("grp").alias("of"), F.col("tree").cast("long"), F.col("trees").cast("long")), "manifest-trees")
    leaves = stored(placed.join(trees, placed["grp"].eqNullSafe(trees["of"]))
                    .select("tree", F.col("pos").cast("long"), F.col("size").cast("long"), "node", "spoilt", F.col("id").cast("string")), "manifest-leaves")
    if not leaves.take(1):
        return spark.createDataFrame([], f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    levels = _upwards(leaves, fanout, deep)
    subroots = stored(_roots(levels[-1], fanout, deep).drop("pos", "size").join(trees, "tree")
                      .select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("size"), "node"), "manifest-subroots")
    above = _upwards(subroots, fanout, deep)
    root = _roots(above[-1], fanout, deep).first()["node"]
    none = spark.range(1).select(F.col("id").alias("tree"), F.array().cast("array<string>").alias("way"), F.lit("").alias("subroot"))
    tops = _exchanged(subroots, _downwards(above, none, fanout, deep), fanout, deep, OUTER,
                      lambda part, ways, _: pd.DataFrame({"tree": part["pos"], "block": 0, "way": ways, "subroot": part["node"]}))
    outer = _downwards(levels, stored(tops.drop("block"), "manifest-tops"), fanout, deep)

    def proofs(part: pd.DataFrame, ways: list[list[str]], subroot: str) -> pd.DataFrame:
        start = part["spoilt"].where(part["spoilt"].notna(), part["node"])
        return pd.DataFrame({"id": part["id"], "leaf": part["node"], "subroot": subroot, "proof_sha256": [digest("".join(w)) for w in ways],
                             "folded_root": [fold(s, w) for s, w in zip(start, ways, strict=True)]})

    out = _exchanged(leaves, outer, fanout, deep, "id string, leaf string, subroot string, proof_sha256 string, folded_root string", proofs)
    return out.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == root).alias("verified"))
