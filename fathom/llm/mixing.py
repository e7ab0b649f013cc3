"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size times.  Whole copies
are given at once; the fractions are rounded dependently: two documents
transfer words between each other, in a random direction whose expectation is
zero, until one of the fractions is 0 or 1.  The words of the pair stay the
same, so a source ends within one document of its target.  Pairs fold along
short arrays; what is left of an array goes up a reduction tree, level by
level, until a source has one fraction.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import WS, fresh, small_side, stored
from fathom.operators.ordered import sequence

#: Documents folded in one array on average.
FAN_IN = 64
#: Copies of a document at most; also a target over its source's size.
MOST = 3
EPS = 1e-9
#: A document is long if so many of its size exceed its source; a source has fewer of them.
LONG = 50


def word_count(text: str | Column) -> Column:
    """Number of words; null counts 0."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.split(F.concat(F.lit(" "), t, F.lit(" ")), WS)) - 2, F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size): sources in code-point
    order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes;
    a target stops at ``most`` times its source's size and the excess goes to the others."""
    named = sequence(sizes.where(F.col("source").isNotNull()), [], ["source"], pos_col="pos").select("source", "source_size", "pos")
    last = sizes.where(F.col("source").isNull()).select("source", "source_size", F.lit(named.count()).cast("long").alias("pos"))
    table = stored(named.unionByName(last).withColumn("weight", (F.col("pos") % 3 + 1).cast("double")), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(most)
    share = 0.0
    while True:  # the capped sources only grow in number
        above = F.col("weight") * share > cap
        rest, held = table.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, cap))).first()
        if not rest or (new := (total - (held or 0.0)) / rest) <= share:
            break
        share = new
    return table.withColumn("target", F.least(F.col("weight") * share, cap))


def _uniform(*cols: Column) -> Column:
    """Number in [0, 1) that follows from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _fold(items: Column, seed: int) -> Column:
    """Fold items (h, uid, w, p), long documents first so that a short one is left, pairwise into done (uid, p in {0, 1}) and at most one open item."""
    done_type = "array<struct<uid:bigint,p:double>>"
    start = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("double").alias("w"),
                     F.lit(None).cast("double").alias("p"), F.array().cast(done_type).alias("done"))

    def state(h, uid, w, p, done):
        return F.struct(h.alias("h"), uid.alias("uid"), w.alias("w"), p.alias("p"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        a, b, wa, wb = s["p"], x["p"], s["w"], x["w"]
        up, down = F.least((1 - a) * wa, b * wb), F.least(a * wa, (1 - b) * wb)  # words that can move to s, to x
        rise = _uniform(F.lit(seed), s["h"], x["h"]) * (up + down) < down
        # Which of the two became whole, what it became, and what the other one is now.
        s_whole = F.when(rise, (1 - a) * wa <= b * wb).otherwise(a * wa <= (1 - b) * wb)
        whole = F.when(rise == s_whole, 1.0).otherwise(0.0)
        other = F.when(rise, F.when(s_whole, b - up / wb).otherwise(a + up / wa)).otherwise(F.when(s_whole, b + down / wb).otherwise(a - down / wa))
        closed = (other < EPS) | (other > 1 - EPS)
        one = F.struct(F.when(s_whole, s["uid"]).otherwise(x["uid"]).alias("uid"), whole.alias("p"))
        two = F.struct(F.when(s_whole, x["uid"]).otherwise(s["uid"]).alias("uid"), F.round(other).alias("p"))
        nothing = F.lit(None)
        none = state(nothing.cast("bigint"), nothing.cast("bigint"), nothing.cast("double"), nothing.cast("double"), F.concat(s["done"], F.array(one, two)))
        go_on = state(F.when(s_whole, x["h"]).otherwise(s["h"]), F.when(s_whole, x["uid"]).otherwise(s["uid"]),
                      F.when(s_whole, wb).otherwise(wa), other, F.concat(s["done"], F.array(one)))
        return F.when(s["uid"].isNull(), state(x["h"], x["uid"], x["w"], x["p"], s["done"])).otherwise(F.when(closed, none).otherwise(go_on))

    return F.aggregate(items, start, step)


def _round(items: DataFrame, seed: int, fan_in: int) -> DataFrame:
    """(uid, p in {0, 1}) of (source, h, uid, w > 0, 0 < p < 1)."""
    decided, level = None, 0
    while True:
        sizes = stored(items.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-level")
        most = sizes.agg(F.max("n")).first()[0]
        if most is None:
            break
        sizes = sizes.select(F.col("source").alias("s"), F.ceil(F.col("n") / fan_in).alias("arrays"))
        dealt = items.join(sizes, items["source"].eqNullSafe(sizes["s"])).withColumn(
            "place", F.pmod(F.xxhash64(F.lit(seed + level), "h"), F.col("arrays")))
        folded = dealt.groupBy("source", "place").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("by"), "h", "uid", "w", "p"))).alias("items"))
        folded = stored(folded.select("source", _fold(F.col("items"), seed + level).alias("s")), "mix-folded")
        done = folded.select(F.inline("s.done"))
        rest = folded.where("s.uid is not null").select("source", "s.h", "s.uid", "s.w", "s.p")
        if most <= fan_in:  # one array a source, so one fraction at most is left: the nearer whole number keeps the target
            done = done.unionByName(rest.select("uid", F.round("p").alias("p")))
        decided = done if decided is None else decided.unionByName(done)
        if most <= fan_in:
            break
        items, level = rest, level + 1
    return decided if decided is not None else items.select("uid", "p")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           seed: int = 42, fan_in: int = FAN_IN, most: int = MOST) -> DataFrame:
    """One row for each distinct (id, source, text) of ``docs``: doc_id, source,
    key (stands for the text), size, rows (how often it is there), source_size,
    target, copies (of all those rows together, at most ``most`` each).

    A null text has size 0 and like any text without words is taken no word,
    so it gets the whole part of its copies only.  A null source is a source
    of its own, the last.  Equal input gives equal copies.  An empty table
    gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("key"), word_count(text_col).alias("size"))
    units = stored(base.groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    units = stored(units.withColumn("uid", F.monotonically_increasing_id()), "mix-units")
    table = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), most)
    table = stored(table.select(F.col("source").alias("s"), "source_size", "target"), "mix-targets")
    units = stored(units.join(table, units["source"].eqNullSafe(table["s"])).drop("s")
                   .withColumn("long", F.col("size") * LONG > F.col("source_size")), "mix-units")

    def rounded(part: DataFrame, share: Column) -> DataFrame:
        part = part.withColumn("want", F.col("rows") * share)
        part = part.withColumn("whole", F.floor(F.col("want") + EPS)).withColumn("part", F.greatest(F.lit(0.0), F.col("want") - F.col("whole")))
        open_ = part.where((F.col("part") > EPS) & (F.col("size") > 0)).select(
            "source", F.xxhash64(F.lit(seed), "doc_id", "key").alias("h"), "uid", F.col("size").cast("double").alias("w"), F.col("part").alias("p"))
        bits = _round(open_, seed, fan_in).withColumnsRenamed({"uid": "u", "p": "bit"})
        return part.join(bits, F.col("uid") == F.col("u"), "left").select(
            "doc_id", "source", "key", "size", "rows", "source_size", "target", (F.col("whole") + F.coalesce("bit", F.lit(0.0))).cast("long").alias("copies"))

    # The few long documents of a source are rounded among themselves first; what they miss of their share the others make up.
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    first = stored(rounded(units.where("long"), share), "mix-long")
    used = first.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("used"), F.sum(F.col("rows") * F.col("size")).alias("long_size"))
    used = used.withColumnRenamed("source", "s")
    others = units.where("not long")
    others = others.join(used, others["source"].eqNullSafe(used["s"]), "left").withColumn("rest", F.col("source_size") - F.coalesce("long_size", F.lit(0)))
    share = F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - F.coalesce("used", F.lit(0))) / F.col("rest")))).otherwise(0.0)
    return first.unionByName(rounded(others, share))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken (words, repeats counted).
    Rows alike in id, source and text share their copies evenly."""
    found = copies(docs, id_col, text_col, source_col, seed).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    mine = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("long")
    return found.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (mine * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its
    columns.  Rows alike in id, source and text count as one row taken that many times."""
    found = stored(copies(docs, id_col, text_col, source_col, seed).select("doc_id", "source", "key", "rows", "copies"), "mix-copies")
    count, most = found.agg(F.count(F.lit(1)), F.max("rows")).first()
    k, c, r, m = fresh(docs, "mix_key", "copies", "mix_rows", "nth")
    right = small_side(found.toDF("m_id", "m_source", "m_key", "m_rows", "m_copies"), count)
    names = fresh(docs, "m_id", "m_source", "m_key")
    right = right.toDF(*names, r, c)
    left = docs.withColumn(k, F.xxhash64(F.col(text_col)))
    on = left[id_col].eqNullSafe(right[names[0]]) & left[source_col].eqNullSafe(right[names[1]]) & (left[k] == right[names[2]])
    rows = left.join(right, on).drop(*names)
    if most and most > 1:
        rows = rows.where(F.col(r) == 1).unionByName(rows.where(F.col(r) > 1).dropDuplicates([id_col, source_col, k]))
    rows = rows.withColumn(m, F.explode(F.when(F.col(c) > 0, F.sequence(F.lit(1).cast("long"), F.col(c))).otherwise(F.array().cast("array<bigint>"))))
    return rows.select(*[F.col(f"`{x}`") for x in docs.columns])
