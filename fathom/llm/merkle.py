"""Document fingerprints as Merkle trees over sections, paragraphs and spans.

A text splits without loss into paragraphs (lines with the line ends behind
them) and these into spans (sentences, at most 64 characters and the marks
behind them).  A section ends at a paragraph whose digest starts with 0 or 1,
so an edit moves no boundary but its own.  Section digests are taken over
paragraph digests, the root over section digests: equal roots mean equal
texts, and below differing digests the spans tell where the texts differ.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import stored, text_of
from fathom.operators.ordered import sequence

PARAGRAPH = r"[^\n]*+\n++|[^\n]++"
SPAN = r"[^.!?\n]{1,64}[.!?\n]{0,32}|[.!?\n]{1,32}"


def _token(span: Column) -> Column:
    """56 bits of hash and 8 of the span's length."""
    return F.xxhash64(span).bitwiseAND(F.lit(~0xFF)).bitwiseOR(F.length(span).cast("long"))


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, a struct of root (64 hex digits), spans (token of each
    span in order) and fingerprint (root|section=paragraph:span.span,paragraph:...|section=...)."""
    p, e = f"{name}_paragraphs", f"{name}_ends"
    df = df.withColumn(p, F.transform(
        F.regexp_extract_all(F.col(text), F.lit(PARAGRAPH), F.lit(0)),
        lambda x: F.struct(F.sha2(x, 256).alias("digest"), F.transform(F.regexp_extract_all(x, F.lit(SPAN), F.lit(0)), _token).alias("spans"))))
    n = F.size(p)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.element_at(F.col(p), i)["digest"].rlike("^[01]"))
    df = df.withColumn(e, F.when(n > 0, ends).otherwise(F.array().cast("array<int>")))

    def section(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(1)).otherwise(F.element_at(F.col(e), F.greatest(k, F.lit(1))) + 1)
        return F.slice(F.col(p), start, end - start + 1)

    sections = F.transform(F.transform(F.col(e), section), lambda s: F.struct(
        _digest(F.transform(s, lambda x: x["digest"])).alias("digest"),
        F.array_join(F.transform(s, lambda x: F.concat(
            F.substring(x["digest"], 1, 16), F.lit(":"),
            F.array_join(F.transform(x["spans"], lambda t: F.lower(F.lpad(F.hex(t), 16, "0"))), "."))), ",").alias("body")))
    s = f"{name}_sections"
    df = df.withColumn(s, sections)
    df = df.withColumn(f"{name}_root", _digest(F.transform(F.col(s), lambda x: x["digest"])))
    body = F.array_join(F.transform(F.col(s), lambda x: F.concat(F.lit("|"), F.substring(x["digest"], 1, 16), F.lit("="), x["body"])), "")
    return df.withColumn(name, F.struct(F.col(f"{name}_root").alias("root"), F.flatten(F.transform(F.col(p), lambda x: x["spans"])).alias("spans"),
                                        F.concat(F.col(f"{name}_root"), body).alias("fingerprint"))).drop(p, e, s, f"{name}_root")


def _weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(255)))


def likeness(a_root: Column, a: Column, b_root: Column, b: Column) -> Column:
    """1 exactly when the roots are equal; else the characters of the distinct
    spans that both trees have over those of the larger tree."""
    share = _weight(F.array_intersect(a, b)) / F.greatest(_weight(F.array_distinct(a)), _weight(F.array_distinct(b)), F.lit(1))
    below = 1 - 1 / (2.0 + F.greatest(F.size(a), F.size(b)))
    return F.when(a_root == b_root, 1.0).otherwise(F.least(share, below))


def edits(a: Column, b: Column) -> Column:
    """Spans of tree ``a`` (a struct of :func:`with_tree`) that ``b`` lacks, as
    (start, end) character ranges of a's text; equal roots: none."""
    lack = F.array_except(a["spans"], b["spans"])
    starts = F.transform(F.sequence(F.lit(1), F.size(a["spans"])), lambda i: F.struct(
        _weight(F.slice(a["spans"], F.lit(1), i - 1)).alias("start"), _weight(F.slice(a["spans"], F.lit(1), i)).alias("end"),
        F.element_at(a["spans"], i).alias("span")))
    found = F.filter(starts, lambda x: F.array_contains(lack, x["span"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when((a["root"] == b["root"]) | (F.size(a["spans"]) == 0), none).otherwise(
        F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """One row for each row of ``docs``: its fingerprint and that of its edited
    text, in which the next document's beginning replaces the last 1/``share``.

    Documents follow by id (null first), then by a hash of the text; after the
    last comes the first, and a single document follows itself.  Rows alike in
    both are one document, each row with the same result.  A null text counts
    as empty; an empty text's root is the digest of nothing.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    ids = stored(base.select("doc_id", "key", F.length("text").alias("n")).distinct(), "merkle-ids")
    last = ids.agg(F.max(F.struct("doc_id", "key", "n")).alias("x")).first()["x"]
    if last is None:
        last = (None, 0, 0)
    id_type = docs.schema[id_col].dataType
    order = sequence(ids, [], ["doc_id", "key"], lags=["doc_id", "key", "n"], pos_col="pos")
    first = F.col("pos") == 0
    links = stored(order.select(
        F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"),
        F.when(first, F.lit(last[0]).cast(id_type)).otherwise(F.col("prev_doc_id")).alias("of_id"),
        F.when(first, F.lit(last[1])).otherwise(F.col("prev_key")).alias("of_key"),
        F.floor(F.when(first, F.lit(last[2])).otherwise(F.col("prev_n")) / share).cast("int").alias("cut")), "merkle-links")
    after = base.join(links, base["doc_id"].eqNullSafe(links["next_id"]) & (base["key"] == links["next_key"]))
    after = with_tree(after, "text", "next").select("of_id", "of_key", F.expr("substring(text, 1, cut)").alias("head"),
                                                    F.col("next.root").alias("next_root"), F.col("next.spans").alias("next_spans"))
    if ids.count() != base.count():  # repeated rows: one of them is the next document
        after = after.dropDuplicates(["of_id", "of_key"])
    both = base.join(after, base["doc_id"].eqNullSafe(after["of_id"]) & (base["key"] == after["of_key"]))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited_text", F.concat(F.expr(f"substring(text, 1, cast(n_chars - floor(n_chars / {share}) as int))"), F.col("head")))
    both = with_tree(with_tree(both, "text", "tree"), "edited_text", "edited")
    return both.select(
        F.col("doc_id").alias(id_col), "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        F.col("tree.fingerprint").alias("fingerprint"), F.col("edited.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("tree.root"), F.col("tree.spans"), F.col("edited.root"), F.col("edited.spans")).alias("near_edited"),
        likeness(F.col("tree.root"), F.col("tree.spans"), F.col("next_root"), F.col("next_spans")).alias("near_next"))
