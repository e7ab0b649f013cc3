"""Secret scans with corpus-wide ownership frequency.

Patterns find candidate spans; a value's hash is then counted over the whole
corpus by distinct owners and repositories.  A value that several owners or many
repositories have is a copied example; one that a single owner has in few
repositories and that looks live is a credential.  Candidates of the broad ``token`` pattern become spans only by
that verdict; the spans of the base patterns always stay.  Values leave the
scan as SHA-256 hashes only.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import stored, text_of

#: Kind, pattern, least length of the value and the group that holds it, in the order of listing.
#: Where a run that is too short can hide no longer one, the pattern states the length itself.
BASE = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
]
#: Known token formats and long runs of mixed letters and digits; a span only if its owner alone has it.
TOKEN = ("token", r"(?:gh[pousr]_|xox[baprs]-|sk-|eyJ)[A-Za-z0-9_.-]{16,}|[A-Za-z0-9+/_-]{32,}", 20, 0)
#: Distinct owners from which a value is a copied example.
EXAMPLE_OWNERS = 3
#: Distinct repositories, within one owner too, from which a value is a copied example.
EXAMPLE_REPOSITORIES = 10
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|your|changeme|xxxx|1234567|abcdef|(.)\1{5}"
KINDS = [*BASE, TOKEN]


def _live_looking(value: Column) -> Column:
    """Letters and digits both, and no mark of a placeholder."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id) of all rows, and one row for each candidate: uid, owner,
    repository, kind (its number), start, end, hash, live_looking."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                       F.col(repository_col).cast("string").alias("repository"), text_of(text_col).alias("text"))
    for name, pattern, _, _ in KINDS:
        base = base.withColumn(f"found_{name}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    for name, pattern, _, _ in KINDS:  # what lies between the matches gives their places
        between = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
        base = base.withColumn(f"found_{name}", F.when(F.size(f"found_{name}") > 0, F.arrays_zip(F.col(f"found_{name}").alias("value"), F.slice(between, 1, F.size(f"found_{name}")).alias("gap"))))
    rows = stored(base.withColumn("uid", F.monotonically_increasing_id()).drop("text"), "secret-rows")
    out = None
    for number, (name, pattern, least, group) in enumerate(KINDS):
        one = rows.where(F.col(f"found_{name}").isNotNull()).select("uid", "owner", "repository", F.posexplode(f"found_{name}").alias("nth", "x"))
        # A window is the matches of one kind in one document.
        passed = F.sum(F.col("x.gap") + F.length("x.value")).over(Window.partitionBy("uid").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
        one = one.withColumn("end", passed.cast("long")).withColumn("start", F.col("end") - F.length("x.value"))
        value = F.regexp_extract("x.value", pattern, group) if group else F.col("x.value")
        one = one.withColumn("value", value).where(F.length("value") >= least)
        one = one.select("uid", "owner", "repository", F.lit(number).alias("kind"), "start", "end", F.sha2("value", 256).alias("hash"), _live_looking(F.col("value")).alias("live_looking"))
        out = one if out is None else out.unionByName(one)
    return rows.select("uid", "doc_id"), stored(out, "secret-candidates")


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(hash, owners, repositories, verdict) over all candidates: ``copied`` from
    ``example_owners`` distinct owners or ``example_repositories`` distinct
    repositories on, else ``live`` if a single owner has it and it looks so, else
    ``unsure``.  A null owner or repository counts as one.  Sums are partial
    at each step, so a value in a third of all rows is a few counters a task."""
    by_repository = found.groupBy("hash", "owner", "repository").agg(F.max("live_looking").alias("live_looking"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("live_looking").alias("live_looking"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"),
        F.when((F.count(F.lit(1)) >= example_owners) | (F.sum("repositories") >= example_repositories), "copied")
        .when((F.count(F.lit(1)) == 1) & F.max("live_looking"), "live").otherwise("unsure").alias("verdict"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, n_<kind> of each base kind,
    base_sha256, spans (kind:start:end, code points, end exclusive), n_live and
    n_copied (spans whose value is live, copied).

    A null text counts as empty and has no span.  Repeated rows each get a
    row.  An empty table gives an empty result; other columns are ignored.
    """
    rows, found = candidates(docs, id_col, text_col, owner_col, repository_col)
    verdicts = stored(ownership(found).select("hash", "verdict"), "secret-verdicts")
    found = found.join(verdicts, "hash").where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    # A further span inside one of the base patterns says nothing new.
    inside = F.max(F.when(F.col("kind") < len(BASE), F.col("end"))).over(Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("inside", inside).where((F.col("kind") < len(BASE)) | F.col("inside").isNull() | (F.col("inside") < F.col("end")))
    names = F.array(*[F.lit(n) for n, *_ in KINDS])

    def join(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    # A group is the spans of one document.
    of = found.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"), F.count_if(F.col("verdict") == "live").alias("live"),
        F.count_if(F.col("verdict") == "copied").alias("copied"), *[F.count_if(F.col("kind") == i).alias(f"n_{n}") for i, (n, *_) in enumerate(BASE)])
    out = rows.join(of, "uid", "left")
    zero = F.lit(0).cast("long")
    base = join(F.filter("all", lambda x: x["kind"] < len(BASE)))
    return out.select(
        F.col("doc_id").alias(id_col), *[F.coalesce(f"n_{n}", zero).alias(f"n_{n}") for n, *_ in BASE],
        F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"), F.coalesce(join(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("live", zero).alias("n_live"), F.coalesce("copied", zero).alias("n_copied"))
