"""Mixing sources to target weights, by size in tokens.

Every document gets a hash-random key.  Within a source documents are taken in the order of
their keys until the source's budget is reached; a budget above the size of the source first
takes all documents whole epochs long.  The order is cut by distributed prefix sums: keys are
range-split into cells, sizes are summed per cell, cells are summed up in order, and only
then is a running sum formed inside each cell, so a source of any size is never sorted as one
group.

Without ``total_tokens`` the mix is as large as the caps on repeats allow with every share
met: the source that runs out first sets the size of the whole.  With ``total_tokens`` that is
the size asked for, and a source that cannot give its part gives all it may, its shortfall is
reported, and the others' parts stay what they are.

Defined results
  * source names are compared without case and with any run of other characters as ``_``; a
    NULL or blank name belongs to no target;
  * documents without tokens (NULL, empty) are not used;
  * a target without documents gets nothing; target shares and budgets are both relative to
    the weights of the targets that can contribute; targets with a NULL, zero or negative weight
    get nothing, a NULL or negative ``max_repeats`` counts as 0;
  * of targets whose names are the same the weights add up and the smallest cap holds;
  * the document at the cut is taken if that brings the source nearer to its budget;
  * equal keys are ordered by the document's id; rows with one id count once;
  * no documents or no targets give an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.llm.bpe import count_tokens
from massweave.plans.runtime import cut_lineage, small_enough, split_hot

#: Documents of a source that one key cell holds on average.
CELL_DOCUMENTS = 20_000

#: Largest table of targets that is sent to all executors.
MOST_TARGETS = 100_000


def source_name(c: Column) -> Column:
    """The name under which spellings of a source are the same; NULL for a blank one."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(name != "", name)


def sized_documents(documents: DataFrame, seed: int = 7, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(source, doc_id, key, n_tokens)`` of every document, written once."""
    rows = documents.where(F.col("doc_id").isNotNull()).select(source_name(F.col("source")).alias("source"), "doc_id", "text")
    sized = count_tokens(rows, name=name, folder=folder)
    one = sized.groupBy("doc_id").agg(F.min(F.struct("n_tokens", "source")).alias("r"))
    return cut_lineage(one.select("r.source", "doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("key"), "r.n_tokens"))


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """The budget of each target with a name.

    ``(source, weight, max_repeats, tokens, target_share, budget, epochs, rest)``: ``epochs``
    whole uses of all documents and ``rest`` tokens of a further one come to the budget, or
    to all the source may give.
    """
    totals = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("m"))
        .where("source IS NOT NULL")
        .groupBy("source")
        .agg(
            F.coalesce(F.sum(F.when((F.col("w") > 0) & (F.col("w") < float("inf")) & ~F.isnan("w"), F.col("w"))), F.lit(0.0)).alias("weight"),
            F.greatest(F.min("m"), F.lit(0)).alias("max_repeats"),
        )
    )
    rows = cut_lineage(wanted.join(totals, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))))
    usable = F.expr("weight > 0 AND max_repeats > 0 AND tokens > 0")
    most = F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("weight")))
    sums = rows.agg(F.sum(F.when(usable, F.col("weight"))).alias("weights"), most.alias("most")).first()
    weights = sums["weights"] or 1.0
    whole = (sums["most"] or 0.0) * weights if total_tokens is None else float(total_tokens)
    share = F.when(usable, F.col("weight") / F.lit(weights)).otherwise(0.0)
    epochs = F.when(usable, F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.col("tokens")))).otherwise(0).cast("int")
    rest = F.when(usable & (F.col("epochs") < F.col("max_repeats")), F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("tokens"))).otherwise(0.0)
    # One row for each target.
    return cut_lineage(rows.withColumn("target_share", share).withColumn("budget", F.col("target_share") * F.lit(whole)).withColumn("epochs", epochs).withColumn("rest", rest))


def mix(sized: DataFrame, plan: DataFrame, cell_documents: int = CELL_DOCUMENTS) -> DataFrame:
    """``(doc_id, source, n_tokens, uses)`` of every document that is used at least once."""
    bits = max(1, math.ceil(math.log2(max(1, sized.count()) / cell_documents + 1)))
    some = plan.where("epochs > 0 OR rest > 0").select("source", "epochs", "rest")
    documents = sized.where("n_tokens > 0 AND source IS NOT NULL")
    if small_enough(some, MOST_TARGETS):
        joined = documents.join(F.broadcast(some), "source")
    else:
        documents, some = split_hot(documents, some, ["source"], "doc_id")
        joined = documents.join(some, ["source", "_salt"]).drop("_salt")
    rows = joined.withColumn("cell", F.shiftright(F.col("key"), 64 - bits))
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("source", "cell").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    offsets = (
        rows.groupBy("source", "cell")
        .agg(F.sum("n_tokens").alias("n"))
        .select("source", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    end = F.col("offset") + F.col("inside")
    start = end - F.col("n_tokens")
    more = (end <= F.col("rest")) | ((start < F.col("rest")) & (end - F.col("rest") < F.col("rest") - start))
    return (
        rows.withColumn("inside", F.sum("n_tokens").over(inside))
        .join(offsets, ["source", "cell"])
        .select("doc_id", "source", "n_tokens", (F.col("epochs") + more.cast("int")).alias("uses"))
        .where("uses > 0")
    )


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each target: target and actual share, budget, tokens, shortfall, and how often documents are used.

    ``shortfall_tokens`` is what a source lacks to its budget because its documents may not
    be used more often, 0 where it can give all.
    """
    used = cut_lineage(
        mixed.groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses")
        )
    )
    whole = used.agg(F.sum("used_tokens")).first()[0]
    rows = plan.join(used, "source", "left").fillna(0, ["used_tokens", "n_documents", "most_uses"])
    return rows.select(
        "source",
        "target_share",
        F.col("tokens").alias("available_tokens"),
        F.col("budget").alias("budget_tokens"),
        "max_repeats",
        "used_tokens",
        "n_documents",
        "most_uses",
        F.greatest(F.lit(0.0), F.col("budget") - F.col("max_repeats") * F.col("tokens")).alias("shortfall_tokens"),
        F.coalesce(F.try_divide(F.col("used_tokens"), F.lit(whole)), F.lit(0.0)).alias("actual_share"),
    )
