"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

A source whose target is k times its size and a remainder gives k complete epochs; the remainder is drawn without
replacement with probabilities that follow a quality weight w: documents are taken in ascending order of the
exponential key -ln(u) / w until the remainder is used up. u comes from a hash of the document, so reruns agree.

The prefix sums over a source never run over the whole source in one task: keys fall into a fixed number of
buckets per source, sizes are summed per bucket, and only the one bucket in which the remainder ends is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import written

WORD = r"[^\x20\x09-\x0D]+"
#: Key buckets per source. A source of n documents sorts about n / BUCKETS of them in one task.
BUCKETS = 4096
#: Up to so many sources, their plan (one row each) is broadcast.
MANY_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, size): (source, source_size, target).

    Sources are ordered by code point, null last, and weigh ``weights``, repeating. They share ``share`` times the
    total by weight; a target stops at ``most`` times its source's size, and the excess is shared by weight among
    the others until none is above. One row per source goes through a single task here, never one per document.

    Being above is monotone: if a source is filled up, so is each one of a smaller ratio of size to weight. With
    sources in that order, the first that is not filled up gives the rate at which all later ones share what is left.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    # collect_list over one row per source: the number of sources is that of the mix's weights table.
    everything = totals.agg(F.sum("source_size").alias("all"), F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), F.col("source").cast("binary").alias("code"), "source", "source_size"))).alias("s"))
    at = everything.select("all", F.posexplode("s").alias("i", "s")).select("all", F.col("s.source").alias("source"), F.col("s.source_size").alias("source_size"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).alias("weight"))
    by_ratio = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    rated = at.withColumn("filled", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(after))
    rated = rated.withColumn("rate", (F.col("all") * share - F.col("filled") * most) / F.col("left_weight"))
    rated = rated.withColumn("open", F.col("rate") * F.col("weight") <= F.col("source_size") * most)
    first = F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    capped = F.col("source_size") * F.lit(float(most))
    return rated.withColumn("rate", first).select("source", "source_size", F.when(F.col("rate").isNull(), capped).otherwise(F.least(F.col("rate") * F.col("weight"), capped)).alias("target"))


def text_quality(text: Column, least: float = 0.1) -> Column:
    """A weight from ``least`` to 1 that falls with the share of symbols among the characters; 1 for null and empty texts."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), F.lit(0))
    return F.greatest(F.lit(least), 1 - 10 * symbols / F.greatest(F.lit(1), F.coalesce(F.char_length(text), F.lit(0))))


def _planned(docs: DataFrame, quality: Column | None, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """``row`` (all columns of docs as a struct), size, source_size, target, copies."""
    w = F.coalesce((text_quality(F.col("text")) if quality is None else quality).cast("double"), F.lit(1.0))
    # u lies in (0, 1]: 52 bits of a hash of the document.
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    u = (F.shiftrightunsigned(hashed, 12) + 1) / F.lit(float(1 << 52))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("source").alias("s"), n_words(F.col("text")).alias("size"), hashed.alias("u"), (-F.log(u) / w).alias("key"))
    # 1 - exp(-key) lies in [0, 1), grows with the key and spreads it.
    keyed = keyed.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))

    # First pass: sums alone, at most BUCKETS rows per source, written once.
    sums = written(keyed.groupBy("s", "bucket").agg(F.sum("size").alias("n")), "mix-sums")
    targets = source_targets(sums.select(F.col("s").alias("source"), F.col("n").alias("size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = sums.withColumn("end", F.sum("n").over(up_to))
    border = ends.join(targets, ends["s"].eqNullSafe(targets["source"])).groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "epochs", "rest")],
        # The bucket in which the rest ends, and the words before it.
        F.min(F.when(F.col("end") > F.col("rest"), F.struct("bucket", (F.col("end") - F.col("n")).alias("start")))).alias("border"),
    )
    # One row per source. Up to MANY_SOURCES of them go to all executors, more are joined by a shuffle.
    few = sums.select("s").distinct().limit(MANY_SOURCES + 1).count() <= MANY_SOURCES
    planned = keyed.join(F.broadcast(border) if few else border, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")

    # Second pass: whole buckets below the border are in, those above are out, and the border's own is ranked.
    at = F.col("border.bucket")
    is_border = F.coalesce(F.col("bucket") == at, F.lit(False))
    clear = planned.where(~is_border).withColumn("more", F.when(at.isNull() | (F.col("bucket") < at), 1).otherwise(0))
    rank = W.partitionBy("s", "bucket").orderBy("key", "u").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = planned.where(is_border).withColumn("upto", F.col("border.start") + F.sum("size").over(rank))
    ranked = ranked.withColumn("more", F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("upto")
    return clear.unionByName(ranked).select("row", "size", "source_size", "target", (F.col("epochs") + F.when(F.col("rest") > 0, F.col("more")).otherwise(0)).alias("copies"))


def mix(docs: DataFrame, quality: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """docs (with doc_id, text, source) and columns size, source_size, target, taken, copies.

    taken counts the words that the mix takes of the row's text, repeats included: copies times size. The row at
    which the rest of a source ends is taken if that brings the source nearer to its target than leaving it.
    ``quality`` is a column expression over docs, above 0 (default: text_quality). Repeated rows are separate
    documents whose keys tie, so all but those at the border are taken alike. Null ids, texts and sources are
    fine (a null text has size 0). Columns of docs that have one of the new names are replaced. An empty table
    gives no rows. Documents move between tasks only if they lie in the border's bucket of their source.
    """
    out = _planned(docs, quality, weights, share, most, seed)
    names = ["size", "source_size", "target", "taken", "copies"]
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in names]
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*kept, *names)


def mixed_rows(docs: DataFrame, quality: Column | None = None, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    args = {"weights": (3, 1, 2), "share": 1.5, "most": 2.0, "seed": 17} | options
    out = _planned(docs, quality, **args)
    out = out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
