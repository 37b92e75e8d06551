"""Audit of filters that interact: what each removes at each step of every order in which they can be applied.

Documents are reduced to counts per part and combination of failures. SQL's CUBE over the failure flags and the part gives, for each
subset of the filters, how many documents fail none of it: that is the grouping set of the subset, in the row where all of its flags
are false. A step from subset S to S and one filter more is a join of the two rows, and a step of an order is one of those pairs.

Results in special cases:

- A null text is empty, a null source is the part ''. An empty text fails A alone (and E, if another one has a smaller id).
- E asks for a smaller doc_id with the same text. Rows that repeat id and text don't make each other fail; a row without an id has no
  smaller id, and is none. Texts are compared by SHA-256.
- A document is good (toxic) if any row of labels says so. An empty table has no parts, so there are no rows.
- Columns besides doc_id, text and source, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: str) -> dict[str, Column]:
    """Filters A to D: which of them a text (not null) fails."""
    words = F.split(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    none = words[0] == ""
    chars = F.char_length(text)
    return {
        "A": none | (n < 200),
        "B": ~none & (100 * distinct < 50 * n),
        "C": 100 * (chars - F.char_length(F.translate(F.col(text), UPPER, ""))) > 2 * chars,
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents by part and failures.

    Texts leave the scan as digests and flags; rows that agree are summed before each shuffle, so neither a large source nor a large
    group of copies meets in one task."""
    rows = docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(f) for f, c in text_failures("text").items()])
    flags = list("ABCD")
    rows = rows.groupBy("doc_id", "digest", "part", *flags).agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marks, rows["doc_id"] == marks["_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    has_id = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", *flags, "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("with_id"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first")
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("again", F.col("with_id") - F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0))
    entry = lambda fails, n: F.struct(F.lit(fails).alias("E"), n.alias("n"))
    split = groups.select("part", *flags, "good", "toxic", F.inline(F.array(entry(False, F.col("n") - F.col("again")), entry(True, F.col("again")))))
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(mark)
    return split.where("n > 0").groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic) for every part and subset of filters, as a bit mask: documents that fail none of the subset."""
    cubed = counts.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], *[F.grouping(c).alias(f"without_{c}") for c in ("part", *FILTERS)])
    passing = F.lit(True)
    for f in FILTERS:
        passing = passing & ((F.col(f"without_{f}") == 1) | ~F.col(f))
    subset = sum(((1 - F.col(f"without_{f}")) * bit(f) for f in FILTERS), F.lit(0)).cast("int")
    found = cubed.where((F.col("without_part") == 0) & passing).select("part", subset.alias("subset"), "n", "good", "toxic")
    every = counts.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return every.join(found, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step (see the module and the query's contract for the columns)."""
    spark = docs.sparkSession
    sets = written(survivors(written(combinations(docs, labels), "audit-counts")), "audit-sets")
    k = len(FILTERS)
    edges = [(f, s, s | bit(f), math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())) for f in FILTERS for s in range(ALL + 1) if not s & bit(f)]
    edges = F.broadcast(spark.createDataFrame(edges, "filter string, subset int, larger int, orders long"))
    before = sets.select("part", "subset", *[F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")])
    after = sets.select("part", F.col("subset").alias("larger"), "n", "good", "toxic")
    pairs = before.join(edges, "subset").join(after, ["part", "larger"])
    pairs = pairs.select("part", "filter", "subset", "orders", F.col("n").alias("kept"), *[(F.col(f"{c}_before") - F.col(c)).alias(d) for c, d in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    at = lambda s: F.sum(F.when(F.col("subset") == s, F.col("removed")).otherwise(0))
    alone = F.lit(ALL) - F.element_at(F.create_map(*[F.lit(x) for f in FILTERS for x in (f, bit(f))]), F.col("filter"))
    whole = pairs.groupBy("part", "filter").agg(at(0).alias("fails"), at(alone).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [("".join(o), i + 1, f, sum(bit(x) for x in o[:i])) for o in itertools.permutations(FILTERS) for i, f in enumerate(o)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, subset int"))
    return (
        pairs.join(steps, ["filter", "subset"]).join(whole, ["part", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
