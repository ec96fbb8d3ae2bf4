"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources, ordered by code point with null last, take the weights in turn and share a
multiple of all words; a target stops at ``most`` times its source's words and the excess goes to
the others by weight until none is above (water filling, solved in closed form by prefix sums over
the sources ordered by the level at which they fill up).

Rates: within a source longer documents are taken at a higher rate. A document's measure is the number
of binary digits of its size (at least 1), and its rate is the measure times the source's level, at most
``most``; the level, solved in closed form over the few measures, makes the expected words the target.

Samples: a rate gives a document its whole copies for certain; what is left is its inclusion rate pi.
Each document draws a repeatable uniform number u from its id and ranks by the odds ratio
q = (u / (1 - u)) / (pi / (1 - pi)); a source's sample takes documents in that order while the one at
hand reaches no more than half over the words still due. Ranks come from sums per source and bin of q,
and the bin that holds the boundary is divided again, LEVELS times; only rows of the last, about one
in 10^7 unless draws are equal, are ordered, so no source is ever gathered into one task.

Defined results: a null text has size 0; documents of size 0 take 0; equal draws are ordered by
doc_id and size; rows that repeat a doc_id share a draw; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, stay

#: Bins of the order per source and level, as a power of two, and levels.
BITS = 12
LEVELS = 2


def draw(doc_id: Column) -> Column:
    """A repeatable number strictly between 0 and 1: 52 bits of the MD5 of the id's decimal text."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size, target. The number of sources is taken as small."""
    n = len(weights)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % n + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.col("caps_before")) / F.col("weights_from"))
    # the first source that its level does not fill sets the level of all that are not full
    full = F.col("level") * F.col("weight") >= F.col("cap")
    s = s.withColumn("final", F.first(F.when(~full, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def source_rates(sizes: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """One row per source and measure of ``sizes`` (source, size, measure): source, measure, source_size, target, whole, pi, due."""
    m = sizes.groupBy("source", "measure").agg(F.sum("size").alias("words")).withColumnRenamed("source", "of")
    m = m.join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    # the measures that reach the most come first; the first that its level does not bring there sets the level
    order = Window.partitionBy("source").orderBy(F.desc("measure"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("measure")).over(order.rowsBetween(0, Window.unboundedFollowing))
    m = m.withColumns({"before": before, "rest": rest})
    m = m.withColumn("level", F.when(F.col("rest") > 0, (F.col("target") - F.lit(most) * F.col("before")) / F.col("rest")))
    free = F.col("level") * F.col("measure") < F.lit(most)
    m = m.withColumn("final", F.first(F.when(free, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rate = F.when(F.col("final").isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.0), F.col("final") * F.col("measure"))))
    m = m.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("pi", F.col("rate") - F.floor("rate"))
    sure = F.sum(F.col("words") * F.col("whole")).over(Window.partitionBy("source"))
    return m.select("source", "measure", "source_size", "target", "whole", "pi", (F.col("target") - sure).alias("due"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes), copies, source, and the columns ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = docs.select(*keep, F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sizes = cut(sizes.withColumn("measure", F.greatest(F.length(F.bin("size")), F.lit(1)).cast("long")), "sizes")
    rates = cut(source_rates(sizes, source_targets(sizes, weights, share, most), most), "rates")

    of = rates.select(F.col("source").alias("of"), F.col("measure").alias("by"), "source_size", "target", "whole", "pi", "due")
    u = draw(F.col("doc_id"))
    q = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    d = sizes.join(of, F.col("source").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("by"))).drop("of", "by")
    d = d.withColumn("q", F.when(F.col("pi") > 0, q)).withColumn("at", F.col("q") / (1 + F.col("q")))

    edge = rates.groupBy("source").agg(F.max("due").alias("due")).select(F.col("source").alias("of"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("before"), F.col("due").alias("goal"))
    for k in range(1, LEVELS + 1):
        inner, outer = F.floor(F.col("at") * (1 << BITS * k)), F.floor(F.col("at") * (1 << BITS * (k - 1)))
        within = d.where("pi > 0").join(edge, F.col("source").eqNullSafe(F.col("of")) & (outer == F.col("edge")))
        bins = within.groupBy("of", inner.alias("bin")).agg(F.sum("size").alias("words"), F.max("before").alias("start"), F.max("goal").alias("goal"))
        so_far = F.col("start") + F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = bins.withColumn("before", so_far).where("before <= goal and before + words > goal")
        edge = cut(edge.select("of", F.col("bin").alias("edge"), "before", "goal"), "edges")
    d = d.join(edge.drop("goal"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("bin", F.floor(F.col("at") * (1 << BITS * LEVELS)))
    at_edge = F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))
    inside = F.when(F.col("pi") > 0, F.coalesce(F.col("bin") < F.col("edge"), F.col("due") >= 0)).otherwise(False)
    sure = d.where(~at_edge).withColumn("more", inside)
    running = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    close = d.where(at_edge).withColumn("more", 2 * (F.col("before") + running) + F.col("size") <= 2 * F.col("due"))
    copies = (F.col("whole") + F.col("more").cast("long")).cast("long")
    return sure.unionByName(close).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", *keep)


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    table = stay(docs, "mixed")
    taken = mix(table.select("part", "idx", "row.doc_id", "row.source", "row.text"), weights, share, most, keep=("part", "idx")).where("copies > 0").select("part", "idx", F.sequence(F.lit(1), "copies").alias("_times"))
    return table.join(taken, ["part", "idx"]).select("row", F.explode("_times")).select("row.*")


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
k AS (SELECT l.*, (SELECT level FROM l WHERE NOT level * weight >= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM k),
g AS (SELECT source, greatest(length(ltrim(bin(size), '0')), 1)::BIGINT AS measure, sum(size)::BIGINT AS words FROM sizes GROUP BY 1, 2),
n AS (SELECT g.*, source_size, target, coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    (sum(words * measure) OVER (PARTITION BY g.source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, CASE WHEN rest > 0 THEN (target - 2.0::DOUBLE * before) / rest END AS level FROM n),
f AS (SELECT v.*, first_value(CASE WHEN level * measure < 2.0 THEN level END IGNORE NULLS) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM v),
r AS (SELECT *, CASE WHEN final IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, greatest(0.0::DOUBLE, final * measure)) END AS rate FROM f),
p AS (SELECT source, measure, source_size, target, floor(rate) AS whole, rate - floor(rate) AS pi, target - sum(words * floor(rate)) OVER (PARTITION BY source) AS due FROM r),
d AS (SELECT doc_id, size, source_size, target, whole, due, pi, p.source, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q
  FROM sizes JOIN p ON sizes.source IS NOT DISTINCT FROM p.source AND greatest(length(ltrim(bin(size), '0')), 1) = measure),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN pi > 0 AND 2 * before + size <= 2 * due THEN 1 ELSE 0 END))::BIGINT AS taken,
  (whole + CASE WHEN pi > 0 AND 2 * before + size <= 2 * due THEN 1 ELSE 0 END)::BIGINT AS copies, source
FROM o
"""
