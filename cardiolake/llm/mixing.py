"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.common import stored, words

#: Bits of the hash that each pass of histograms settles; together the 32 bits that the hash has.
STEPS = (12, 10, 10)


def hash32(doc_id: Column) -> Column:
    """The first 32 bits of md5 over the id as decimal text (null: empty text), as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: Sequence[float]) -> DataFrame:
    """sizes (source, source_size) with a target: share times all words by weight, `most` times its own at most.

    Weights repeat over the sources by code point, null last. The excess over a stop is dealt anew by weight until
    no target is above its stop: the level that every target meets but those that stop, found from running sums over
    the sources by the ratio of stop and weight.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int"))
    rated = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("stop") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything, upto = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    level = F.try_divide(
        F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("stop").over(upto) - F.col("stop")),
        F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight")),
    )
    levelled = rated.withColumn("nth", F.row_number().over(by_ratio)).withColumn("level", level)
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("nth", "level"))).over(everything)["level"]
    return levelled.withColumn("target", F.least("stop", F.coalesce(F.col("weight") * free, F.col("stop")))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = (5, 2, 1), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken added.

    A source's target is met by whole rounds over it (copies that every document gets) and by those documents whose
    hash lies under the source's threshold: of all thresholds the one whose words come nearest to the rest of the
    target, the lower one of a tie. Sums by source and hash bucket show the bucket that holds it; only that bucket's
    documents are summed again, by the next bits, until all 32 are settled. Nothing is sorted, and a larger target
    takes a superset. Documents of equal id share a hash and go together. A text that is null or empty has size 0 and
    is taken 0 words; it has copies by its hash like any other of its source, at most `most` rounded up. A source of which
    no text has a word has target 0 and no copies. An empty table gives no rows.
    Columns of the added names that docs has are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumns({"__h": hash32(F.col(key)), "size": words(F.col(text))})
    slim = stored(sized.select(F.col(source).alias("source"), "__h", "size"), "mix-sizes")
    by_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    rounds = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    # low: words under the threshold so far; at: the hash where the boundary bucket begins
    bounds = by_source.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")).withColumns({"low": F.lit(0).cast("long"), "at": F.lit(0).cast("long")})
    bounds = stored(bounds, "mix-bounds")
    left = 32
    for bits in STEPS:
        wide, left = left, left - bits
        near = F.broadcast(bounds) if _small(bounds) else bounds
        inside = slim.join(near.select(F.col("source").alias("__s"), "at"), F.col("source").eqNullSafe(F.col("__s")))
        inside = inside.where(F.shiftright(F.col("__h"), wide) == F.shiftright(F.col("at"), wide))
        histogram = inside.groupBy("source", F.shiftright(F.col("__h"), left).alias("bucket")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        summed = histogram.withColumn("upto", running).select(F.col("source").alias("__s"), "bucket", "words", "upto")
        # the boundary is the first bucket whose running sum passes the rest
        found = bounds.join(summed, F.col("source").eqNullSafe(F.col("__s")) & (F.col("low") + F.col("upto") > F.col("rest")), "left")
        first = F.min(F.struct("bucket", "words", "upto"))
        narrowed = found.groupBy("source", "source_size", "target", "rounds", "rest", "low", "at").agg(first.alias("b"))
        # none passes it: the threshold is the end of what this bucket spans, and nothing is left to refine
        bounds = stored(
            narrowed.select(
                "source", "source_size", "target", "rounds", "rest",
                F.coalesce(F.col("low") + F.col("b.upto") - F.col("b.words"), F.col("low")).alias("low"),
                F.coalesce(F.shiftleft(F.col("b.bucket"), left), F.col("at")).alias("at"),
                F.col("b.words").alias("step"),
            ),
            "mix-bounds",
        )
    # the boundary hash itself is in where that brings the sum nearer
    nearer = F.coalesce(F.col("low") + F.col("step") - F.col("rest") < F.col("rest") - F.col("low"), F.lit(False))
    # whole rounds that meet the target leave nothing to a threshold, not even documents without words
    under = F.when(F.col("rest") > 0, F.col("at") + nearer.cast("long")).otherwise(0)
    rules = bounds.select(F.col("source").alias("__s"), "source_size", "target", "rounds", under.alias("__under"))
    near = F.broadcast(rules) if _small(bounds) else rules
    copies = (F.col("rounds") + (F.col("__h") < F.col("__under")).cast("long")).cast("int")
    joined = sized.withColumn("__src", F.col(source)).join(near, F.col("__src").eqNullSafe(F.col("__s")))
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def _small(bounds: DataFrame, most_rows: int = 10_000) -> bool:
    """Whether a table of sources is small enough to broadcast; counted, not guessed."""
    return bounds.count() <= most_rows


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS stop FROM s),
r AS (SELECT *, stop / weight AS ratio FROM w),
l AS (
  SELECT *, row_number() OVER o AS nth,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - stop))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, source)),
f AS (SELECT arg_min(level, nth) AS free FROM l WHERE ratio > level),
t AS (SELECT source, source_size, least(stop, coalesce(weight * free, stop)) AS target FROM l, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM t),
c AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS step FROM d GROUP BY source, h),
b AS (
  SELECT q.source, arg_min(CASE WHEN c.upto - rest < rest - (c.upto - c.step) THEN c.h + 1 ELSE c.h END, c.h) AS under
  FROM (SELECT *, target - rounds * source_size AS rest FROM q) q JOIN c ON q.source IS NOT DISTINCT FROM c.source AND c.upto > rest GROUP BY q.source)
SELECT d.doc_id, d.size, q.source_size, q.target, ((q.rounds + CASE WHEN d.h < b.under THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
