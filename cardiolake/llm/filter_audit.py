"""Interaction of filters: what each one removes, in every order of the filters, from one CUBE over failure flags."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.common import WORD, stored

#: Most filters: n of them have n! orders.
MOST_FILTERS = 6


def failure_flags(text: str = "text") -> dict[str, Column]:
    """Failure conditions of single texts (null: empty), by letter.

    A: under 100 words. B: distinct words are under 80 % of the words. C: A-Z over 10 % of the code points.
    D: one of #$%&*|.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    all_words = F.regexp_extract_all(whole, F.lit(f"({WORD})"))
    n = F.size(all_words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(all_words)) * 100 < n * 80,
        "C": F.regexp_count(whole, F.lit("[A-Z]")) * 100 > F.length(whole) * 10,
        "D": whole.rlike(r"[#$%&*|]"),
    }


def subset_survivors(groups: DataFrame, flags: list[str], part: str, counts: list[str]) -> DataFrame:
    """part, mask and counts: for each part (null: all parts) and each subset of filters, the rows that pass all of the subset.

    groups: one row a part and combination of flags, with counts. A bit of mask is set where a filter is in the subset
    (the first flag is bit 0). Subsets that nothing passes have zeros.
    """
    cubed = groups.cube(part, *flags).agg(F.grouping(part).alias("__rolled"), *[F.grouping(f).alias(f"__without_{f}") for f in flags], *[F.sum(c).alias(c) for c in counts])
    passed = F.lit(True)
    mask = F.lit(0)
    for k, f in enumerate(flags):
        passed &= (F.col(f"__without_{f}") == 1) | ~F.col(f)
        mask = mask + (1 - F.col(f"__without_{f}").cast("int")) * (1 << k)
    own = stored(cubed.where(passed).select(F.when(F.col("__rolled") == 0, F.col(part)).alias(part), mask.alias("mask"), *counts), "audit-subsets")
    every = own.where("mask = 0").select(part, F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))).alias("mask"))
    joined = every.alias("e").join(own.alias("o"), F.col(f"e.{part}").eqNullSafe(F.col(f"o.{part}")) & (F.col("e.mask") == F.col("o.mask")), "left")
    return stored(joined.select(f"e.{part}", "e.mask", *[F.coalesce(f"o.{c}", F.lit(0)).alias(c) for c in counts]), "audit-survivors")


def audit(docs: DataFrame, labels: DataFrame, flags: dict[str, Column] | None = None, copies: str = "E", part: str = "lang", text: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part (each value of the column `part`; null counts as ''; null stands for all parts together),
    each order of the filters, applied from left to right, and each step. flags: failure conditions on docs by
    letter; the filter `copies` fails texts that a row of smaller doc_id has too, in the whole table. Counts of rows
    in the part: kept behind the step, removed by it, redundant (fail its filter, removed before), unique_fails (fail
    its filter alone), good_lost and toxic_lost (removed by it and labelled quality 1, toxic 1), shapley (removed by
    its filter, summed over all orders). MOST_FILTERS filters at most.

    Texts are read once: a row becomes its flags and the hash of its text, rows of one id, text, part are counted,
    then rows of equal flags, before the CUBE. Null texts are empty. Rows without an id aren't copies of others, nor
    labelled; several labels of one id count if any of them is 1. Repeated rows (one id and text) all count, and
    aren't copies of each other. An empty table gives no rows. Other columns of docs play no part.
    """
    flags = failure_flags(text) if flags is None else flags
    names = [*flags, copies]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    tid = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    read = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), tid.alias("__tid"), *[c.alias(f) for f, c in flags.items()])
    one = stored(read.groupBy("doc_id", "__tid", "part", *flags).agg(F.count("*").alias("n")), "audit-rows")
    # the first row of each text: the key of this join, text and id, has few rows however many copies a text has
    first = one.where("doc_id is not null").groupBy("__tid").agg(F.min("doc_id").alias("doc_id")).withColumn("__first", F.lit(True))
    copied = one.join(first, ["__tid", "doc_id"], "left").withColumn(copies, F.col("doc_id").isNotNull() & F.col("__first").isNull())
    by_id = copied.groupBy("doc_id", "part", *names).agg(F.sum("n").alias("n"))
    marks = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(f"__{c}") for c in ("quality", "toxic")])
    lost = {f"n_{c}": F.sum(F.col("n") * F.coalesce(f"__{c}", F.lit(0))).alias(f"n_{c}") for c in ("quality", "toxic")}
    groups = by_id.join(marks, "doc_id", "left").groupBy("part", *names).agg(F.sum("n").alias("n"), *lost.values())
    return steps_of(subset_survivors(groups, names, "part", ["n", *lost]), names)


def steps_of(survivors: DataFrame, names: list[str]) -> DataFrame:
    """The audit's rows from the survivors of each subset: a step joins the subset before it with that behind it."""
    whole = (1 << len(names)) - 1
    steps = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(names[i] for i in order), k + 1, before, before | 1 << f, 1 << f, whole ^ (1 << f)))
            before |= 1 << f
    # n! * n rows, 4,320 at most
    plan = F.broadcast(survivors.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, after int, own int, others int"))
    slim = lambda prefix, *counts: survivors.select(F.col("part").alias(f"__{prefix}"), F.col("mask").alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in counts])
    rows = survivors.withColumnRenamed("mask", "before").join(plan, "before")
    for prefix, counts in (("after", ("n", "n_quality", "n_toxic")), ("own", ("n",)), ("others", ("n",))):
        found = slim(prefix, *counts)
        rows = rows.join(found, F.col("part").eqNullSafe(F.col(f"__{prefix}")) & (rows[prefix] == found[prefix])).drop(f"__{prefix}", found[prefix])
    every = slim("none", "n").where("none = 0")
    last = slim("all", "n").where(F.col("all") == whole)
    for prefix, found in (("none", every), ("all", last)):
        rows = rows.join(found, F.col("part").eqNullSafe(F.col(f"__{prefix}"))).drop(f"__{prefix}", prefix)
    removed = F.col("n") - F.col("after_n")
    out = rows.select("part", "filter_order", "step", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("none_n") - F.col("own_n") - removed).alias("redundant"), (F.col("others_n") - F.col("all_n")).alias("unique_fails"), (F.col("n_quality") - F.col("after_n_quality")).alias("good_lost"), (F.col("n_toxic") - F.col("after_n_toxic")).alias("toxic_lost"), "own")
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def _sql(letters: str = "ABCDE") -> str:
    """The same rows by another way: every order is played through on the groups of equal flags."""
    picks = " UNION ALL ".join(f"SELECT '{c}' AS f" for c in letters)
    order = " || ".join(f"{c}.f" for c in "pqrst")
    apart = " AND ".join(f"{a}.f <> {b}.f" for a, b in itertools.combinations("pqrst", 2))
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END) || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN min(d.doc_id) OVER (PARTITION BY text) < d.doc_id THEN 'E' ELSE '' END) AS fails FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL), f AS ({picks}),
o AS (SELECT {order} AS filter_order FROM f p, f q, f r, f s, f t WHERE {apart}), s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) z(step)),
c AS (SELECT part, filter_order, step, own, sum(CASE WHEN hit OR before THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT before THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT *, contains(fails, own) AS hit, length(translate(earlier, fails, '')) < length(earlier) AS before FROM g, s) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c"""


ORACLE_SQL = _sql()
