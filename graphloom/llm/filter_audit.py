"""How filters on documents work together: what each removes in every order, and its fair share, by multilinear extension.

Each document is reduced to a mask of the filters that it fails. For a part of the table the masks' counts c(m) make the
removal polynomial f(x) = sum of c(m) * (1 - product of (1 - x_i) for i in m), linear in each x_i. Its value at a corner
(x_i = 1 for the filters applied so far, 0 else) is how many documents those filters remove, which gives the survivors of
every step of every order. The Shapley value of filter i is the integral of df/dx_i along the diagonal from 0 to 1, taken
with exact rationals; times the number of orders it is a whole number, the filter's removals added up over all orders.

Masks, parts and labels are counted by Spark with one narrow row for each document; texts are read once and never
shuffled. Copies of a text are found by its SHA-256 and least doc_id: the digests are counted within each task before the shuffle and
meet again by (digest, doc_id), so a group of copies of any size lies in no one task. The polynomial is worked out for each part from at
most 2^filters counts.

A null text is empty, a null part the empty string. A null doc_id is no smaller id than any other, and no id is smaller
than it: such rows are no copies and make none. Rows with one doc_id and one text are copies of the smaller ids alone, not of each
other. Repeated rows count each. A doc_id with several labels counts as good (or toxic) if any of them says so; without
labels it is neither. Texts of any length are worked off whole. An empty table gives no rows. Other columns are not read, so none clashes.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialise, table

#: White space between words (fixed by the contract).
BLANKS = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 8
Test = Callable[[Column], Column]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def size(values: Column) -> Column:
    return F.size(values).cast("long")


#: Failure conditions on a text, by letter; None: the text is a copy of a smaller id's.
FILTERS: dict[str, Test | None] = {
    "A": lambda t: size(words_of(t)) < 50,
    "B": lambda t: size(F.array_distinct(words_of(t))) * 100 < size(words_of(t)) * 65,
    "C": lambda t: F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") * 100 > F.length(t).cast("long") * 5,
    "D": lambda t: t.rlike("[#$%&*|]"),
    "E": None,
}


class RemovalPolynomial:
    """f as coefficients by set of variables (a bit mask): f(x) = sum of a[T] * product of x_i for i in T."""

    def __init__(self, counts: dict[int, int], filters: int) -> None:
        self.n, self.total = filters, sum(counts.values())
        above = [0] * (1 << filters)  # documents that fail all filters of a set
        for mask, n in counts.items():
            above[mask] += n
        for i in range(filters):
            for s in range(1 << filters):
                if not s >> i & 1:
                    above[s] += above[s | 1 << i]
        self.a = [0] + [above[t] if t.bit_count() % 2 else -above[t] for t in range(1, 1 << filters)]
        self.corners = list(self.a)  # sums over subsets
        for i in range(filters):
            for s in range(1 << filters):
                if s >> i & 1:
                    self.corners[s] += self.corners[s ^ 1 << i]

    def removed(self, applied: int) -> int:
        """f at a corner: how many documents fail one of the filters applied."""
        return self.corners[applied]

    def derivative(self, i: int) -> dict[int, int]:
        """df/dx_i on the diagonal x = (t, ..., t): coefficients by power of t."""
        out: dict[int, int] = {}
        for t, a in enumerate(self.a):
            if t >> i & 1 and a:
                out[t.bit_count() - 1] = out.get(t.bit_count() - 1, 0) + a
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of df/dx_i along the diagonal."""
        return sum((Fraction(a, power + 1) for power, a in self.derivative(i).items()), Fraction(0))


def audit_rows(part: str, counts: dict[str, dict[int, int]], letters: str) -> list[tuple]:
    """All steps of all orders for a part, from its counts by mask of all documents, good ones and toxic ones."""
    n, f = len(letters), {k: RemovalPolynomial(c, len(letters)) for k, c in counts.items()}
    every, whole = f["all"], (1 << n) - 1
    fair = [every.shapley(i) * factorial(n) for i in range(n)]
    assert all(x.denominator == 1 for x in fair)
    out = []
    for order in permutations(range(n)):
        applied = 0
        for step, i in enumerate(order, 1):
            after = applied | 1 << i
            here = {k: p.removed(after) - p.removed(applied) for k, p in f.items()}
            fails, alone = every.removed(1 << i), every.removed(whole) - every.removed(whole ^ 1 << i)
            out.append((part, "".join(letters[j] for j in order), step, every.total - every.removed(after), here["all"], fails - here["all"], alone, here["good"], here["toxic"], int(fair[i])))
            applied = after
    return out


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Test | None] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters that they fail, bit i for the i-th filter."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = reduce(lambda a, b: a + b, [F.coalesce(test(F.col("t")), F.lit(False)).cast("int") * (1 << i) for i, test in enumerate(filters.values()) if test], F.lit(0))
    copies = next((i for i, test in enumerate(filters.values()) if test is None), None)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("t")).select("id", "part", own.alias("mask"), F.sha2("t", 256).alias("body"))
    judged = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    with Scratch(docs.sparkSession) as scratch:
        counted = scratch.put("masks", rows.groupBy("body", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
        if copies is not None:
            least = counted.where("id IS NOT NULL").groupBy("body").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
            counted = counted.join(least, ["body", "id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << copies).otherwise(0))
        named = counted.join(judged, "id", "left")
        sums = named.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))
        return materialise(sums, "mask-counts")


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Test | None] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    if not 0 < len(filters) <= MOST_FILTERS or sum(t is None for t in filters.values()) > 1 or any(len(x) != 1 for x in filters):
        raise ValueError(f"filters are 1 to {MOST_FILTERS} single letters, at most one of them for copies")
    letters = "".join(filters)
    counted = mask_counts(docs, labels, filters, key, text, part)
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 2^filters entries

    def work(batches):
        for batch in batches:
            for p, entries in zip(batch["part"], batch["counts"], strict=True):
                counts = {name: {e["mask"]: e[c] for e in entries} for name, c in (("all", "n"), ("good", "good"), ("toxic", "toxic"))}
                yield pd.DataFrame(audit_rows(p, counts, letters), columns=NAMES)

    return by_part.mapInPandas(work, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in NAMES[3:]))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
least_ids AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 5 * length(w.t))::INT
    + 8 * regexp_matches(w.t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(lab.toxic, 0) AS toxic
  FROM w JOIN least_ids ON w.t = least_ids.t LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM {_LETTERS} a(l, b), {_LETTERS} b(l, b), {_LETTERS} c(l, b), {_LETTERS} d(l, b), {_LETTERS} e(l, b)
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b <> b.b AND a.b <> c.b AND a.b <> d.b AND a.b <> e.b AND b.b <> c.b AND b.b <> d.b AND b.b <> e.b AND c.b <> d.b AND c.b <> e.b AND d.b <> e.b),
steps AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[:step - 1]) AS before FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)),
s AS (SELECT filter_order, step, own, coalesce(before, 0)::INT AS before FROM steps)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(n) FILTER (WHERE mask & (before | own) = 0) AS BIGINT) AS kept_, coalesce(CAST(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS BIGINT), 0) AS removed,
  coalesce(CAST(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0) AS BIGINT), 0) AS redundant, coalesce(CAST(sum(n) FILTER (WHERE mask = own) AS BIGINT), 0) AS unique_fails,
  coalesce(CAST(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS BIGINT), 0) AS good_lost, coalesce(CAST(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS BIGINT), 0) AS toxic_lost,
  coalesce(CAST(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (WHERE mask & own <> 0) AS BIGINT), 0) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
SQL = "SELECT part, filter_order, step, coalesce(kept_, 0) AS kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM (" + SQL + ")"
