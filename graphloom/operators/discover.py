"""Keys and foreign keys found in the rows of tables.

Foreign keys are inclusion dependencies: all values of a column occur in a unique column of some table. Ranges and sketches of
all columns, one pass for each table, leave the columns that can be in such a pair. Their distinct values are put together as (value, set of
columns that have it), counted by the set, and a column's possible targets are what all sets with it have in common. A value that many rows or
columns have is put together within each task first.

Keys are searched level by level from single columns to sets of `most`; a set is no candidate if a part of it is unique (it isn't
least). Two rows that are alike in a set are enough to drop it: they are looked for among some rows on the driver, then among the rows that have one of
many hashes. What is left is unique or nearly so, and decided over all rows: hashes of a set's values are
sorted within partitions, and those that come twice are looked up by value, since values that differ may share a hash.

Null is no value: a foreign key may have nulls, a key may not. Tables without rows have no keys. Columns of arrays, maps and structs are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import Workspace

#: How far apart the estimates of two columns' values may lie (five standard errors), and the sketches' slots.
SLACK, SLOTS = 0.08, 12
#: Rows and cells that the driver looks at; sets for one scan; hashes that the first passes look at, and the share of the rows from which on values are looked at instead.
SEEN, CELLS, IN_SCAN, FIRST, FEW = 100_000, 2_000_000, 4, (4_000_000, 32_000_000), 16
#: Sets whose hashes are sorted in one pass (a power of two), hashes in a pass (but for a single set's) and in a task, the column of lots.
AT_ONCE, HASHES, IN_TASK, LOT = 16, 100_000_000, 1_000_000, "__lot"
#: Types whose values can be compared, by a common name.
FAMILIES = {T.ByteType: "whole", T.ShortType: "whole", T.IntegerType: "whole", T.LongType: "whole", T.StringType: "text", T.DateType: "date", T.TimestampType: "time", T.TimestampNTZType: "time", T.BooleanType: "boolean", T.FloatType: "number", T.DoubleType: "number", T.DecimalType: "number"}


def family(kind: T.DataType) -> str | None:
    return FAMILIES.get(type(kind))


def _about(column: Column) -> Column:
    """About how many different values; sketchable types are texts and whole numbers, others go by their hash."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(column)), F.lit(SLOTS)))


def column_facts(df: DataFrame, columns: list[str]) -> list[dict]:
    """For each column: values (not null), about how many different ones, and the least and greatest as text. One pass."""
    aggregates = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggregates += [F.count(col).alias(f"n{i}"), _about(col).alias(f"d{i}"), F.min(col).alias(f"l{i}"), F.max(col).alias(f"h{i}")]
    row = df.agg(F.count("*").alias("rows"), *aggregates).first()
    return [{"name": c, "rows": row["rows"], "n": row[f"n{i}"], "about": row[f"d{i}"], "low": row[f"l{i}"], "high": row[f"h{i}"]} for i, c in enumerate(columns)]


def value_text(column: Column, kind: T.DataType) -> Column:
    """A value as text that equal values of a family share."""
    return column.cast("string") if family(kind) in ("whole", "text", "date", "boolean") else column.cast("timestamp_ntz").cast("string") if family(kind) == "time" else column.cast("double").cast("string")


def inclusions(tables: dict[str, DataFrame], unique_only: bool = True) -> DataFrame:
    """(table, column, of_table, of_column, n, of_n): columns all whose values another column has, and the numbers of distinct values of both.

    unique_only: targets are columns without repeats, as a foreign key needs. A column without values is in no pair."""
    columns = [(t, f.name, f.dataType) for t, df in tables.items() for f in df.schema if family(f.dataType)]
    facts = {(t, x["name"]): x for t, df in tables.items() for x in column_facts(df, [c for u, c, _ in columns if u == t])}
    able = []
    for i, (t, c, kind) in enumerate(columns):
        a = facts[t, c]
        for j, (u, d, other) in enumerate(columns):
            b = facts[u, d]
            if i == j or family(kind) != family(other) or not a["n"] or not b["n"]:
                continue
            if a["low"] < b["low"] or a["high"] > b["high"] or a["about"] * (1 - SLACK) > b["about"] * (1 + SLACK) or (unique_only and b["about"] < b["n"] * (1 - SLACK)):
                continue
            able.append((i, j))
    spark = next(iter(tables.values())).sparkSession
    if not able:
        return spark.createDataFrame([], "table string, column string, of_table string, of_column string, n long, of_n long")
    used = sorted({x for pair in able for x in pair})
    parts = []
    for t, df in tables.items():
        own = [i for i in used if columns[i][0] == t]
        if own:
            entries = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(family(columns[i][2])).alias("family"), value_text(F.col(f"`{columns[i][1]}`"), columns[i][2]).alias("value")) for i in own))
            parts.append(df.select(F.inline(entries)).where("value IS NOT NULL"))
    every = reduce(DataFrame.unionByName, parts)
    # a value's columns, and those that have it more than once
    held = every.groupBy("family", "value", "c").agg((F.count("*") > 1).alias("again")).groupBy("family", "value").agg(F.array_sort(F.collect_set("c")).alias("set"), F.bool_or("again").alias("again"), F.collect_set(F.when(F.col("again"), F.col("c"))).alias("repeats"))
    sets = held.groupBy("set", "repeats").agg(F.count("*").alias("n"))  # as many rows as there are different sets of columns
    each = sets.select(F.explode("set").alias("c"), "set", "repeats", "n")
    common = F.aggregate("sets", F.element_at("sets", 1), lambda x, y: F.array_intersect(x, y))
    shared = each.groupBy("c").agg(F.collect_set("set").alias("sets"), F.sum("n").alias("n"), F.bool_or(F.array_contains("repeats", F.col("c"))).alias("again")).select("c", "n", "again", common.alias("targets"))
    pairs = spark.createDataFrame(able, "c int, of int")
    target = shared.select(F.col("c").alias("of"), F.col("n").alias("of_n"), "again")
    found = shared.select("c", "n", F.explode("targets").alias("of")).join(F.broadcast(pairs), ["c", "of"]).join(target, "of")
    found = found.where(~F.col("again")) if unique_only else found
    names = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(columns)], "i int, table string, column string")
    return found.join(F.broadcast(names.withColumnRenamed("i", "c")), "c").join(F.broadcast(names.selectExpr("i AS of", "table AS of_table", "column AS of_column")), "of").select("table", "column", "of_table", "of_column", "n", "of_n")


def _stem(name: Column) -> Column:
    """A column's name without the letters before its first underscore."""
    return F.regexp_replace(name, "^[^_]*_", "")


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, of_table, of_column): of each column's inclusions in columns of other tables the best one that its name bears out: equal names first, then names equal but for a prefix.

    Ties go to the target with the fewest values, then by name. Inclusions of small numbers in any key by chance have no such name."""
    from pyspark.sql import Window

    found = inclusions(tables).where("table <> of_table")
    alike = found.withColumn("fit", F.when(F.col("column") == F.col("of_column"), 2).when(_stem(F.col("column")) == _stem(F.col("of_column")), 1).otherwise(0)).where("fit > 0")
    order = Window.partitionBy("table", "column").orderBy(F.desc("fit"), "of_n", "of_table", "of_column")
    return alike.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("table", "column", "of_table", "of_column")


def _plain(name: str, kind: T.DataType) -> Column:
    """A column with one form for values that are equal: zero has no sign."""
    return F.col(f"`{name}`") + F.lit(0.0) if isinstance(kind, T.FloatType | T.DoubleType) else F.col(f"`{name}`")


def _whole_text(name: str, kind: T.DataType) -> Column:
    """A value as text that no other value of the column has, to the microsecond and beyond changes of clocks."""
    return F.unix_micros(f"`{name}`").cast("string") if isinstance(kind, T.TimestampType) else _plain(name, kind).cast("string")


class _Rows:
    """Some rows of a table on the driver, texts by their SHA-256: repeats among them are repeats of the table."""

    def __init__(self, df: DataFrame, kinds: dict[str, T.DataType]) -> None:
        shown = [F.sha2(F.col(f"`{c}`"), 256) if isinstance(k, T.StringType) else _whole_text(c, k) for c, k in kinds.items()]
        some = df.select(*(x.alias(f"c{i}") for i, x in enumerate(shown))).limit(max(1, min(SEEN, CELLS // max(1, len(kinds))))).toArrow()
        self.n, self.codes = some.num_rows, {}
        for i, c in enumerate(kinds):
            own = some.column(i).combine_chunks().dictionary_encode()
            self.codes[c] = own.indices.to_numpy().astype("int64"), len(own.dictionary)

    def apart(self, columns: tuple[str, ...]) -> bool:
        """No two of the rows are alike in the columns."""
        together, width = self.codes[columns[0]]
        for c in columns[1:]:
            codes, n = self.codes[c]
            if width * n >= 2**62:
                values, together = np.unique(together, return_inverse=True)
                width = len(values)
            together, width = together * n + codes, width * n
        return len(np.unique(together)) == self.n


def _entries(df: DataFrame, sets: list[tuple[str, ...]], of: Callable[[int, tuple[str, ...]], Column]) -> DataFrame:
    """A row (of what `of` makes) for each row and set; null structs give rows of nulls. The sets are dealt out to several scans, for the code of a long list is too large to be compiled."""
    parts = [df.select(F.inline(F.array(*(of(low + i, s) for i, s in enumerate(sets[low : low + IN_SCAN]))))) for low in range(0, len(sets), IN_SCAN)]
    return reduce(DataFrame.union, parts)


def _alike(entries: DataFrame) -> set[int]:
    """Of (s, value) the sets that have a value more than once."""
    return {r.s for r in entries.where("s IS NOT NULL").groupBy("s", "value").agg(F.count("*").alias("n")).where("n > 1").select("s").distinct().collect()}


def _seen_twice(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = np.sort(np.concatenate([np.empty(0, "int64"), *(b.column(0).to_numpy() for b in batches)]))
    yield pa.record_batch([pa.array(np.unique(own[1:][own[1:] == own[:-1]]))], names=["x"])


def _hash(s: tuple[str, ...], kinds: dict[str, T.DataType], i: int) -> Column:
    """The hash of a row's values of a set, the set's place in its last bits."""
    return F.xxhash64(*(_plain(c, kinds[c]) for c in s)).bitwiseAND(-AT_ONCE).bitwiseOR(F.lit(i).cast("long"))


def _repeated(df: DataFrame, sets: list[tuple[str, ...]], kinds: dict[str, T.DataType], rows: int, share: int, work: Workspace) -> set[int]:
    """Of at most AT_ONCE sets those that have two rows alike; all of them if share is 1, else those that show it among the rows that have one of `share` hashes or one of `share` lots.

    A value that most rows share shows among the lots, whatever its hash."""
    own = df if share == 1 else df.withColumn(LOT, F.rand(1) < 1 / share)
    kept = lambda i, s: F.lit(True) if share == 1 else F.shiftright(_hash(s, kinds, i), 8).bitwiseAND(share - 1).eqNullSafe(0) | F.col(LOT)
    value = lambda s: F.array(*(_whole_text(c, kinds[c]) for c in s)).alias("value")
    if share >= FEW:  # so few that their values may travel
        return _alike(_entries(own, sets, lambda i, s: F.when(kept(i, s), F.struct(F.lit(i).alias("s"), value(s)))))
    hashes = _entries(own, sets, lambda i, s: F.when(kept(i, s), F.struct(_hash(s, kinds, i).alias("x")))).where("x IS NOT NULL")
    again = work.put(hashes.repartition(ceil(2 * rows * len(sets) / share / IN_TASK), "x").mapInArrow(_seen_twice, "x long"))
    one = {r.s: r.x for r in again.groupBy(F.col("x").bitwiseAND(AT_ONCE - 1).alias("s")).agg(F.min("x").alias("x")).collect()}  # a row for each set at most
    alike: set[int] = set()
    for known in (True, False):  # the rows of one hash of each set; where they have different values, those of all hashes that came twice
        open_ = [i for i in one if i not in alike]
        if not open_ or (not known and share > 1):
            break
        at = lambda i, s: F.struct(F.lit(open_[i]).alias("s"), _hash(s, kinds, open_[i]).alias("x"), value(s))  # noqa: B023, E731
        found = _entries(df, [sets[i] for i in open_], (lambda i, s: F.when(_hash(s, kinds, open_[i]) == one[open_[i]], at(i, s))) if known else at)  # noqa: B023
        alike |= _alike(found if known else found.join(again, "x", "left_semi"))
    return alike


def _unique(df: DataFrame, sets: list[tuple[str, ...]], kinds: dict[str, T.DataType], rows: int, work: Workspace) -> list[tuple[str, ...]]:
    """The sets without repeats over all rows."""
    left, last = sets, None
    for most in (*FIRST, None):  # what some hashes show makes the last pass smaller, which looks at all of them
        share = 1 if most is None else 1 << ceil(log2(max(1, rows * len(left) / most)))
        if most is not None and (share < 4 or (last and share > last // 4)):
            continue
        at_once, kept = max(1, min(AT_ONCE, HASHES * share // rows)), []
        for low in range(0, len(left), at_once):
            part = left[low : low + at_once]
            alike = _repeated(df, part, kinds, rows, share, work)
            kept += [s for i, s in enumerate(part) if i not in alike]
        left, last = kept, share
    return left


def least_keys(df: DataFrame, columns: list[str] | None = None, most: int = 3) -> list[tuple[str, ...]]:
    """The least sets of at most `most` columns that have no nulls and no two rows alike, smaller sets first."""
    names = [f.name for f in df.schema if family(f.dataType)] if columns is None else columns
    if not names:
        return []
    counts = df.agg(F.count("*"), *(F.count(F.col(f"`{c}`")) for c in names)).first()
    rows, kinds = counts[0], {c: df.schema[c].dataType for c, n in zip(names, counts[1:], strict=True) if n == counts[0]}
    found: list[tuple[str, ...]] = []
    if not rows or not kinds:
        return found
    some = _Rows(df, kinds)
    with Workspace(df.sparkSession) as work:
        for size in range(1, most + 1):
            sets = [s for s in combinations(kinds, size) if not any(set(k) <= set(s) for k in found) and some.apart(s)]
            found += _unique(df, sets, kinds, rows, work) if rows > some.n and sets else sets
    return found


def keys_of(tables: dict[str, DataFrame], most: int = 3) -> DataFrame:
    """(table, columns): the least keys of each table."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, list(k)) for t, df in tables.items() for k in least_keys(df, most=most)], "table string, columns array<string>")
