"""Profiling: column statistics, candidate keys, inclusion dependencies.

Files carry no declared keys, so these jobs find them in the data. What comes back to the driver is one
short row per column, key or dependency, never data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tristrata.functions.columns import DATE_TYPES
from tristrata.session import new_work_path

# Sketches of 2^12 registers: their standard error is 1.04 / sqrt(2^12).
SKETCH_LOG_REGISTERS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LOG_REGISTERS / 2)

# Candidates are tried on about so many rows before they are tried on all; candidates of one pass; and
# sets of columns learned from each.
SAMPLE_VALUES = 50_000
CANDIDATES = 48
PAIRS_EACH = 20
# Columns that several candidates have in common stand for them if about so many of the rows, at most, repeat a value there.
REPEATED_SHARE = 0.01
# Values of one partition in a pass over all of them.
PARTITION_VALUES = 4_000_000

# Tuples of columns tried in one pass of the search for composite references.
TUPLES = 32
# Columns per 64-bit mask; the sign bit stays free.
MASK_BITS = 62


def value_hash(*columns: Column) -> Column:
    """128 bits that stand for values: equal for equal ones, for others equal about never (n * n / 2**129 pairs of n)."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _sketched_distinct(*columns: str | Column) -> Column:
    """Approximate number of distinct combinations; a combination whose first column is NULL is left out."""
    first = F.col(columns[0]) if isinstance(columns[0], str) else columns[0]
    value = F.when(first.isNotNull(), F.xxhash64(*columns))
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, SKETCH_LOG_REGISTERS))


def profile_columns(table: str, df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: type, nullable, rows, NULLs, distinct values, least and greatest value as text.

    One pass with sketched distinct counts. ``exact`` takes one more pass over 128-bit hashes of all values, which are
    what is shuffled. Least and greatest stay NULL for arrays, maps and structs, distinct counts
    for maps.
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        column, simple = F.col(f"`{f.name}`"), not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        countable = not exact and not isinstance(f.dataType, T.MapType)
        nothing = F.max(F.lit(None).cast("string"))
        aggregates += [
            F.count_if(column.isNull()).alias(f"nulls{i}"),
            (_sketched_distinct(column) if countable else F.max(F.lit(None).cast("bigint"))).alias(f"distinct{i}"),
            (F.min(column).cast("string") if simple else nothing).alias(f"min{i}"),
            (F.max(column).cast("string") if simple else nothing).alias(f"max{i}"),
        ]
    rows = F.array(*(
        F.struct(
            F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("position"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
            F.col("rows").alias("row_count"), F.col(f"nulls{i}").alias("null_count"),
            F.col(f"distinct{i}").alias("distinct_count"), F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"),
        ) for i, f in enumerate(df.schema)
    ))
    profile = df.agg(*aggregates).select(F.explode(rows).alias("row")).select("row.*")
    if not exact:
        return profile
    cells = df.select(F.explode(F.array(*(
        F.struct(F.lit(i + 1).alias("position"), F.when(F.col(f"`{f.name}`").isNotNull(), value_hash(F.col(f"`{f.name}`"))).alias("value"))
        for i, f in enumerate(df.schema) if not isinstance(f.dataType, T.MapType)
    ))).alias("cell")).select("cell.*")
    counted = cells.distinct().groupBy("position").agg(F.count("value").alias("__distinct"))
    exactly = profile.join(counted, "position", "left").withColumn("distinct_count", F.col("__distinct"))
    return exactly.select(profile.columns)


def profile_tables(tables: Mapping[str, DataFrame], exact: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, (profile_columns(n, df, exact) for n, df in tables.items()))


def discover_keys(df: DataFrame, max_columns: int | None = None, smallest_only: bool = False) -> list[tuple[str, ...]]:
    """All minimal candidate keys, of any number of columns: no NULL, no value twice. ``smallest_only`` gives those of
    the least number of columns.

    Integer, decimal, text and date columns qualify. Two rows that agree in a set of columns rule out every key inside it,
    so a key has a column outside each such set. Sets come from pairs of rows that share a value in a sample, first of
    single columns and of all columns but one, and are made larger a column at a time; the smallest choices of columns
    that leave all of them (minimal hitting sets) are tried, some dozen at once. The sample is written once and refutes
    most. What it cannot refute is settled by passes over all values: a value that repeats in some columns repeats in each
    part of them, so of a part that the candidates have in common the few rows with repeated values are kept, and the
    candidates, also later ones that hold the part, are tried on these. Each refutation yields a pair of rows and so
    another set. What no row repeats is a key. 128-bit hashes are shuffled, not values.
    """
    kinds = (T.IntegralType, T.DecimalType, T.StringType, *DATE_TYPES)
    names = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    if not names:
        return []
    df = df.select(*names)
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c) for c in names), *(_sketched_distinct(c) for c in names)).first()
    rows, distinct = stats[0], {c: d for c, n, d in zip(names, stats[1:len(names) + 1], stats[len(names) + 1:]) if n == stats[0]}
    names = list(distinct)
    if rows == 0 or not names:
        return []
    columns = [f"c{i}" for i in range(len(names))]
    df = df.select(*(F.col(n).alias(c) for n, c in zip(names, columns)))
    sample = _Sample.of(df, columns, list(distinct.values()), rows)
    whole = (1 << len(names)) - 1
    singles = [1 << i for i in range(len(names))]
    first = singles + [whole & ~i for i in singles if len(names) > 2]
    agreeing = _maximal({0} | sample.agreeing(first)[1])
    keys: set[int] = set()
    repeating: list[_Repeating] = []
    for size in range(1, min(len(names), max_columns or len(names)) + 1):
        while candidates := list(islice((c for c in _hitting_sets(agreeing, len(names), size) if c not in keys), CANDIDATES)):
            refuted, found = sample.agreeing(candidates)
            unrefuted = [c for c in candidates if c not in refuted]
            if not sample.whole and unrefuted:
                if any(not any(r.settles(c) for r in repeating) for c in unrefuted):
                    repeating.append(_repeating(df, sample, [c for c in unrefuted if not any(r.settles(c) for r in repeating)], columns))
                for rest in repeating:
                    refuted, more = rest.agreeing([c for c in unrefuted if rest.settles(c)])
                    unrefuted, found = [c for c in unrefuted if c not in refuted], found | more
            keys.update(unrefuted)
            agreeing = _maximal(agreeing | found | _grown(sample, found, len(names)))
        if smallest_only and keys:
            break
    return sorted((tuple(c for i, c in enumerate(names) if k >> i & 1) for k in keys), key=lambda k: (len(k), [names.index(c) for c in k]))


def _maximal(sets: set[int]) -> set[int]:
    """The sets, as bits, that are inside no other."""
    kept: list[int] = []
    for s in sorted(sets, key=int.bit_count, reverse=True):
        if not any(s & k == s for k in kept):
            kept.append(s)
    return set(kept)


def _hitting_sets(agreeing: set[int], n: int, size: int) -> Iterator[int]:
    """The minimal sets of at most ``size`` of ``n`` columns with a column outside each of the ``agreeing`` sets, one by one."""
    outside = sorted(((1 << n) - 1 & ~s for s in agreeing), key=int.bit_count)

    def search(chosen: list[int], allowed: int, left: list[int]) -> Iterator[int]:
        if not left:
            yield sum(chosen)
            return
        if len(chosen) == size:
            return
        branch = min((s & allowed for s in left), key=int.bit_count)
        for i in range(n):
            if branch >> i & 1:
                allowed &= ~(1 << i)
                picked = [*chosen, 1 << i]
                # Every column must be the only one that some set has.
                if all(any(s & sum(picked) == c for s in outside) for c in picked):
                    yield from search(picked, allowed, [s for s in left if not s >> i & 1])

    yield from search([], (1 << n) - 1, outside)


def _grown(sample: _Sample, sets: set[int], n: int) -> set[int]:
    """Larger sets of columns in which two rows agree, from the largest of ``sets`` with one more of ``n`` columns."""
    largest = sorted(_maximal(sets), key=int.bit_count)[-2:]
    tried = [s | 1 << i for s in largest for i in range(n) if not s >> i & 1][:2 * CANDIDATES]
    return sample.agreeing(tried)[1] if tried else set()


def _cells(df: DataFrame, candidates: Sequence[int], names: Sequence[str], more: Sequence[Column] = (),
           among: Mapping[int, Column] | None = None, hashed: Callable[..., Column] = value_hash) -> DataFrame:
    """``(i, value)`` per row and candidate, with ``more`` of the row; with ``among`` only the rows that it tells of each."""
    cells = []
    for i, c in enumerate(candidates):
        cell = F.struct(F.lit(i).alias("i"), hashed(*(F.col(n) for j, n in enumerate(names) if c >> j & 1)).alias("value"))
        cells.append(F.when(among[c], cell) if among else cell)
    array = F.array_compact(F.array(*cells)) if among else F.array(*cells)
    return df.select(F.explode(array).alias("cell"), *more).select("cell.*", "*").drop("cell")


def _pairs(cells: DataFrame, candidates: Sequence[int]) -> tuple[set[int], set[int]]:
    """Candidates of which a value occurs twice, and in which columns two of its rows agree: the largest sets."""
    repeated = cells.groupBy("i", "value").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")).filter("n > 1")
    same = F.array_join(F.zip_with("a", "b", lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    sets = repeated.select("i", same.alias("same")).distinct().withColumn("size", F.length(F.replace("same", F.lit("0"), F.lit(""))))
    best = Window.partitionBy("i").orderBy(F.desc("size"), "same")
    found = sets.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= PAIRS_EACH).collect()
    return {candidates[r["i"]] for r in found}, {int(r["same"][::-1], 2) for r in found}


def _signature(names: Sequence[str]) -> list[Column]:
    return [F.array(*map(F.xxhash64, names)).alias("row")]


@dataclass(frozen=True)
class _Sample:
    """Rows among which candidates are tried first.

    For each column of many values there are all rows of a share of its values, so that rows which agree in columns with
    it are taken together; a share of the different rows is for candidates without such a column.
    """

    rows: DataFrame
    columns: Sequence[str]
    distinct: Mapping[int, int]
    whole: bool
    total: int

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str], distinct: Sequence[int], rows: int) -> _Sample:
        if rows <= SAMPLE_VALUES:
            return _Sample(df, columns, {}, True, rows)
        share = SAMPLE_VALUES / rows
        many = {i: d for i, d in enumerate(distinct) if d * share >= 100}
        taken = {i: F.pmod(F.xxhash64(columns[i]), F.lit(1 << 30)) < int(share * (1 << 30)) + 1 for i in many}
        taken[len(columns)] = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
        marked = df.withColumns({f"in{i}": t for i, t in taken.items()}).filter(" or ".join(f"in{i}" for i in taken))
        return _Sample(_written(marked, "sample"), columns, many, False, rows)

    def among(self, candidates: Sequence[int]) -> dict[int, Column] | None:
        if self.whole:
            return None
        best = {c: max((i for i in self.distinct if c >> i & 1), key=self.distinct.get, default=len(self.columns)) for c in candidates}
        return {c: F.col(f"in{i}") for c, i in best.items()}

    def agreeing(self, candidates: Sequence[int]) -> tuple[set[int], set[int]]:
        """``_pairs`` of the rows that are there for each candidate."""
        return _pairs(_cells(self.rows, candidates, self.columns, _signature(self.columns), self.among(candidates)), candidates)

    def repeated_share(self, parts: Sequence[int]) -> dict[int, float]:
        """About which share of all rows has a value that repeats, of each set of columns."""
        counts = _cells(self.rows, parts, self.columns, (), self.among(parts)).groupBy("i", "value").agg(F.count("*").alias("n"))
        shares = counts.groupBy("i").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).collect()
        return {parts[r["i"]]: r["share"] for r in shares}


@dataclass(frozen=True)
class _Repeating:
    """All ``rows`` with a value that occurs twice in some ``parts``, sets of columns; ``part`` is the place of one."""

    rows: DataFrame
    parts: Sequence[int]
    columns: Sequence[str]

    def _part(self, candidate: int) -> int | None:
        return next((i for i, p in enumerate(self.parts) if p & candidate == p), None)

    def settles(self, candidate: int) -> bool:
        return self._part(candidate) is not None

    def agreeing(self, candidates: Sequence[int]) -> tuple[set[int], set[int]]:
        """``_pairs`` of candidates that hold one of the parts: what it tells of these rows holds for all."""
        if not candidates:
            return set(), set()
        among = {c: F.col("part") == self._part(c) for c in candidates}
        return _pairs(_cells(self.rows, candidates, self.columns, _signature(self.columns), among), candidates)


def _repeating(df: DataFrame, sample: _Sample, candidates: Sequence[int], columns: Sequence[str]) -> _Repeating:
    """The rows with repeated values of few parts, of which each candidate holds one, from passes over all values.

    Parts are what candidates have in common, if few rows repeat a value of it, else the candidates themselves.
    """
    # Only rows taken by a column of the part tell how many of its values repeat.
    common = {p for p in {c & d for c in candidates for d in candidates} - set(candidates) if any(p >> i & 1 for i in sample.distinct)}
    common = sorted(common, key=lambda p: -sum(p & c == p for c in candidates))[:2 * CANDIDATES]
    shares = sample.repeated_share(common) if common else {}
    parts, left = [], list(candidates)
    for part in sorted((p for p in common if shares.get(p, 1.0) <= REPEATED_SHARE), key=lambda p: (-sum(p & c == p for c in candidates), -p.bit_count())):
        if sum(part & c == part for c in left) > 1:
            parts.append(part)
            left = [c for c in left if part & c != part]
    parts += left
    # 64 bits will do here, as their clashes only add rows. Nearly every value stands alone, so none are combined before
    # they are dealt, and partitions are as many as their number asks for.
    cells = _cells(df, parts, columns, (), None, F.xxhash64)
    dealt = max(sample.total * len(parts) // PARTITION_VALUES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = cells.repartition(dealt, "i", "value").groupBy("i", "value").agg(F.count("*").alias("n"))
    values = _written(counted.filter("n > 1").select("i", "value"), "repeated-values")
    again = _cells(df, parts, columns, [F.col(c) for c in columns], None, F.xxhash64).join(values, ["i", "value"], "left_semi")
    rows = _written(again.select(F.col("i").alias("part"), *columns), "repeating")
    return _Repeating(rows, parts, columns)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discover_all_keys(
    tables: Mapping[str, DataFrame], max_columns: int | None = None, parallel: int = 8, smallest_only: bool = False
) -> dict[str, list[tuple[str, ...]]]:
    """``discover_keys`` of many tables; the jobs of ``parallel`` tables run side by side."""
    with ThreadPoolExecutor(parallel) as pool:
        found = pool.map(lambda df: discover_keys(df, max_columns, smallest_only), tables.values())
        return dict(zip(tables, found))


@dataclass(frozen=True)
class _Cells:
    """One column whose values take part in the search for inclusions."""

    table: str
    column: str
    kind: str
    low: object
    high: object
    longest: int
    is_key: bool


def discover_fks(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[tuple[str, ...]]]) -> DataFrame:
    """Inclusion dependencies of whole-number, text and date columns in single-column keys of the same kind.

    Every value, as 128 bits of hash, is tagged with a bit per column that holds it; OR-ing the bits per value and AND-ing the
    results per column leaves the columns that hold all its values. Both steps are plain aggregates, combined
    before the shuffle, so neither frequent values nor many columns make a hot group. Columns whose range
    cannot fit any key are never read.

    Containment alone is weak evidence: a small range of integers fits every dense key. ``evidence`` says
    whether the names agree too, ``rank`` orders a column's possible parents by names, then by the share of
    the parent's values used. Composite keys are ``discover_composite_fks``'s.
    """
    cells = _candidate_cells(tables, keys)
    found = []
    for kind in dict.fromkeys(c.kind for c in cells):
        found += _inclusions(tables, [c for c in cells if c.kind == kind], kind)
    ranked = []
    for child in dict.fromkeys(r[:2] for r in found):
        parents = sorted((r for r in found if r[:2] == child), key=lambda r: (r[7] != "name", -r[6], r[2], r[3]))
        ranked += [(*r, rank) for rank, r in enumerate(parents, start=1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        ranked, "child_table string, child_column string, parent_table string, parent_column string, "
                "child_distinct bigint, parent_distinct bigint, coverage double, evidence string, rank int")


def _candidate_cells(tables, keys) -> list[_Cells]:
    """Key columns, and the columns whose range (of texts also the length) lies inside a key column of the same kind."""
    cells = []
    for name, df in tables.items():
        kinds = {f.name: kind for f in df.schema if (kind := _kind(f.dataType)) is not None}
        if not kinds:
            continue
        single = {k[0] for k in keys.get(name, ()) if len(k) == 1}
        ends = df.agg(
            *(f(F.col(c).cast(kind)).alias(f"{p}_{c}") for c, kind in kinds.items() for p, f in (("low", F.min), ("high", F.max))),
            *(F.max(F.length(c)).alias(f"long_{c}") for c, kind in kinds.items() if kind == "string")).first().asDict()
        cells += [_Cells(name, c, kind, ends[f"low_{c}"], ends[f"high_{c}"], ends.get(f"long_{c}", 0), c in single)
                  for c, kind in kinds.items() if ends[f"low_{c}"] is not None]
    parents = [c for c in cells if c.is_key]
    children = [c for c in cells if any(_fits(c, p) for p in parents)]
    used = [p for p in parents if any(_fits(c, p) for c in children)]
    return list(dict.fromkeys(children + used))


def _fits(child: _Cells, parent: _Cells) -> bool:
    return (child != parent and child.kind == parent.kind
            and parent.low <= child.low and child.high <= parent.high and child.longest <= parent.longest)


def _kind(data_type: T.DataType) -> str | None:
    """The type in which columns of a kind are compared; None for columns that cannot refer to a key."""
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.IntegralType) or isinstance(data_type, T.DecimalType) and data_type.scale == 0:
        return "decimal(38,0)"
    return "timestamp_ntz" if isinstance(data_type, DATE_TYPES) else None


def _inclusions(tables: Mapping[str, DataFrame], cells: Sequence[_Cells], kind: str) -> list[tuple]:
    if not cells:
        return []
    place = {c: divmod(i, MASK_BITS) for i, c in enumerate(cells)}
    words = range(len(cells) // MASK_BITS + 1)
    tagged = []
    for name in dict.fromkeys(c.table for c in cells):
        tags = [F.struct(F.when(F.col(c.column).isNotNull(), value_hash(F.col(c.column).cast(kind))).alias("value"), F.lit(place[c][0]).alias("word"),
                         F.lit(1 << place[c][1]).cast("bigint").alias("bit")) for c in cells if c.table == name]
        tagged.append(tables[name].select(F.inline(F.array(*tags))))
    holders = (reduce(DataFrame.unionAll, tagged).filter(F.col("value").isNotNull()).groupBy("value")
               .agg(*(F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"mask{w}")
                      for w in words)))

    def holds(cell: _Cells) -> Column:
        word, bit = place[cell]
        return F.col(f"mask{word}").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0

    children = [c for c in cells if any(_fits(c, p) for p in cells if p.is_key)]
    common = holders.agg(
        *(F.count_if(holds(c)).alias(f"n_{place[c]}") for c in cells),
        *(F.bit_and(F.when(holds(c), F.col(f"mask{w}"))).alias(f"in_{place[c]}_{w}") for c in children for w in words),
    ).first().asDict()
    found = []
    for child in children:
        for parent in cells:
            word, bit = place[parent]
            shared = common[f"in_{place[child]}_{word}"]
            if parent.is_key and parent != child and shared is not None and shared >> bit & 1:
                n, of = common[f"n_{place[child]}"], common[f"n_{place[parent]}"]
                evidence = "name" if same_meaning(child.column, parent.table, parent.column) else "containment only"
                found.append((child.table, child.column, parent.table, parent.column, n, of, n / of, evidence))
    return found


def discover_composite_fks(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[tuple[str, ...]]]) -> DataFrame:
    """Tuples of columns whose values are all values of a key of as many columns, found from the data.

    The search goes level by level: column inclusions in the first column of a key come first, and only tuples that hold
    in the first columns of a key are tried with one more. A level is one pass for every ``TUPLES`` tuples, over hashes
    as in ``discover_fks``. Rows with a NULL in one of the columns refer to nothing. A column stands once in a tuple.

    ``child_columns`` and ``parent_columns`` are in the order of the key. ``evidence`` is ``name`` if all names agree.
    Keys of one column are left to ``discover_fks``.
    """
    spark = next(iter(tables.values())).sparkSession
    wide = [(table, tuple(key)) for table, of in keys.items() for key in of if len(key) > 1]
    members = {table: list(dict.fromkeys((c,) for t, key in wide if t == table for c in key)) for table, _ in wide}
    cells = _candidate_cells(tables, members)
    kinds = {(name, f.name): _kind(f.dataType) for name, df in tables.items() for f in df.schema}
    within: dict[tuple[str, str], set[tuple[str, str]]] = {(t, c): {(t, c)} for t, key in wide for c in key}
    for kind in dict.fromkeys(c.kind for c in cells):
        for child_table, child, parent_table, parent, *_ in _inclusions(tables, [c for c in cells if c.kind == kind], kind):
            within[parent_table, parent].add((child_table, child))
    # Tuples of columns of one table, by the key in whose first columns they lie.
    holding = {(table, key): {(t, (c,)) for t, c in within[table, key[0]]} for table, key in wide}
    found: list[tuple] = []
    for size in range(2, max((len(key) for _, key in wide), default=1) + 1):
        holding = {(table, key): {(t, (*child, c)) for t, child in of for u, c in within[table, key[size - 1]] if u == t and c not in child}
                   for (table, key), of in holding.items() if len(key) >= size}
        counts = _tuple_inclusions(tables, kinds, holding, size)
        holding = {of: {c for c in children if (c, (of[0], of[1][:size])) in counts} for of, children in holding.items()}
        for (table, key), children in holding.items():
            if len(key) == size:
                found += [(t, list(child), table, list(key), *counts[(t, child), (table, key)],
                           "name" if all(same_meaning(c, table, k) for c, k in zip(child, key)) else "containment only")
                          for t, child in children if (t, child) != (table, key)]
    ranked = []
    for child in sorted({(r[0], tuple(r[1])) for r in found}):
        parents = sorted((r for r in found if (r[0], tuple(r[1])) == child), key=lambda r: (r[7] != "name", -r[6], r[2], r[3]))
        ranked += [(*r, rank) for rank, r in enumerate(parents, start=1)]
    return spark.createDataFrame(
        ranked, "child_table string, child_columns array<string>, parent_table string, parent_columns array<string>, "
                "child_distinct bigint, parent_distinct bigint, coverage double, evidence string, rank int")


def _tuple_inclusions(tables, kinds, holding, size: int) -> dict[tuple, tuple[int, int, float]]:
    """``(child, parent) -> (distinct values of the child, of the parent, their ratio)`` for the inclusions among tuples."""
    wanted: dict[tuple, set[tuple]] = {}
    for (table, key), children in holding.items():
        wanted.setdefault((table, key[:size]), set()).update(children)
    out: dict[tuple, tuple[int, int, float]] = {}
    for parent, children in sorted(wanted.items()):
        ordered = sorted(children)
        out |= {(c, c): (0, 0, 1.0) for c in ordered if c == parent}
        ordered = [c for c in ordered if c != parent]
        for i in range(0, len(ordered), TUPLES):
            used = [parent, *ordered[i:i + TUPLES]]
            hashed = {
                name: tables[name].select(*(_tuple_text(columns, [kinds[name, c] for c in columns]).alias(f"t{n}") for n, (t, columns) in enumerate(used) if t == name))
                for name in dict.fromkeys(t for t, _ in used)}
            cells = [_Cells(t, f"t{n}", "string", "", "", 0, n == 0) for n, (t, _) in enumerate(used)]
            for _, column, _, _, n, of, share, _ in _inclusions(hashed, cells, "string"):
                out[used[int(column[1:])], parent] = n, of, share
    return out


def _tuple_text(columns: Sequence[str], kinds: Sequence[str]) -> Column:
    """128 bits of hash of a tuple as text, NULL if one of the columns is."""
    values = [F.col(c).cast(k) for c, k in zip(columns, kinds)]
    hashed = value_hash(*values)
    return F.when(reduce(lambda a, b: a & b, (v.isNotNull() for v in values)), F.concat_ws(":", hashed["a"].cast("string"), hashed["b"].cast("string")))


def stem(column: str) -> str:
    """A column name without its one- or two-letter table prefix."""
    prefix, _, rest = column.lower().partition("_")
    return rest if rest and len(prefix) <= 2 else column.lower()


def same_meaning(child_column: str, parent_table: str, parent_column: str) -> bool:
    """Whether a column's name points at a key: equal stems, or ``<table>_id`` for a key named ``id``."""
    if parent_column.lower() == "id":
        table = parent_table.lower()
        return child_column.lower() in (f"{table}_id", f"{table.removesuffix('s')}_id")
    return stem(child_column) == stem(parent_column)
