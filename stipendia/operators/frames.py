"""Building blocks that keep hot keys off a single task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DateType, IntegralType, NumericType, TimestampNTZType, TimestampType

# Rules that travel together in one row.
RULE_CHUNK = 1_000
# Copies of the small side when a join has to be spread by hand.
FRAGMENTS = 32


def balanced(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer partitions than cores.

    For per-row work that costs far more than moving the row.  Large inputs
    have more partitions than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a unique key, so that the work on a row is shared whatever files and row groups hold the table.

    A narrow table of millions of rows can be one row group, which one task reads alone, even when the scan plans
    more tasks.  The number of parts grows with the scan and is never below twice the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, 4 * df.rdd.getNumPartitions()), key)


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with named columns that are computed once per row.

    Spark copies an expression into every later filter and column that reads it; the row generated here is read instead.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None,
              latest: bool = True) -> DataFrame:
    """One row per key, the greatest (or smallest) by ``order``.

    ``max_by`` combines on the map side, so a key holding most of the rows
    reaches the shuffle as one row per input task; a window would not.
    """
    rest = columns or [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_key_count(df: DataFrame, keys: list[str], name: str = "key_count") -> DataFrame:
    """Rows per key next to every row, counted before the join rather than in a window."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    null_safe = [df[k].eqNullSafe(counts[k]) for k in keys]
    return df.join(counts, reduce(lambda a, b: a & b, null_safe), "left").select(df["*"], counts[name])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per key; Spark trims each task to ``n`` rows before the shuffle."""
    return (df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .where(F.col(rank) <= n))


def share_of_total(df: DataFrame, count: str, name: str = "share") -> DataFrame:
    """Percentage of each row's count in the total, the total being one scalar subquery."""
    from stipendia.functions.scalars import percent
    total = df.agg(F.sum(count).alias("total")).scalar()
    return df.withColumn(name, percent(F.col(count), total, 0))


def with_each_rule(df: DataFrame, rules: DataFrame, name: str = "rule") -> DataFrame:
    """Every row next to every row of a rule table, in one plan for tables of any size.

    Rules are dealt into chunks of about ``RULE_CHUNK``, each one row with an array, opened behind the join.  The join
    has no key, so no task gathers the rows of one: Spark copies a small table to the rows where they are, and meets
    pieces of both sides for a large one.
    """
    packed = rules.select(F.struct("*").alias(name))
    chunks = rules.agg(F.ceil(F.count(F.lit(1)) / RULE_CHUNK).cast("int").alias("n")).scalar()
    dealt = packed.withColumn("_chunk", F.pmod(F.xxhash64(F.to_json(name)), chunks).cast("int")).groupBy("_chunk").agg(
        F.collect_list(name).alias("_rules"))
    return df.crossJoin(dealt.select("_rules")).withColumn(name, F.explode("_rules")).drop("_rules")


def fixed_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values whose small size Spark knows while it plans, unlike that of local rows sent from Python.

    Joins with it copy the table; otherwise they would deal millions of rows by a handful of keys.
    """
    fields = [part.split() for part in schema.split(",")]
    cells = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*cells)))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str],
                salts: int = FRAGMENTS, how: str = "inner") -> DataFrame:
    """Equi-join whose left rows of one key are spread over ``salts`` tasks.

    ``right`` is repeated once per salt and must be the smaller side.
    """
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*keys, "_salt"], how).drop("_salt")


def count_if(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


# The published limit of one page.
PAGE_ROWS = 100
# Stretches of the key that a page is looked up in.
STRETCHES = 10_000


def _checked(size: int, most: int) -> None:
    if not 1 <= size <= most:
        raise ValueError(f"a page has 1 to {most} rows, not {size}")


def page(df: DataFrame, order: list[Column], number: int | Column, size: int, key: Column | None = None,
         most: int = PAGE_ROWS) -> DataFrame:
    """One page with the total and page count.  A size outside 1..``most`` is an error, never a shorter page.

    With ``key``, a number that rises along ``order``, a page costs the same wherever it lies: rows are counted per
    stretch of the key (``STRETCHES`` of equal width, one row each), running totals name the stretches that the page
    falls into, and only their rows are sorted.  The total comes from the same counts.  Rows without a key come first.
    The number may then be a column, as of a scalar subquery.
    Without ``key`` the rows in front of the page are sorted with it, which suits the first pages.
    """
    _checked(size, most)
    offset = (F.greatest(F.lit(1), number) - 1) * size if isinstance(number, Column) else (max(1, number) - 1) * size
    if key is None:
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        rows = df.orderBy(*order).offset(offset).limit(size)
    else:
        value = key.cast("double")
        least, greatest = (df.agg(f(value).alias("x")).scalar() for f in (F.min, F.max))
        stretch = F.coalesce(F.width_bucket(value, least, greatest + 1, F.lit(STRETCHES)), F.lit(0))
        counts = df.select(stretch.alias("_stretch")).groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))
        total = F.coalesce(counts.agg(F.sum("_n").alias("n")).scalar(), F.lit(0))
        upto = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        met = placed.where((F.col("_before") < offset + size) & (F.col("_before") + F.col("_n") > offset)).drop("_n")
        place = F.row_number().over(W.partitionBy("_stretch").orderBy(*order)) + F.col("_before")
        rows = df.withColumn("_stretch", stretch).join(met, "_stretch").withColumn("_place", place).where(
            (F.col("_place") > offset) & (F.col("_place") <= offset + size)).select(*df.columns).orderBy(*order)
    return rows.withColumn("total", total).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(float(size))).cast("long"))


def page_after(df: DataFrame, key: str, last_key, size: int, most: int = PAGE_ROWS) -> DataFrame:
    """Keyset page: the filter reaches the scan, no rows are skipped one by one."""
    _checked(size, most)
    rows = df if last_key is None else df.where(F.col(key) > F.lit(last_key))
    return rows.orderBy(key).limit(size)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keep the newest version of every key; changes win ties."""
    both = (current.withColumn("_fresh", F.lit(0))
            .unionByName(changes.withColumn("_fresh", F.lit(1)), allowMissingColumns=True))
    return latest_by(both, keys, [version, "_fresh"]).drop("_fresh")


# --- sequences inside a key ----------------------------------------------------------------------

def stretch_of(df: DataFrame, first: Column) -> Column:
    """Days of a date or time, stretches of 1024 of a number: a cut that follows from the value alone.

    Values of other types are a stretch each.
    """
    kind = df.select(first.alias("x")).schema["x"].dataType
    if isinstance(kind, IntegralType):
        return F.shiftright(first.cast("long"), 10)
    if isinstance(kind, NumericType):
        return F.floor(first / 1024)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.to_date(first)
    return first


def _by_stretch(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``_group``, their key and the stretch of their first order column; null keys are keys too."""
    return df.withColumn("_group", F.struct(F.struct(*keys).alias("key"), stretch_of(df, order[0]).alias("stretch")))


def _along_key():
    return W.partitionBy("_group.key").orderBy("_group.stretch")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """``row_number`` per key by a scan in two levels, so that a key with all rows spans many tasks.

    Rows are numbered inside a stretch of their key (``stretch_of`` the first order column), and shifted by the rows of
    earlier stretches, of which there is one row each.  One plan for every input, without a job while it is built.
    ``order`` holds ascending columns and ends in a unique one.
    """
    rows = _by_stretch(df, keys, order)
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("_group", F.coalesce(F.sum("_n").over(_along_key().rowsBetween(W.unboundedPreceding, -1)),
                                               F.lit(0)).alias("_shift"))
    local = rows.withColumn("_local", F.row_number().over(W.partitionBy("_group").orderBy(*order)))
    return local.join(shifts, "_group").select(*df.columns, (F.col("_local") + F.col("_shift")).cast("int").alias(name))


def with_neighbours(df: DataFrame, keys: list[str], order: list[Column], previous: dict[str, str],
                    following: dict[str, str]) -> DataFrame:
    """Values of the previous and the following row of the same key, by the same scan in two levels.

    ``previous`` and ``following`` map a source column to its new name.  Inside a stretch the neighbours are next to a
    row; the first and the last row of a stretch take them from the border rows of the stretches around it.
    """
    rows = _by_stretch(df, keys, order)
    inside = W.partitionBy("_group").orderBy(*order)
    place = F.struct(*order)
    ends = (lambda pick, columns: pick(F.struct(F.lit(1).alias("_one"), *columns), place))
    borders = rows.groupBy("_group").agg(ends(F.max_by, previous).alias("_last"), ends(F.min_by, following).alias("_first"))
    borders = borders.select("_group", F.lag("_last").over(_along_key()).alias("_last"), F.lead("_first").over(_along_key()).alias("_first"))
    local = rows.select("*", F.lag(F.lit(1)).over(inside).alias("_has_lag"), F.lead(F.lit(1)).over(inside).alias("_has_lead"),
                        *[F.lag(c).over(inside).alias(f"_lag_{i}") for i, c in enumerate(previous)],
                        *[F.lead(c).over(inside).alias(f"_lead_{i}") for i, c in enumerate(following)])
    taken = [F.when(F.col("_has_lag").isNotNull(), F.col(f"_lag_{i}")).otherwise(F.col(f"_last.{c}")).alias(n)
             for i, (c, n) in enumerate(previous.items())]
    taken += [F.when(F.col("_has_lead").isNotNull(), F.col(f"_lead_{i}")).otherwise(F.col(f"_first.{c}")).alias(n)
              for i, (c, n) in enumerate(following.items())]
    return local.join(borders, "_group").select(*df.columns, *taken)


def exact_median(df: DataFrame, group: list[str], value: str, width: int, name: str = "median") -> DataFrame:
    """Exact median of a whole-number column without gathering a group in one place.

    A first histogram of ``width``-wide bins finds the bins that hold the middle
    ranks; only the values of those bins are then counted one by one.  Both
    intermediate tables are bounded by the value range, not by the rows.
    """
    bins = (df.groupBy(*group, F.floor(F.col(value) / F.lit(width)).alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_n")))
    whole = W.partitionBy(*group)
    upto = whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = (bins.withColumn("_cum", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(whole))
            .withColumn("_lo", F.floor((F.col("_total") + 1) / F.lit(2)))
            .withColumn("_hi", F.floor((F.col("_total") + 2) / F.lit(2)))
            .withColumn("_before", F.col("_cum") - F.col("_n")))
    middle = bins.where((F.col("_before") < F.col("_hi")) & (F.col("_cum") >= F.col("_lo"))).drop("_n", "_cum")
    values = (df.withColumn("_bin", F.floor(F.col(value) / F.lit(width))).join(middle, [*group, "_bin"])
              .groupBy(*group, "_bin", "_before", "_lo", "_hi", F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    inside = W.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (values.withColumn("_to", F.col("_before") + F.sum("_n").over(inside))
              .withColumn("_from", F.col("_to") - F.col("_n")))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_from") < F.col(rank)) & (F.col("_to") >= F.col(rank)), F.col("_v")))

    return ranked.groupBy(*group).agg(((at("_lo") + at("_hi")) / F.lit(2.0)).alias(name))
