"""Statistics of a value per key: one partial aggregation each, so no key is gathered in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeworks.sources.work import spread


def _beside(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its key's row of ``found``; without keys that is one row."""
    return df.join(found, keys) if keys else df.crossJoin(F.broadcast(found))


def skip_first(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("sample_idx") >= n)


def summary(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """n, mean, std_dev (population), min per key."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"), F.min(value).alias("min"))


def moments(df: DataFrame, keys: list[str], value: str = "x", orders: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """mean, std_dev and standardised central moments m3..: from one pass of sums about each key's first-pass mean."""
    first = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"))
    centred = _beside(df, first, keys).withColumn("_z", (F.col(value) - F.col("mean")) / F.nullif(F.col("std_dev"), F.lit(0.0)))
    return centred.groupBy(*keys).agg(F.first("mean").alias("mean"), F.first("std_dev").alias("std_dev"), *[F.avg(F.pow("_z", F.lit(k))).alias(f"m{k}") for k in orders])


#: Depth of the digits of a value: twelve bits each, so five hold a double's 52.
_BINS, _DEPTH = 4096, 5


def _digits(x) -> list:
    """Columns that order values as ``x`` does, each refining the one before: the power of two with its sign, then twelve bits of the rest at a time.

    Multiplying and dividing by powers of two is exact, so is what is left after a digit. Where the logarithm rounds up to the
    next power, the rest is a hair below zero and counts as zero: bins may then hold two values, and never change their order.
    """
    size = F.abs(x)
    power = F.least(F.greatest(F.floor(F.log2(F.nullif(size, F.lit(0.0)))), F.lit(-1074)), F.lit(1023))
    sign = F.when(x < 0, -1).otherwise(1)
    special = F.when(F.isnan(x), 5000).when(size == float("inf"), 4000 * sign).when(x == 0, 0)
    out = [F.coalesce(special, sign * (power + 1100)).cast("int")]
    rest = F.when(special.isNull(), sign * F.least(F.greatest(size / F.pow(F.lit(2.0), power) - 1, F.lit(0.0)), F.lit(1 - 2.0**-53))).otherwise(0.0)
    for _ in range(_DEPTH):
        rest = rest * _BINS
        out.append(F.floor(rest).cast("int"))
        rest = rest - F.floor(rest)
    return out


def percentiles(df: DataFrame, keys: list[str], value: str = "x", at: tuple[float, ...] = (0.5, 0.75, 0.9, 1.0), exact: bool = True, most: int = 100_000) -> DataFrame:
    """p50, p75, ... per key by linear interpolation; ``exact=False`` uses bounded summaries instead.

    Exact values come by radix selection, all ranks of all keys at once: a histogram over a digit of the values tells the bins that hold the ranks
    asked for, and what lies in these is counted by its next digit, until no bin asked for has over ``most`` values that differ or the digits end. Of those bins
    alone the different values are ordered. So no task sorts more than a histogram (thousands of rows) or ``most`` different values, however skewed
    they are. The values are written once, and read once for each digit.
    """
    from fringeworks.sources.work import stored

    names = [f"p{round(100 * p)}" for p in at]
    if not exact:
        return df.groupBy(*keys).agg(*[F.percentile_approx(value, F.lit(p)).alias(name) for p, name in zip(at, names, strict=True)])
    rows = stored(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x")), "values")
    digits = [f"_d{k}" for k in range(_DEPTH + 1)]
    placed = rows.select(*keys, "_x", *[d.alias(n) for d, n in zip(_digits(F.col("_x")), digits, strict=True)])
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    rank = [(F.col("_n") - 1) * F.lit(float(p)) for p in at]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r), F.ceil(r)) for r in rank])))
    asked = totals.select(*keys, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_before"))
    for depth in range(_DEPTH + 1):
        prefix, digit = [*keys, *digits[:depth]], digits[depth]
        inside = placed.select(*prefix, digit, "_x")
        if depth:
            inside = inside.join(asked.select(*prefix).distinct(), prefix, "left_semi")
        ahead = Window.partitionBy(*prefix).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        counts = inside.groupBy(*prefix, digit).agg(F.count(F.lit(1)).alias("_m"), (F.min("_x") < F.max("_x")).alias("_several")).withColumn("_ahead", F.coalesce(F.sum("_m").over(ahead), F.lit(0)))
        met = asked.drop("_m", "_several").join(counts, prefix) if prefix else asked.crossJoin(F.broadcast(counts))
        place = F.col("_rank") - F.col("_before") - F.col("_ahead")
        asked = stored(met.where((place >= 0) & (place < F.col("_m"))).select(*prefix, digit, "_rank", (F.col("_before") + F.col("_ahead")).alias("_before"), "_m", "_several"), "ranks")
        if (asked.where("_several").agg(F.max("_m")).first()[0] or 0) <= most:
            break
    prefix = [*keys, *digits[: depth + 1]]
    values = placed.select(*prefix, "_x").join(asked.select(*prefix).distinct(), prefix, "left_semi").groupBy(*prefix, "_x").agg(F.count(F.lit(1)).alias("_m"))
    ahead = Window.partitionBy(*prefix).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_ahead", F.coalesce(F.sum("_m").over(ahead), F.lit(0)))
    place = F.col("_rank") - F.col("_before") - F.col("_ahead")
    found = asked.drop("_m", "_several").join(values, prefix).where((place >= 0) & (place < F.col("_m")))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_values"))
    found = _beside(found, totals, keys)
    low, high = (lambda r: F.col("_values")[F.floor(r)]), (lambda r: F.col("_values")[F.ceil(r)])
    between = lambda r: F.when(low(r) == high(r), low(r)).otherwise(low(r) + (high(r) - low(r)) * (r - F.floor(r)))
    return found.select(*keys, *[between(r).alias(name) for r, name in zip(rank, names, strict=True)])


def mode_flag(df: DataFrame, keys: list[str], value: str = "x", tolerance: float = 4000) -> DataFrame:
    """span (largest less smallest) and single_mode: whether it is within ``tolerance``."""
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("span")).withColumn("single_mode", F.col("span") <= tolerance)


def histogram(df: DataFrame, keys: list[str], value: str = "x", bins: int = 100) -> DataFrame:
    """bin, low, n: widths are (max - min) / bins, edges begin one width under the minimum, the last bin holds its upper edge."""
    edges = df.groupBy(*keys).agg(F.min(value).alias("_least"), ((F.max(value) - F.min(value)) / bins).alias("_width"))
    placed = _beside(df, edges, keys).where(F.col(value).isNotNull())
    number = F.when(F.col("_width") == 0, F.lit(1)).otherwise(F.least(F.floor((F.col(value) - F.col("_least")) / F.nullif(F.col("_width"), F.lit(0.0))) + 1, F.lit(bins)))
    counted = placed.withColumn("bin", number.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_least").alias("_least"), F.first("_width").alias("_width"))
    return counted.select(*keys, "bin", (F.col("_least") + (F.col("bin") - 1) * F.col("_width")).alias("low"), "n")


def axis_moments(df: DataFrame, kept: list[str], value: str = "x") -> DataFrame:
    """n, mean, var (population) over all axes but ``kept``, of a block in long form."""
    return df.groupBy(*kept).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, var of the union of parts given by (n, mean, var): mergeable in any order."""
    about = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    spread = F.col("n") * F.col("var") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2
    return _beside(parts, about, keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), (F.sum(spread) / F.sum("n")).alias("var"))


def same_shape(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """``df`` if each key's arrays have one length; a query over others fails."""
    sizes = df.groupBy(*keys).agg(F.min(F.size(array)).alias("_a"), F.max(F.size(array)).alias("_b"))
    checked = sizes.withColumn("_ok", F.when(F.col("_a") == F.col("_b"), True).otherwise(F.raise_error(F.lit("blocks differ in a kept axis")).cast("boolean")))
    return df.join(checked.where("_ok").select(*keys), keys)


def haloed(df: DataFrame, key: str, block: int, before: int, after: int) -> DataFrame:
    """Each sample in its block, and again in neighbouring blocks that need it: _own tells which is which. ``df`` is read once."""
    own, at = F.expr(f"sample_idx div {block}"), F.col("sample_idx") % block
    copies = [F.struct(own.alias("block"), F.lit(True).alias("_own"))]
    if after:
        copies.append(F.when((at < after) & (own > 0), F.struct((own - 1).alias("block"), F.lit(False).alias("_own"))))
    if before:
        copies.append(F.when(at >= block - before, F.struct((own + 1).alias("block"), F.lit(False).alias("_own"))))
    return df.select("*", F.inline(F.array_compact(F.array(*copies))))


def _mirrored(df: DataFrame, before: int, after: int, key: str) -> DataFrame:
    """``df`` with _n (samples of the trace), and the samples at its ends again beyond them; sample_idx is ``before`` more, so none is negative."""
    joined = df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    at, n = F.col("sample_idx"), F.col("_n")
    places = F.array_compact(F.array(at, F.when(at < before, -at - 1), F.when(at >= n - after, 2 * n - 1 - at)))
    return joined.withColumn("_at", F.explode(places)).withColumn("sample_idx", F.col("_at") + before).drop("_at")


def moving_mean(df: DataFrame, n: int = 32, key: str = "trace_id", value: str = "x", block: int = 1 << 17) -> DataFrame:
    """``df`` with moving: the mean over ``n`` samples about each one (n/2 before, n/2 - 1 after), mirrored at the ends.

    Blocks overlap by half a window, so a trace isn't sorted in one task. Traces shorter than half a window are not mirrored twice.
    """
    before, after = n // 2, n - n // 2 - 1
    frame = Window.partitionBy(key, "block").orderBy("sample_idx").rowsBetween(-before, after)
    cut = spread(haloed(_mirrored(df, before, after, key), key, block, before, after), df.count(), key, "block")
    made = cut.withColumn("moving", F.avg(value).over(frame)).where("_own").withColumn("sample_idx", F.col("sample_idx") - before)
    return made.where((F.col("sample_idx") >= 0) & (F.col("sample_idx") < F.col("_n"))).drop("_n", "_own", "block")


def sliding_rms(df: DataFrame, n: int = 32, key: str = "trace_id", value: str = "x", block: int = 1 << 17) -> DataFrame:
    """key, sample_idx, rms of the residual about the moving mean, where the whole window lies in the trace.

    Blocks overlap by a window, so one shuffle and one sort do for both windows. What a task sorts is about ROWS_A_TASK samples, or a block.
    """
    before, after = n // 2, n - n // 2 - 1
    block = max(block, n)  # a halo comes from the next block alone
    frame = Window.partitionBy(key, "block").orderBy("sample_idx").rowsBetween(-before, after)
    cut = spread(haloed(_mirrored(df, before, after, key), key, block, 2 * before, 2 * after), df.count(), key, "block")
    made = cut.withColumn("_r2", F.pow(F.col(value) - F.avg(value).over(frame), F.lit(2))).withColumn("rms", F.sqrt(F.avg("_r2").over(frame))).where("_own")
    made = made.withColumn("sample_idx", F.col("sample_idx") - before)
    return made.where((F.col("sample_idx") >= before) & (F.col("sample_idx") < F.col("_n") - after)).select(key, "sample_idx", "rms")
