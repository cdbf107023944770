"""Algebra of weighted type unions, as rows (key..., type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lighter types are dropped, no more types are kept, and a mixed union's certainty is capped.
LIGHTEST, MOST_TYPES, MOST_CERTAIN = 0.05, 5, 0.9


def normalize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Equal types merged by the sum of their weights."""
    return rows.groupBy(*keys, "type").agg(F.round(F.sum("weight"), 9).alias("weight"))


def share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weights scaled to sum 1 within each key; keys of no weight are left out."""
    total = rows.groupBy(*keys).agg(F.sum("weight").alias("_total"))
    return rows.join(total, keys).where("_total > 0").withColumn("weight", F.round(F.col("weight") / F.col("_total"), 9)).drop("_total")


def _mean(total: str, n: str) -> Column:
    """Exact decimal sums divided once, so that no order of adding tells on the result."""
    return (F.col(total) / F.col(n).cast("decimal(18,0)")).cast("double")


def create(inputs: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """The union of n inputs, each of weight 1/n, with certainty: the mean confidence (to nine places), capped if types are mixed."""
    counts = inputs.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(confidence).cast("decimal(18,9)")).alias("_c"))
    all_ = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum("_c").alias("_sure"), F.count(F.lit(1)).alias("_types"))
    mean = _mean("_sure", "_all")
    certain = F.when(F.col("_types") > 1, F.least(mean, F.lit(MOST_CERTAIN))).otherwise(mean)
    return counts.join(all_, keys).select(*keys, "type", F.round(F.col("_n") / F.col("_all"), 9).alias("weight"), certain.alias("certainty"))


def combine(inputs: DataFrame, keys: list[str], one: str, confidence: str) -> DataFrame:
    """The union of inputs that may be unions themselves: type, weight and certainty, simplified.

    ``inputs`` has a row for each type of each input (``one`` tells them apart within ``keys``),
    its weight within the input (1 for a plain type) and the input's confidence; an input whose
    type is null brings none, but counts. Each of n inputs weighs 1/n. An only input stays as it
    is; several are simplified, and certain by the mean confidence, capped if types stay mixed.
    Keys whose inputs bring no type are left out.
    """
    each = inputs.groupBy(*keys, one).agg(F.max(F.col(confidence).cast("decimal(18,9)")).alias("_c"))
    sized = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.sum("_c").alias("_sure"))
    summed = inputs.where("type IS NOT NULL").groupBy(*keys, "type").agg(F.sum("weight").alias("_w"))
    weighed = summed.join(sized, keys).withColumn("weight", F.round(F.col("_w") / F.col("_all"), 9))
    only = weighed.where("_all = 1").select(*keys, "type", "weight", _mean("_sure", "_all").alias("certainty"))
    simple = simplify(weighed.where("_all > 1").select(*keys, "type", "weight"), keys).withColumn("_types", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    mean = _mean("_sure", "_all")
    several = simple.join(sized, keys).select(*keys, "type", "weight", F.when(F.col("_types") > 1, F.least(mean, F.lit(MOST_CERTAIN))).otherwise(mean).alias("certainty"))
    return only.unionByName(several)


def family(type_: Column) -> Column:
    """Number or String for these types with or without qualifiers, else null."""
    return F.when(type_.rlike(r"^Number(\(|$)"), "Number").when(type_.rlike(r"^String(\(|$)"), "String")


def simplify(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A union of numbers only, or of strings only, becomes that type with all its weight.

    Of others light types are dropped, the rest scaled, the heaviest kept; the cut is not scaled again.
    """
    told = normalize(rows, keys).withColumn("_f", family(F.col("type")))
    # One exchange: all that is asked of a union are windows over the same keys.
    mine = Window.partitionBy(*keys)
    one = F.coalesce((F.min("_f").over(mine) == F.max("_f").over(mine)) & (F.count("_f").over(mine) == F.count(F.lit(1)).over(mine)), F.lit(False))
    told = told.withColumn("_one", one).where(F.col("_one") | (F.col("weight") >= LIGHTEST)).withColumn("_total", F.sum("weight").over(mine))
    rank = F.row_number().over(mine.orderBy(F.desc("weight"), "type"))
    scaled = F.when(F.col("_one"), F.round("_total", 9)).otherwise(F.round(F.col("weight") / F.col("_total"), 9))
    kept = told.where("_total > 0").withColumn("weight", scaled).withColumn("type", F.when(F.col("_one"), F.col("_f")).otherwise(F.col("type")))
    return kept.withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("_one"), 1).otherwise(MOST_TYPES)).drop("_r", "_total", "_one", "_f")


def look_up(rows: DataFrame, keys: list[str], type_: str) -> DataFrame:
    """Whether the union holds the type, with what weight, and which type is the likeliest."""
    weight = F.sum(F.when(F.col("type") == type_, F.col("weight")).otherwise(0.0))
    likely = F.min_by("type", F.struct(-F.col("weight"), "type"))
    return rows.groupBy(*keys).agg((F.count_if(F.col("type") == type_) > 0).alias("contains"), F.round(weight, 6).alias("weight"), likely.alias("likely"), F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))


def where(rows: DataFrame, keys: list[str], predicate: Column) -> DataFrame:
    """The union without the types that fail, scaled again."""
    return share(rows.where(predicate), keys)


def add(rows: DataFrame, keys: list[str], type_: str, confidence: float) -> DataFrame:
    """Weights taken as confidences and one more input added; all inputs then weigh the same."""
    more = rows.select(*keys).distinct().select(*keys, F.lit(type_).alias("type"), F.lit(confidence).alias("weight"))
    return create(rows.select(*keys, "type", "weight").unionByName(more), keys, "weight")


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Types of both unions with the product of their weights."""
    both = normalize(a, keys).alias("a").join(normalize(b, keys).withColumnRenamed("weight", "_w"), [*keys, "type"])
    return both.select(*keys, "type", F.round(F.col("weight") * F.col("_w"), 9).alias("weight"))


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All types of both unions, each side with half its weight."""
    half = lambda d: d.select(*keys, "type", (F.col("weight") * 0.5).alias("weight"))
    return normalize(half(a).unionByName(half(b)), keys)
