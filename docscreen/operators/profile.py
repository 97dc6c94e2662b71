"""Aggregations: quality profile, distributions, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators.grouping import with_group_stats


def _as_long(column: Column) -> Column:
    return column.cast("long")


def one_row(spark, **parts: DataFrame) -> DataFrame:
    """Put several one-row, one-column results side by side as scalar subqueries."""
    return spark.range(1).select(*[df.scalar().alias(name) for name, df in parts.items()])


# -- quality -----------------------------------------------------------------

def quality_profile(df: DataFrame, column: str, short: int = C.MIN_CLEAN_CHARS,
                    long: int = C.LONG_CHARS) -> DataFrame:
    """Rows, missing, empty (nulls included), repeats, short and long texts (A1).

    Nulls are equal to each other when repeats are counted.
    """
    text = F.col(column)
    size = F.length(F.coalesce(text, F.lit("")))
    distinct = F.count_distinct(X.key_hash(text)) + F.coalesce(
        F.max(F.when(text.isNull(), 1)), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(text.isNull()).alias("missing"),
                  F.count_if(size == 0).alias("empty"),
                  _as_long(F.count(F.lit(1)) - distinct).alias("repeats"),
                  F.count_if(size < short).alias("short"),
                  F.count_if(size > long).alias("long"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls and type per column (A2)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f.name).alias("nulls")) for f in df.schema.fields])))


def repeated_rows(df: DataFrame) -> DataFrame:
    """Number of rows equal to an earlier row in every column (A2)."""
    whole = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.agg(_as_long(F.count(F.lit(1)) - F.count_distinct(whole)).alias("repeated_rows"))


def length_stats(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Mean, median, min, max, sample deviation of characters and tokens (A3).

    The exact median counts distinct lengths, not rows; ``approximate`` bounds it further.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    measured = df.select(F.inline(F.array(
        F.struct(F.lit("chars").alias("measure"), F.length(text).alias("n")),
        F.struct(F.lit("tokens").alias("measure"), X.word_count(text).alias("n")))))
    median = (F.percentile_approx("n", 0.5) if approximate else F.median("n")).cast("double")
    return measured.groupBy("measure").agg(
        F.avg("n").alias("mean"), median.alias("median"), _as_long(F.min("n")).alias("min"),
        _as_long(F.max("n")).alias("max"), F.stddev_samp("n").alias("std"))


def length_histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins of characters and tokens with their edges and the median (A4).

    Every bin between the shortest and the longest text is there, empty ones included.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    # Rows with the same length share everything that follows.
    counted = (df.select(F.inline(F.array(
        F.struct(F.lit("chars").alias("measure"), F.length(text).alias("n")),
        F.struct(F.lit("tokens").alias("measure"), X.word_count(text).alias("n")))))
        .groupBy("measure", "n").agg(F.count(F.lit(1)).alias("rows")))
    limits = counted.groupBy("measure").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.expr("percentile(n, 0.5, rows)").alias("median"))
    width = F.greatest(F.col("high") - F.col("low"), F.lit(1)) / bins
    grid = limits.select("measure", "median", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
                         (F.col("low") + F.col("bin") * width).alias("from_length"),
                         (F.col("low") + (F.col("bin") + 1) * width).alias("to_length"))
    bin_no = F.least(F.floor((F.col("n") - F.col("low")) * bins / F.greatest(
        F.col("high") - F.col("low"), F.lit(1))), F.lit(bins - 1))
    filled = (counted.join(limits.select("measure", "low", "high"), "measure")
              .groupBy("measure", bin_no.alias("bin")).agg(F.sum("rows").alias("rows")))
    return (grid.join(filled, ["measure", "bin"], "left")
            .select("measure", _as_long(F.col("bin")).alias("bin"), "from_length", "to_length",
                    F.coalesce("rows", F.lit(0)).alias("rows"), "median"))


# -- classes -----------------------------------------------------------------

def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return (df.filter(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("rows")))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percent of all rows per class, largest first (A5)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (class_counts(df, label)
            .withColumn("percent", F.round(F.col("rows") / total * 100, 2))
            .orderBy(F.desc("rows"), label))


def class_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Smallest, largest and mean class, number of classes (A6); ties go to the first label."""
    return class_counts(df, label).agg(
        F.count(F.lit(1)).alias("classes"),
        F.min(F.struct("rows", F.col(label).alias("l"))).alias("_low"),
        F.min(F.struct((-F.col("rows")).alias("rows"), F.col(label).alias("l"))).alias("_high"),
        F.avg("rows").alias("mean_rows"),
    ).select("classes", F.col("_low.rows").alias("min_rows"), F.col("_low.l").alias("min_label"),
             (-F.col("_high.rows")).alias("max_rows"), F.col("_high.l").alias("max_label"),
             "mean_rows")


def tiny_classes(df: DataFrame, label: str = "label", rows: int = C.TINY_CLASS_ROWS) -> DataFrame:
    return class_counts(df, label).filter(F.col("rows") < rows)


def label_validation(df: DataFrame, label: str) -> DataFrame:
    """Labelled and unknown rows; a missing label is unknown."""
    unknown = F.col(label).isNull() | F.startswith(F.col(label), F.lit("Unknown"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~unknown).alias("labelled"),
                  F.count_if(unknown).alias("unknown"),
                  F.count_distinct(label).alias("unique_labels"))


def distinct_counts(df: DataFrame, columns, approximate: bool = False) -> DataFrame:
    """Distinct values per column (A9); long values are compared by hash."""
    def count(name: str) -> Column:
        column = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            column = X.key_hash(column)
        return F.approx_count_distinct(column) if approximate else F.count_distinct(column)

    return df.agg(*[count(c).alias(c) for c in columns])


def unique_per_class(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Unique and total texts per class, counted in two combinable steps (A10)."""
    pairs = (df.select(label, X.key_hash(F.col(text)).alias("_key")).groupBy(label, "_key")
             .agg(F.count(F.lit(1)).alias("_n")))
    return pairs.groupBy(label).agg(F.count("_key").alias("unique_texts"),
                                    F.sum("_n").alias("total"))


# -- sketches that combine across runs (A3, A9, A10) ---------------------------

#: 2^14 registers: a standard error of 0.8 percent of the distinct count.
DISTINCT_BITS = 14
#: Items of a quantile sketch: ranks are right within about 0.7 percent.
QUANTILE_ITEMS = 400


def class_sketches(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """One row a class: rows, and sketches of its distinct normalised texts and of its text lengths.

    Store them by run; ``merged_sketches`` of any number of runs is what one run over all rows gives.
    """
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(X.key_hash(F.col(text)), F.lit(DISTINCT_BITS)).alias("texts"),
        F.kll_sketch_agg_bigint(F.length(F.coalesce(text, F.lit(""))).cast("bigint"), F.lit(QUANTILE_ITEMS)).alias("chars"))


def merged_sketches(stored: DataFrame, label: str = "label") -> DataFrame:
    return stored.groupBy(label).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("texts").alias("texts"),
        F.kll_merge_agg_bigint("chars", F.lit(QUANTILE_ITEMS)).alias("chars"))


def sketch_estimates(sketches: DataFrame, label: str = "label", quantiles: Sequence[float] = (0.25, 0.5, 0.75),
                     ) -> DataFrame:
    """Estimated distinct texts and quantiles of the text length of each class."""
    return sketches.select(label, "rows", F.hll_sketch_estimate("texts").alias("unique_texts"), *[
        F.kll_sketch_get_quantile_bigint("chars", F.lit(float(q))).alias(f"chars_{round(100 * q)}") for q in quantiles])


# -- repetition --------------------------------------------------------------

def repetition(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per distinct text: number of rows and the lowest id."""
    return (df.filter(F.col(text).isNotNull())
            .select(row_id, X.key_hash(F.col(text)).alias("_key")).groupBy("_key")
            .agg(F.count(F.lit(1)).alias("times"), F.min(row_id).alias("first_id")))


def repeat_top(df: DataFrame, text: str = "text", row_id: str = "doc_id", n: int = 10) -> DataFrame:
    """The ``n`` most repeated texts with an 80-character snippet."""
    # n rows: the top-k itself bounds the broadcast.
    top = repetition(df, text, row_id).orderBy(F.desc("times"), "first_id").limit(n)
    return (df.select(F.col(row_id).alias("first_id"),
                      F.replace(F.left(text, F.lit(80)), F.lit("\n"), F.lit(" ")).alias("snippet"))
            .join(F.broadcast(top.select("first_id", "times")), "first_id"))


def repeat_summary(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Texts seen once, more than once, and in all."""
    return repetition(df, text, row_id).agg(
        F.count_if(F.col("times") == 1).alias("once"),
        F.count_if(F.col("times") > 1).alias("repeated"),
        F.count(F.lit(1)).alias("distinct_texts"))


# -- balance -----------------------------------------------------------------

def imbalance(df: DataFrame, label: str = "label", ratio: float = C.IMBALANCE_RATIO) -> DataFrame:
    """Largest over smallest class, and whether class weights are called for."""
    return (class_counts(df, label)
            .agg((F.max("rows") / F.min("rows")).alias("ratio"))
            .withColumn("use_weights", F.col("ratio") >= ratio))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``n / (k * n_c)`` per class."""
    counts = class_counts(df, label)
    totals = counts.agg(F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return (counts.withColumn("_t", totals)
            .select(label, "rows", (F.col("_t.n") / (F.col("_t.k") * F.col("rows")))
                    .alias("weight")))


def with_class_weight(df: DataFrame, label: str = "label", row_id: str = "doc_id") -> DataFrame:
    """Every row with its class weight, for ``weightCol``."""
    total = class_counts(df, label).agg(
        F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return (with_group_stats(df, [label], row_id, few_keys=True,
                             _class_rows=F.count(F.lit(1)))
            .withColumn("_t", total)
            .withColumn("weight", F.col("_t.n") / (F.col("_t.k") * F.col("_class_rows")))
            .drop("_t", "_class_rows"))


# -- lines and labels (A14) ---------------------------------------------------

def line_label_pairs(df: DataFrame, line: Column, label: str = "label") -> DataFrame:
    return (df.select(line.alias("line"), F.col(label).alias("label"))
            .filter(F.col("line").isNotNull() & F.col("label").isNotNull())
            .groupBy("line", "label").agg(F.count(F.lit(1)).alias("rows")))


def line_label_cardinality(df: DataFrame, line: Column, label: str = "label") -> DataFrame:
    """Lines that belong to exactly one label, and to more than one."""
    per_line = line_label_pairs(df, line, label).groupBy("line").agg(
        F.count(F.lit(1)).alias("labels"))
    return per_line.agg(F.count_if(F.col("labels") == 1).alias("single_label_lines"),
                        F.count_if(F.col("labels") > 1).alias("multi_label_lines"))


def most_common_line(df: DataFrame, line: Column, label: str = "label") -> DataFrame:
    """Most frequent line per label; ties go to the first line."""
    best = F.min(F.struct((-F.col("rows")).alias("neg"), F.col("line").alias("line")))
    return (line_label_pairs(df, line, label).groupBy("label").agg(best.alias("_b"))
            .select("label", F.col("_b.line").alias("line"), (-F.col("_b.neg")).alias("rows")))


def split_class_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows per split and class, with a total per split."""
    return (df.rollup(split, label).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col(split).isNotNull())
            .withColumn(label, F.coalesce(label, F.lit("(all)"))))


def error_pairs(df: DataFrame, label: str = "label", prediction: str = "prediction",
                n: int = 10) -> DataFrame:
    """Most frequent confusions."""
    return (df.filter(F.col(label) != F.col(prediction)).groupBy(label, prediction)
            .agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), label, prediction).limit(n))
