"""Rule suggestions from profiles, and import of externally written rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import constants as C
from verisift.functions.expressions import quoted, stamp
from verisift.session import settle

from .profile import column_stats, declared_class, value_summary

# Thresholds of the suggested rules
MAX_NULL_PERCENT = 5
MIN_UNIQUE_PERCENT = 95
RANGE_MARGIN = 0.1
CONSTANT_MARGIN = 1
LENGTH_MARGIN = 10
MIN_LENGTH = 1

# Types whose observed range becomes a rule
RANGED_TYPES = ("int", "bigint", "double")


def _proposal(order: int, when: Column, rule_type: str, severity: Column, text: Column, params: Column) -> Column:
    return F.when(when, F.struct(
        F.lit(order).alias("order"),
        F.lit(rule_type).alias("rule_type"),
        severity.alias("severity"),
        text.alias("description"),
        params.alias("params"),
    ))


def suggest(columns: DataFrame, max_rules: int | None = None) -> DataFrame:
    """Rules in the rules-table form, numbered in column order.

    Works on a profile, so its input has one row per column of the profiled table.
    """
    name = F.concat(F.lit("'"), F.col("column_name"), F.lit("'"))
    is_text = F.col("data_type") == "string"
    low, high = F.col("min_number"), F.col("max_number")
    margin = F.when(high != low, F.abs(high - low) * RANGE_MARGIN).otherwise(F.lit(float(CONSTANT_MARGIN)))
    shown = lambda c: F.col(c).cast("string")
    proposals = F.array(
        _proposal(
            1, F.col("null_percentage") < MAX_NULL_PERCENT, C.NOT_NULL,
            F.when(F.col("null_count") == 0, "high").otherwise("medium"),
            F.concat(name, F.lit(" should not be null (observed "), shown("null_percentage"), F.lit("% nulls)")),
            F.lit("{}"),
        ),
        _proposal(
            2, F.col("uniqueness_ratio") > MIN_UNIQUE_PERCENT, C.UNIQUENESS, F.lit("critical"),
            F.concat(name, F.lit(" appears to be a unique identifier ("), shown("uniqueness_ratio"), F.lit("% unique)")),
            F.lit("{}"),
        ),
        _proposal(
            3, is_text & (F.size("domain_values") > 0), C.DOMAIN_CHECK, F.lit("medium"),
            F.concat(name, F.lit(" should be within known domain values")),
            F.to_json(F.struct(F.col("domain_values").alias("allowed_values"))),
        ),
        _proposal(
            4, F.col("data_type").isin(*RANGED_TYPES) & low.isNotNull() & high.isNotNull(),
            C.RANGE_CHECK, F.lit("medium"),
            F.concat(name, F.lit(" should be between "), shown("min_value"), F.lit(" and "), shown("max_value")),
            F.to_json(F.struct((low - margin).alias("min_value"), (high + margin).alias("max_value"))),
        ),
        _proposal(
            5, is_text & F.col("min_length").isNotNull() & F.col("max_length").isNotNull(),
            C.LENGTH_CHECK, F.lit("low"),
            F.concat(name, F.lit(" length should be between "), shown("min_length"), F.lit(" and "), shown("max_length")),
            F.to_json(F.struct(
                F.greatest(F.lit(MIN_LENGTH), F.col("min_length")).alias("min_length"),
                (F.col("max_length") + LENGTH_MARGIN).alias("max_length"),
            )),
        ),
    )
    listed = columns.select("position", "column_name", F.inline(F.array_compact(proposals)))
    # At most five rows per column of the profiled table: a one-partition sort is enough.
    numbered = listed.withColumn("n", F.row_number().over(W.orderBy("position", "order")))
    if max_rules is not None:
        numbered = numbered.filter(F.col("n") <= max_rules)
    return numbered.select(
        F.format_string("H_R%03d", F.col("n")).alias("rule_id"),
        "rule_type",
        F.col("column_name").alias("column"),
        "severity",
        "description",
        F.lit(True).alias("active"),
        "params",
    )


def rule_set(rules: DataFrame, *, dataset_id: str, generated_by: str = "heuristic_fallback", as_of=None) -> DataFrame:
    """Rules labelled with the dataset they belong to and their origin."""
    return rules.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(generated_by).alias("generated_by"),
        stamp(as_of).alias("generated_at"), *rules.columns,
    )


RAW_RULES = T.StructType([T.StructField("rules", T.ArrayType(T.StringType()))])


def import_rules(responses: DataFrame, text: str, max_rules: int | None = None) -> DataFrame:
    """Rules from JSON documents of the form ``{"rules": [{...}, ...]}``.

    Every document contributes all its entries, or its first ``max_rules``; entries without a known
    rule type, a column and a known severity are dropped.  Other columns of ``responses``
    are carried along.
    """
    carried = [c for c in responses.columns if c != text]
    parsed = responses.select(
        *[quoted(c) for c in carried], F.posexplode(F.from_json(quoted(text), RAW_RULES)["rules"]).alias("n", "raw")
    )
    if max_rules is not None:
        parsed = parsed.filter(F.col("n") < max_rules)
    field = lambda name: F.get_json_object("raw", f"$.{name}")
    rules = parsed.select(
        *[quoted(c) for c in carried],
        F.coalesce(field("rule_id"), F.format_string("AI_R%03d", F.col("n") + 1)).alias("rule_id"),
        field("rule_type").alias("rule_type"),
        field("column").alias("column"),
        F.coalesce(field("severity"), F.lit("medium")).alias("severity"),
        F.coalesce(field("description"), F.lit("")).alias("description"),
        F.lit(True).alias("active"),
        F.coalesce(field("params"), F.lit("{}")).alias("params"),
    )
    return rules.filter(
        F.col("rule_type").isin(*C.RULE_TYPES)
        & F.col("column").isNotNull()
        & F.col("severity").isin(*C.SEVERITIES)
    )


# --- constraint suggestions -----------------------------------------------------------

# Below this share of present values no completeness bound is proposed
MIN_COMPLETENESS = 0.2
# Normal quantile of a 95% interval
INTERVAL_Z = 1.96
# Text columns with at most this share of distinct values are categories
MAX_CATEGORY_SHARE = 0.1


def suggest_constraints(
    df: DataFrame, *, max_categories: int, min_completeness: float = MIN_COMPLETENESS,
    max_category_share: float = MAX_CATEGORY_SHARE,
) -> DataFrame:
    """``column_name, constraint_rule, constraint_desc`` proposals for one table.

    Complete columns stay complete; partly filled ones, above a share of
    ``min_completeness``, keep the lower end of the 95% interval of their completeness; text
    that reads as numbers or booleans keeps its type; text with few distinct values, at most
    ``max_categories`` and a share of ``max_category_share``, keeps its value list (the rule
    spells it out, so the caller says how long it may get); numbers that are never negative
    stay so.
    """
    # one row per column of the profiled table, used by both kinds of proposal
    stats = settle(column_stats(df))
    share, rows = F.col("completeness"), F.col("row_count")
    bound = F.floor((share - INTERVAL_Z * F.sqrt(share * (1 - share) / rows)) * 100) / 100
    col = F.col("column_name")
    partly = (share < 1) & (share > min_completeness) & (bound > 0)
    missing = F.round((1 - bound) * 100).cast("int")

    def proposal(order: int, when: Column, rule: Column, text: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(order).alias("order"), rule.alias("constraint_rule"), text.alias("constraint_desc"),
        ))

    def call(name: str, *arguments: Column) -> Column:
        return F.concat(F.lit(f'.{name}("'), col, F.lit('"'), *arguments, F.lit(")"))

    inferred = (F.col("declared_type") == "string") & F.col("data_type").isin("Integral", "Fractional", "Boolean")
    proposals = F.array_compact(F.array(
        proposal(1, (share == 1) & (rows > 0), call("isComplete"), F.concat(F.lit("'"), col, F.lit("' is not null"))),
        proposal(
            2, partly, call("hasCompleteness", F.lit(", lambda x: x >= "), bound.cast("string")),
            F.concat(F.lit("'"), col, F.lit("' has less than "), missing.cast("string"), F.lit("% missing values")),
        ),
        proposal(
            3, inferred,
            call("hasDataType", F.lit(", ConstrainableDataTypes."), F.col("data_type")),
            F.concat(F.lit("'"), col, F.lit("' has type "), F.col("data_type")),
        ),
        proposal(
            5, F.col("data_type").isin("Integral", "Fractional") & (F.col("minimum") >= 0),
            call("isNonNegative"), F.concat(F.lit("'"), col, F.lit("' has no negative values")),
        ),
    ))
    fixed = stats.select("position", "column_name", F.inline(proposals))
    return fixed.unionByName(_category_lists(df, stats, max_categories, max_category_share)).drop("order_key")


def _category_lists(df: DataFrame, stats: DataFrame, longest: int, most_share: float) -> DataFrame:
    """Value-list proposals for text columns that take few values."""
    text = [f.name for f in df.schema.fields if declared_class(f.dataType) is None]
    if not text:
        return stats.select(
            "position", "column_name", F.lit(4).alias("order"),
            F.lit("").alias("constraint_rule"), F.lit("").alias("constraint_desc"),
        ).limit(0)
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name in text]
    size, ranked = value_summary(df, fields, longest)
    size = size.withColumnRenamed("exact_distinct", "distinct")
    entry = F.struct(F.col("__rank").alias("rank"), F.col("value").alias("value"))
    lists = ranked.groupBy("position").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"]).alias("values")
    )
    few = size.join(lists, "position").join(
        stats.select("position", "column_name", "data_type"), "position"
    ).filter(
        (F.col("distinct") <= F.col("present") * most_share)
        & (F.col("distinct") <= longest)
        & (F.col("data_type") == "String")
    )
    literals = F.transform("values", lambda v: F.to_json(F.array(v)))
    inner = F.transform(literals, lambda v: F.substring(v, 2, F.length(v) - 2))
    shown = F.transform("values", lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return few.select(
        "position", "column_name", F.lit(4).alias("order"),
        F.concat(
            F.lit('.isContainedIn("'), F.col("column_name"), F.lit('", ['), F.array_join(inner, ", "), F.lit("])")
        ).alias("constraint_rule"),
        F.concat(
            F.lit("'"), F.col("column_name"), F.lit("' has value range "), F.array_join(shown, ", ")
        ).alias("constraint_desc"),
    )


def constraint_rules(
    suggestions: DataFrame, *, db_name: str, table_name: str, as_of=None
) -> DataFrame:
    """Suggestions as inactive rows of the rules table."""
    return suggestions.select(
        F.lit(db_name).alias("db_name"),
        F.lit(table_name).alias("table_name"),
        "column_name",
        "constraint_rule",
        "constraint_desc",
        F.lit("N").alias("is_active"),
        F.lit("N").alias("reject_capture"),
        F.lit("verify").alias("rule_type"),
        F.lit("Error").alias("check_level"),
        F.col("constraint_rule").alias("check_message"),
        stamp(as_of).alias("audit_create_date"),
    )


def only_new(suggested: DataFrame, existing: DataFrame) -> DataFrame:
    """Suggestions whose (db, table, column, rule) is not among the existing rules."""
    keys = ["db_name", "table_name", "column_name", "constraint_rule"]
    return suggested.join(existing.select(*keys).distinct(), keys, "left_anti")
