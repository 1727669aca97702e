"""Declared rules compiled to Column expressions, reports, quarantine and split checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col, describe_rows, numeric_columns, one_row
from quern.operators.quality import duplicate_counts, remove_duplicates

# Names shown for rule types in messages.
TYPE_NAMES = {"double": "float", "int": "int", "bigint": "int", "string": "str"}


class SchemaError(ValueError):
    """A required column is absent."""


@dataclass
class Rule:
    name: str
    dtype: str | None = None
    required: bool = True
    allow_null: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: Sequence[Any] | None = None
    custom_check: Callable[[Column], Column] | None = None
    not_blank: bool = False
    above: float | None = None


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)

    def missing_columns(self, df: DataFrame) -> list[str]:
        return [r.name for r in self.rules if r.required and r.name not in df.columns]


def _failures(rule: Rule) -> list[Column]:
    """Message per failing check of one column, in order; missing where the check holds."""
    c, label = col(rule.name), f"Column '{rule.name}'"
    text = c.cast("string")
    found = []
    if not rule.allow_null:
        found.append(F.when(c.isNull(), F.lit(f"{label} is null")))
    number = c.try_cast("double")
    if rule.dtype is not None:
        bad = c.isNotNull() & c.try_cast(rule.dtype).isNull()
        found.append(F.when(bad, F.concat(F.lit(f"{label} expected type {TYPE_NAMES.get(rule.dtype, rule.dtype)}, got "), text)))
    if rule.not_blank:
        found.append(F.when(F.trim(text) == "", F.lit(f"{label} is blank")))
    if rule.above is not None:
        found.append(F.when(number <= rule.above, F.concat(F.lit(f"{label} value "), text, F.lit(f" not above {rule.above}"))))
    if rule.min_value is not None:
        found.append(F.when(number < rule.min_value, F.concat(F.lit(f"{label} value "), text, F.lit(f" below minimum {rule.min_value}"))))
    if rule.max_value is not None:
        found.append(F.when(number > rule.max_value, F.concat(F.lit(f"{label} value "), text, F.lit(f" above maximum {rule.max_value}"))))
    if rule.allowed_values is not None:
        found.append(F.when(~c.isin(list(rule.allowed_values)), F.concat(F.lit(f"{label} value "), text, F.lit(" not in allowed set"))))
    if rule.custom_check is not None:
        found.append(F.when(c.isNotNull() & ~F.coalesce(rule.custom_check(c), F.lit(False)), F.concat(F.lit(f"{label} failed custom check for value "), text)))
    return found


def row_error(df: DataFrame, rules: RuleSet) -> Column:
    """First failing check in declared order, or missing for a valid row."""
    checks = [m for r in rules.rules if r.name in df.columns for m in _failures(r)]
    return F.coalesce(*checks, F.lit(None).cast("string"))


def check_rows(df: DataFrame, rules: RuleSet, out: str = "error") -> DataFrame:
    return df.withColumn(out, row_error(df, rules))


def validation_report(df: DataFrame, rules: RuleSet, strict: bool = False) -> DataFrame:
    """Tidy report (measure, value): totals, valid rows, duplicates, errors, missing per column."""
    absent = rules.missing_columns(df)
    if strict and absent:
        raise SchemaError(f"Missing required column: '{absent[0]}'")
    present = [r.name for r in rules.rules if r.name in df.columns]
    rows = check_rows(df, rules, "_error").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("_error").isNull()).alias("valid_rows"),
        F.count("_error").alias("row_errors"),
        *[F.count_if(col(c).isNull()).alias(f"missing_{c}") for c in present],
    )
    names = rows.columns
    main = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), col(n).alias("value")) for n in names])))
    copies = duplicate_counts(df).select(F.lit("duplicate_rows").alias("measure"), F.col("duplicate_rows").alias("value"))
    schema = describe_rows(df.sparkSession, [("schema_errors", len(absent))], "measure string, value bigint")
    base = main.unionByName(copies).unionByName(schema)
    bad = F.col("measure").isin("row_errors", "duplicate_rows", "schema_errors") & (F.col("value") > 0)
    flag = base.agg((F.count_if(bad) == 0).cast("long").alias("value")).select(F.lit("is_valid").alias("measure"), "value")
    return base.unionByName(flag)


def clean(df: DataFrame, rules: RuleSet, drop_duplicates: bool = True, drop_invalid: bool = True) -> DataFrame:
    out = remove_duplicates(df) if drop_duplicates else df
    return out.where(row_error(out, rules).isNull()) if drop_invalid else out


def quarantine(df: DataFrame, rules: RuleSet, row_id: str) -> DataFrame:
    """Every failing row as (row_id, error_type, message)."""
    checked = check_rows(df, rules, "message").where("message is not null")
    return checked.select(col(row_id).alias("row_id"), F.lit("DataValidationError").alias("error_type"), "message")


def error_summary(errors: DataFrame, shown: int = 20) -> DataFrame:
    """The first `shown` errors and one line with the number of the others."""
    first = errors.orderBy("row_id").limit(shown)
    total = errors.agg(F.count("*").alias("n"))
    lines = first.select("row_id", F.concat(F.lit("["), "error_type", F.lit("] "), "message").alias("line"))
    rest = total.where(F.col("n") > shown).select(F.lit(None).cast("long").alias("row_id"), F.format_string("%d more error(s) not shown", F.col("n") - shown).alias("line"))
    return lines.select(F.col("row_id").cast("long"), "line").unionByName(rest)


def applicant_rules() -> RuleSet:
    """The applicant scoring contract."""
    return RuleSet([
        Rule("age", "double", above=0),
        Rule("income", "double", min_value=0),
        Rule("credit_score", "double", min_value=300, max_value=850),
        Rule("loan_amount", "double", min_value=0),
        Rule("years_employed", "double", min_value=0),
        *[Rule(c, "string", not_blank=True) for c in ("education", "employment_status", "marital_status", "housing_type", "application_date")],
    ])


def readiness(df: DataFrame, target: str, least: int = 10) -> DataFrame:
    """One row: rows, features, infinite cells, classes, smallest class percent (≤10 classes), ready flag."""
    numbers = [c for c in numeric_columns(df) if c != target]
    infinite = reduce(lambda a, b: a + b, [F.count_if(F.abs(col(c).cast("double")) == float("inf")) for c in numbers], F.lit(0))
    base = df.agg(F.count("*").alias("rows"), infinite.cast("long").alias("infinite_cells"))
    classes = df.where(col(target).isNotNull()).groupBy(col(target)).count().agg(F.count("*").alias("classes"), F.min("count").alias("smallest"))
    a, b = base.collect()[0], classes.collect()[0]
    share = 100.0 * b["smallest"] / a["rows"] if b["classes"] and b["classes"] <= 10 and a["rows"] else None
    return describe_rows(
        df.sparkSession,
        [(a["rows"], len(df.columns) - 1, a["infinite_cells"], b["classes"], share, a["rows"] >= least)],
        "rows bigint, features int, infinite_cells bigint, classes bigint, smallest_class_percent double, ready boolean",
    )


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """md5 of all values as text joined by two bars; a missing value reads `nan`."""
    cols = list(columns) if columns is not None else df.columns
    return F.md5(F.concat_ws("||", *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in cols]))


def fingerprint_collisions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fingerprints that occur more than once."""
    return df.select(fingerprint(df, columns).alias("row_hash")).groupBy("row_hash").agg(F.count("*").alias("copies")).where("copies > 1")


def split_overlaps(splits: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Pairwise fingerprint overlap of splits and whether their columns agree in order.

    One pass: every fingerprint is tagged with the splits it occurs in, then pairs are counted.
    """
    names = list(splits)
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(fingerprint(df, columns).alias("h"), F.lit(n).alias("split")) for n, df in splits.items()],
    )
    seen = tagged.groupBy("h").agg(*[F.max((F.col("split") == n).cast("int")).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    one = seen.agg(*[F.coalesce(F.sum(col(a) * col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in pairs])
    same = {(a, b): splits[a].columns == splits[b].columns for a, b in pairs}
    return one.select(
        F.inline(F.array(*[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), col(f"{a}|{b}").alias("overlap"), F.lit(same[a, b]).alias("same_columns"))
            for a, b in pairs
        ]))
    )
