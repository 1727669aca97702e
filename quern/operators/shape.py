"""Column names, text and number coercion, schema shaping, column roles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import (
    col,
    describe_rows,
    is_numeric,
    numeric_columns,
    one_row,
    per_column,
    replace_columns,
    string_columns,
    time_columns,
)
from quern.operators.aggs import distinct_counts

# Texts that stand for "missing" after trimming.
MISSING_TEXTS = ["nan", "None", ""]


def squeeze(c: Column) -> Column:
    """Trim and collapse any Unicode whitespace to single spaces."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_ends(c: Column) -> Column:
    """Trim any Unicode whitespace, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def standard_name(name: str) -> str:
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name.strip().lower()))


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower snake-case column names; refuses names that would clash."""
    names = [standard_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names clash after cleaning: {clash}")
    return df.toDF(*names)


def standard_text(c: Column) -> Column:
    text = squeeze(c)
    return F.when(~text.isin(MISSING_TEXTS), text)


def standardize_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Trim, collapse whitespace and turn placeholder texts into missing."""
    cols = [c for c in columns if c in df.columns] if columns is not None else string_columns(df)
    return replace_columns(df, {c: standard_text(col(c).cast("string")) for c in cols})


def to_number(c: Column) -> Column:
    """Number or missing; never an error. NaN texts and NaN values are missing."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def messy_number(c: Column) -> Column:
    """Number after dropping thousands commas, currency marks and percent signs."""
    return to_number(F.regexp_replace(F.trim(c.cast("string")), r"Rs\.?|[,₹$€£%\s]", ""))


def coerce_numeric(df: DataFrame, columns: Iterable[str], messy: bool = False) -> DataFrame:
    pick = messy_number if messy else to_number
    return replace_columns(df, {c: pick(col(c)) for c in columns if c in df.columns})


def coercion_losses(df: DataFrame, columns: Sequence[str], messy: bool = False) -> DataFrame:
    """Per column: how many present values are not numbers."""
    pick = messy_number if messy else to_number
    return per_column(df, columns, {"lost": lambda c: F.count_if(col(c).isNotNull() & pick(col(c)).isNull())})


def enforce_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the listed columns in order: absent ones added as missing, present ones cast
    unless some value would be lost, in which case the column stays as it is."""
    present = [c for c in schema if c in df.columns]
    lossy: set[str] = set()
    if present:
        flags = one_row(df, *[F.max((col(c).isNotNull() & col(c).try_cast(schema[c]).isNull()).cast("int")) for c in present])
        lossy = {c for c, f in zip(present, flags) if f == 1}
    out = []
    for c, dtype in schema.items():
        if c not in df.columns:
            out.append(F.lit(None).cast(dtype).alias(c))
        else:
            out.append((col(c) if c in lossy else col(c).cast(dtype)).alias(c))
    return df.select(*out)


def _integer_width(low: int, high: int) -> str:
    for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
        if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1):
            return name
    return "bigint"


def optimize_types(df: DataFrame, category_threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Smallest safe integer and float widths; low-cardinality strings flagged for dictionary coding.

    Returns the narrowed table and a report (column, from_type, to_type, dictionary).
    """
    integers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    texts = string_columns(df)
    aggs = [F.count("*").alias("rows")]
    aggs += [f(col(c)) for c in integers for f in (F.min, F.max)]
    aggs += [F.max((~col(c).cast("float").cast("double").eqNullSafe(col(c))).cast("int")) for c in floats]
    row = list(one_row(df, *aggs))
    rows, row = row[0], row[1:]
    target: dict[str, str] = {}
    for i, c in enumerate(integers):
        low, high = row[2 * i], row[2 * i + 1]
        target[c] = df.schema[c].dataType.simpleString() if low is None else _integer_width(low, high)
    for i, c in enumerate(floats):
        target[c] = "double" if row[2 * len(integers) + i] == 1 else "float"
    # A bounded-memory distinct count decides; near the threshold it is settled exactly.
    share: dict[str, float] = {}
    if texts and rows:
        rough = one_row(df, *[F.approx_count_distinct(col(c), 0.02) for c in texts])
        share = {c: v / rows for c, v in zip(texts, rough)}
        close = [c for c in texts if abs(share[c] - category_threshold) < 0.15 * category_threshold + 0.02]
        for c in close:
            share[c] = df.select(col(c)).where(col(c).isNotNull()).distinct().count() / rows
    report = [
        (f.name, f.dataType.simpleString(), target.get(f.name, f.dataType.simpleString()), f.name in share and share[f.name] < category_threshold)
        for f in df.schema.fields
    ]
    narrowed = replace_columns(df, {c: col(c).cast(t) for c, t in target.items()})
    return narrowed, describe_rows(df.sparkSession, report, "column string, from_type string, to_type string, dictionary boolean")


def conditional_uplift(df: DataFrame, amount: str, status: str, out: str = "taxed", value: str = "taxable", factor: float = 1.18) -> DataFrame:
    return df.withColumn(out, F.when(col(status) == value, col(amount) * factor).otherwise(col(amount)))


def finite(c: Column) -> Column:
    """Missing instead of NaN or infinity."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def clear_infinite(df: DataFrame, columns: Sequence[str] | None = None, then: str = "null") -> DataFrame:
    """±inf and NaN become missing; then stay ("null"), become 0 ("zero") or drop the row ("drop")."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    doubles = [c for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    out = replace_columns(df, {c: finite(col(c)) for c in doubles})
    if then == "zero":
        return out.fillna(0, subset=cols)
    if then == "drop":
        return out.dropna(subset=cols)
    return out


def has_required(fields: Sequence[str], df: DataFrame) -> Column:
    """True when every field exists, is present and is not an empty string."""
    flag = F.lit(True)
    for f in fields:
        flag = flag & (F.lit(False) if f not in df.columns else F.coalesce(col(f).cast("string") != "", F.lit(False)))
    return flag


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def _constant(c: str) -> Column:
    """Distinct values including missing ≤ 1, without counting distinct values."""
    return (F.min(col(c)).eqNullSafe(F.max(col(c)))) & ((F.count(col(c)) == 0) | (F.count(col(c)) == F.count("*")))


def constant_columns(df: DataFrame) -> list[str]:
    row = one_row(df, *[_constant(c) for c in df.columns])
    return [c for c, flag in zip(df.columns, row) if flag]


def drop_constant(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = constant_columns(df)
    report = describe_rows(df.sparkSession, [(c,) for c in gone], "column string")
    return df.drop(*gone), report


def drop_leakage(df: DataFrame, explicit: Sequence[str] = (), year_prefix: str | None = None, last_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop columns that give the target away: named ones, those starting with the target
    year, and year columns after the cut-off. Returns the table and a report."""
    reasons: dict[str, str] = {}
    for c in df.columns:
        year = re.search(r"(19|20)\d{2}", c)
        if c in explicit:
            reasons[c] = "listed"
        elif year_prefix and c.startswith(year_prefix):
            reasons[c] = "target year"
        elif last_year is not None and year and int(year.group()) > last_year:
            reasons[c] = "after cut-off"
    report = describe_rows(df.sparkSession, list(reasons.items()), "column string, reason string")
    return df.drop(*reasons), report


def align_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly the expected features in order; absent ones are 0."""
    return df.select(*[col(n) if n in df.columns else F.lit(0).alias(n) for n in names])


def column_roles(df: DataFrame, low: int = 2, high: int = 50) -> DataFrame:
    """One row per column: storage type, distinct values, missing values and role.

    Distinct values are counted a column at a time: in one aggregate every row would be repeated for every column.
    """
    year = re.compile(r"(19|20)\d{2}")
    times = set(time_columns(df))
    stats = per_column(
        df,
        df.columns,
        {
            "dtype": lambda c: F.any_value(F.lit(df.schema[c].dataType.simpleString())),
            "kind": lambda c: F.any_value(F.lit("datetime" if c in times else "year" if year.search(c) else "numeric" if is_numeric(df.schema[c].dataType) else "text")),
            "rows": lambda c: F.count("*"),
            "missing": lambda c: F.count_if(col(c).isNull()),
        },
    ).join(distinct_counts(df), "column")
    idlike = (F.col("distinct") == F.col("rows")) & F.col("column").rlike("(?i)(^|_)(id|key|[a-z]*key)$")
    role = (
        F.when(F.col("kind").isin("datetime", "year"), F.col("kind"))
        .when(idlike, "id")
        .when(F.col("distinct").between(low, high), F.when(F.col("kind") == "numeric", "numeric_low_cardinality").otherwise("categorical"))
        .otherwise(F.col("kind"))
    )
    return stats.select("column", "dtype", "distinct", "missing", role.alias("role"))


def infer_datetime_columns(df: DataFrame, sample_size: int = 100, threshold: float = 0.9) -> DataFrame:
    """Text columns whose sampled values parse as times: (column, sampled, parsed, is_datetime).

    The sample is the same on every run: the values with the smallest hashes.
    """
    out = None
    for c in string_columns(df):
        values = df.select(col(c).alias("v")).where("v is not null")
        sample = values.orderBy(F.xxhash64("v"), "v").limit(sample_size)
        row = sample.agg(F.lit(c).alias("column"), F.count("v").alias("sampled"), F.count(F.try_to_timestamp("v")).alias("parsed"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        return describe_rows(df.sparkSession, [], "column string, sampled bigint, parsed bigint, is_datetime boolean")
    return out.withColumn("is_datetime", (F.col("sampled") >= 3) & (F.try_divide("parsed", "sampled") >= threshold))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def signed_log_inverse(c: Column) -> Column:
    return F.signum(c) * F.expm1(F.abs(c))


def row_completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing and available counts per row over a pinned column set, and the missing percent."""
    cols = list(columns) if columns is not None else df.columns
    missing = sum((col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.withColumns({
        "missing_values": missing,
        "available_values": F.lit(len(cols)) - missing,
        "missing_percent": missing / F.lit(len(cols)) * 100,
    })


def filter_key(df: DataFrame, column: str, value: str) -> DataFrame:
    """Case- and padding-insensitive equality on one key."""
    return df.where(F.lower(F.trim(col(column))) == value.strip().lower())


def assemble_text(df: DataFrame, columns: Sequence[str], out: str = "text_all") -> DataFrame:
    """Join text columns with blanks and drop rows without any text."""
    joined = squeeze(F.concat_ws(" ", *[col(c) for c in columns]))
    return df.withColumn(out, joined).where(F.length(out) > 0)
