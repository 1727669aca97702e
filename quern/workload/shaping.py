"""Shape, quality and validation queries."""

from pyspark.sql import functions as F

from quern.core import read_table as table
from quern.core import string_columns
from quern.operators import quality, shape, validate
from quern.workload.registry import query

# A customer table with the flaws the cleaning operators exist for, derived from whole tables.
MESSY = """
  select c_custkey,
         case when c_custkey % 11 = 0 then 'nan' when c_custkey % 13 = 0 then '  ' else '  ' || replace(c_name, '#', '  ') || ' ' end as " Customer Name! ",
         case when c_custkey % 7 = 0 then null when c_custkey % 17 = 0 then 'bad_value' else cast(c_acctbal as varchar) end as "Acct Bal",
         c_mktsegment as "Segment"
  from customer
"""


def messy_customers(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    name = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("  ")), F.lit(" "))
    return c.select(
        "c_custkey",
        F.when(key % 11 == 0, "nan").when(key % 13 == 0, "  ").otherwise(name).alias(" Customer Name! "),
        F.when(key % 7 == 0, None).when(key % 17 == 0, "bad_value").otherwise(F.col("c_acctbal").cast("string")).alias("Acct Bal"),
        F.col("c_mktsegment").alias("Segment"),
    )


def gappy_orders(spark, d):
    """Orders with holes in the price, the priority and the status."""
    return table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"),
    )


GAPPY = """
  select o_orderkey, o_custkey,
         case when o_orderkey % 5 <> 0 then o_totalprice end as price,
         case when o_orderkey % 3 <> 0 then o_orderpriority end as priority,
         case when o_orderkey % 4 <> 0 then o_orderstatus end as status
  from orders
"""


@query("p01_standard_names", f'select c_custkey, " Customer Name! " as customer_name, "Acct Bal" as acct_bal, "Segment" as segment from ({MESSY})')
def p01(spark, d):
    return shape.standardize_columns(messy_customers(spark, d))


CLEAN_NAME = """case when regexp_replace(trim(" Customer Name! "), '\\s+', ' ', 'g') in ('nan', 'None', '') then null
                else regexp_replace(trim(" Customer Name! "), '\\s+', ' ', 'g') end"""


@query("p02_standard_text", f'select c_custkey, {CLEAN_NAME} as customer_name, "Acct Bal" as acct_bal, "Segment" as segment from ({MESSY})')
def p02(spark, d):
    return shape.standardize_text(shape.standardize_columns(messy_customers(spark, d)))


@query("p03_coerce_numeric", f'select c_custkey, try_cast("Acct Bal" as double) as acct_bal from ({MESSY})')
def p03(spark, d):
    df = shape.standardize_columns(messy_customers(spark, d)).select("c_custkey", "acct_bal")
    return shape.coerce_numeric(df, ["acct_bal"])


@query("p03_lost_values", f"""select 'acct_bal' as "column", count(*) as lost from ({MESSY}) where "Acct Bal" is not null and try_cast("Acct Bal" as double) is null""")
def p03_lost(spark, d):
    return shape.coercion_losses(shape.standardize_columns(messy_customers(spark, d)), ["acct_bal"])


@query("p04_messy_numbers", "select s_suppkey, s_acctbal as balance, s_acctbal as percent from supplier")
def p04(spark, d):
    bal = F.col("s_acctbal")
    df = table(spark, d, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("₹ "), F.format_number(bal, 2)).alias("balance"),
        F.concat(F.format_number(bal, 2), F.lit(" %")).alias("percent"),
    )
    return shape.coerce_numeric(df, ["balance", "percent"], messy=True)


@query("p05_enforce_schema", """select cast(o_orderkey as varchar) as o_orderkey, cast(o_totalprice as integer) as o_totalprice,
          o_orderpriority, cast(null as double) as discount from (select * replace (floor(o_totalprice) as o_totalprice) from orders)""")
def p05(spark, d):
    df = table(spark, d, "orders").withColumn("o_totalprice", F.floor("o_totalprice"))
    return shape.enforce_schema(df, {"o_orderkey": "string", "o_totalprice": "int", "o_orderpriority": "int", "discount": "double"})


@query("p06_tighten_types", """
  select * from (values ('p_partkey', 'bigint', (select case when max(p_partkey) < 128 then 'tinyint' when max(p_partkey) < 32768 then 'smallint' else 'int' end from part), false),
    ('p_name', 'string', 'string', (select count(distinct p_name) / count(*) < 0.5 from part)),
    ('p_brand', 'string', 'string', (select count(distinct p_brand) / count(*) < 0.5 from part)),
    ('p_type', 'string', 'string', (select count(distinct p_type) / count(*) < 0.5 from part)),
    ('p_size', 'int', 'tinyint', false),
    ('p_retailprice', 'double', (select case when bool_and(cast(cast(p_retailprice as float) as double) = p_retailprice) then 'float' else 'double' end from part), false))
  as t("column", from_type, to_type, dictionary)""")
def p06(spark, d):
    return shape.optimize_types(table(spark, d, "part"))[1]


@query("p06_tightened_rows", "select * from part")
def p06_rows(spark, d):
    return shape.optimize_types(table(spark, d, "part"))[0]


@query("p07_conditional_uplift", "select l_orderkey, l_linenumber, round(case when l_returnflag = 'R' then l_extendedprice * 1.18::double else l_extendedprice end, 4) as taxed from lineitem")
def p07(spark, d):
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return shape.conditional_uplift(df, "l_extendedprice", "l_returnflag", value="R").select("l_orderkey", "l_linenumber", F.round("taxed", 4).alias("taxed"))


@query("p08_clear_infinite", "select event_id, case when event_id % 9 in (0, 1, 2) then 0 else value end as value from events")
def p08(spark, d):
    key = F.col("event_id") % 9
    value = F.when(key == 0, float("inf")).when(key == 1, float("-inf")).when(key == 2, float("nan")).otherwise(F.col("value"))
    df = table(spark, d, "events").select("event_id", value.alias("value"))
    return shape.clear_infinite(df, ["value"], then="zero")


@query("p09_required_fields", "select conv_id, turn, coalesce(role <> '', false) and coalesce(text <> '', false) as complete from conversations")
def p09(spark, d):
    df = table(spark, d, "conversations")
    return df.select("conv_id", "turn", shape.has_required(["role", "text"], df).alias("complete"))


@query("p10_required_columns", "select o_orderkey, o_totalprice from orders")
def p10(spark, d):
    return shape.require_columns(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("p11_drop_missing", f"select * from ({GAPPY}) where price is not null and status is not null")
def p11(spark, d):
    return shape.drop_missing(gappy_orders(spark, d), ["price", "status"])


@query("p12_drop_constant", "select s_suppkey, s_nationkey from supplier")
def p12(spark, d):
    df = table(spark, d, "supplier", "s_suppkey", "s_nationkey").withColumns({"kind": F.lit("supplier"), "gap": F.lit(None).cast("double")})
    return shape.drop_constant(df)[0]


YEARLY = """
  select o_custkey, {cells} from orders group by o_custkey
""".format(cells=", ".join(f"round(sum(case when year(o_orderdate) = {y} then o_totalprice end), 4) as y{y}" for y in range(1995, 2002)))


def yearly_orders(spark, d):
    """Order value per customer and year, wide: one column per year, missing where none."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    year = F.year("o_orderdate")
    return o.groupBy("o_custkey").agg(*[F.round(F.sum(F.when(year == y, F.col("o_totalprice"))), 4).alias(f"y{y}") for y in range(1995, 2002)])


@query("p13_drop_leakage", f"select o_custkey, y1995, y1996, y1997, y1998 from ({YEARLY})")
def p13(spark, d):
    return shape.drop_leakage(yearly_orders(spark, d), explicit=["y1999"], year_prefix="y2001", last_year=1999)[0]


@query("p14_align_features", "select l_quantity, 0 as missing_feature, l_tax from lineitem")
def p14(spark, d):
    return shape.align_features(table(spark, d, "lineitem"), ["l_quantity", "missing_feature", "l_tax"])


@query("p15_column_roles", """
  select 'c_custkey' as "column", 'bigint' as dtype, count(distinct c_custkey) as "distinct", 0 as missing, 'id' as role from customer
  union all select 'c_name', 'string', count(distinct c_name), 0, 'text' from customer
  union all select 'c_nationkey', 'int', count(distinct c_nationkey), 0, 'numeric_low_cardinality' from customer
  union all select 'c_acctbal', 'double', count(distinct c_acctbal), 0, 'numeric' from customer
  union all select 'c_mktsegment', 'string', count(distinct c_mktsegment), 0, 'categorical' from customer""")
def p15(spark, d):
    return shape.column_roles(table(spark, d, "customer"))


@query("p16_infer_datetime", """select 'day' as "column", 100 as sampled, 100 as parsed, true as is_datetime
    union all select 'o_orderpriority', 100, 0, false""")
def p16(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return shape.infer_datetime_columns(o)


@query("p17_signed_log", """select c_custkey, round(sign(c_acctbal - 2000) * ln(1 + abs(c_acctbal - 2000)), 6) + 0 as signed_log,
          round(c_acctbal - 2000, 4) + 0 as back from customer""")
def p17(spark, d):
    v = F.col("c_acctbal") - 2000
    log = shape.signed_log(v)
    return table(spark, d, "customer").select("c_custkey", F.round(log, 6).alias("signed_log"), F.round(shape.signed_log_inverse(log), 4).alias("back"))


@query("p18_row_completeness", f"""select o_orderkey, m as missing_values, 3 - m as available_values, round(m / 3 * 100, 4) as missing_percent
  from (select o_orderkey, (price is null)::int + (priority is null)::int + (status is null)::int as m from ({GAPPY}))""")
def p18(spark, d):
    df = shape.row_completeness(gappy_orders(spark, d), ["price", "priority", "status"])
    return df.select("o_orderkey", "missing_values", "available_values", F.round("missing_percent", 4).alias("missing_percent"))


@query("p20_filter_key", "select * from customer where lower(trim(c_mktsegment)) = 'building'")
def p20(spark, d):
    return shape.filter_key(table(spark, d, "customer"), "c_mktsegment", " Building ")


@query("p21_assemble_text", "select p_partkey, p_name || ' ' || p_brand || ' ' || p_type as text_all from part")
def p21(spark, d):
    return shape.assemble_text(table(spark, d, "part"), ["p_name", "p_brand", "p_type"]).select("p_partkey", "text_all")


@query("d01_drop_exact", "select distinct lang, source, text from documents")
def d01_all(spark, d):
    return quality.remove_duplicates(table(spark, d, "documents", "lang", "source", "text"))


@query("d01_keep_first", """select o_custkey, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderstatus
         order by o_orderdate, o_orderkey) as rn from orders) where rn = 1""")
def d01_first(spark, d):
    df = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return quality.remove_duplicates(df, ["o_custkey", "o_orderstatus"], "first", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("d01_keep_last", """select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type
         order by ts desc, event_id desc) as rn from events) where rn = 1""")
def d01_last(spark, d):
    df = table(spark, d, "events", "user_id", "event_type", "ts", "event_id")
    return quality.remove_duplicates(df, ["user_id", "event_type"], "last", ["ts", "event_id"]).drop("ts")


@query("d01_keep_none", "select doc_id from documents where text in (select text from documents group by text having count(*) = 1)")
def d01_none(spark, d):
    return quality.remove_duplicates(table(spark, d, "documents", "doc_id", "text"), ["text"], "none").select("doc_id")


@query("d02_duplicate_rows", "select count(*) as total_rows, count(distinct text) as distinct_rows, count(*) - count(distinct text) as duplicate_rows from documents")
def d02(spark, d):
    return quality.duplicate_counts(table(spark, d, "documents", "text"))


MODES = {s: f"(select {s} from ({GAPPY}) where {s} is not null group by 1 order by count(*) desc, 1 limit 1)" for s in ("priority", "status")}


@query("m01_median_with_mode", f"""select o_orderkey, o_custkey, coalesce(price, (select median(price) from ({GAPPY}))) as price,
    coalesce(priority, {MODES['priority']}) as priority, coalesce(status, {MODES['status']}) as status from ({GAPPY})""")
def m01(spark, d):
    return quality.impute(gappy_orders(spark, d), "median")


@query("m01_constant", f"select o_orderkey, o_custkey, price, coalesce(priority, 'none') as priority, coalesce(status, 'none') as status from ({GAPPY})")
def m01_constant(spark, d):
    return quality.impute(gappy_orders(spark, d), "constant", fill_value="none")


@query("m02_mean_numeric", f"select o_orderkey, o_custkey, round(coalesce(price, (select avg(price) from ({GAPPY}))), 6) as price, priority, status from ({GAPPY})")
def m02(spark, d):
    return quality.impute_numeric(gappy_orders(spark, d), "mean").withColumn("price", F.round("price", 6))


def along_sql(fn, frame):
    return f"select o_orderkey, o_custkey, {fn}(price ignore nulls) over (partition by o_custkey order by o_orderkey {frame}) as price from ({GAPPY})"


@query("m03_forward_fill", along_sql("last_value", "rows between unbounded preceding and current row"))
def m03(spark, d):
    return quality.fill_along(gappy_orders(spark, d), ["o_custkey"], ["o_orderkey"], ["price"], "ffill").select("o_orderkey", "o_custkey", "price")


@query("m03_backward_fill", along_sql("first_value", "rows between current row and unbounded following"))
def m03_back(spark, d):
    return quality.fill_along(gappy_orders(spark, d), ["o_custkey"], ["o_orderkey"], ["price"], "bfill").select("o_orderkey", "o_custkey", "price")


@query("m04_mode_all", f"""select o_orderkey, coalesce(price, (select price from ({GAPPY}) where price is not null group by 1 order by count(*) desc, 1 limit 1)) as price,
    coalesce(priority, {MODES['priority']}) as priority, coalesce(status, {MODES['status']}) as status from ({GAPPY})""")
def m04(spark, d):
    return quality.impute(gappy_orders(spark, d), "mode", fallback=False).drop("o_custkey")


TRAIN = f"(select * from ({GAPPY}) where o_orderkey < (select max(o_orderkey) * 0.8 from orders))"


@query("m05_fit_on_train", f"""select o_orderkey, coalesce(price, (select median(price) from {TRAIN})) as price,
    coalesce(priority, (select priority from {TRAIN} where priority is not null group by 1 order by count(*) desc, 1 limit 1)) as priority
    from ({GAPPY}) where not o_orderkey < (select max(o_orderkey) * 0.8 from orders)""")
def m05(spark, d):
    df = gappy_orders(spark, d)
    edge = df.agg(F.max("o_orderkey")).collect()[0][0] * 0.8
    values = quality.fit_impute(df.where(F.col("o_orderkey") < edge), ["price"], ["priority"])
    return quality.apply_fill(df.where(F.col("o_orderkey") >= edge), values).select("o_orderkey", "price", "priority")


@query("m06_missing_report", " union all ".join(
    f"""select '{c}' as "column", count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0 / count(*), 4) as missing_percent,
    round((count(*) - count({c})) * 100.0 / (count(*) * 5), 4) as cell_percent from ({GAPPY})""" for c in ("o_orderkey", "o_custkey", "price", "priority", "status")))
def m06(spark, d):
    df = quality.missing_report(gappy_orders(spark, d))
    return df.withColumns({c: F.round(c, 4) for c in ("missing_percent", "cell_percent")})


RULES = validate.RuleSet([
    validate.Rule("price", "double", min_value=10000, max_value=400000),
    validate.Rule("priority", "string", allow_null=True, allowed_values=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]),
    validate.Rule("status", "string", custom_check=lambda c: c != "P"),
])
RULE_SQL = f"""
  select o_orderkey, coalesce(
      case when price is null then 'Column ''price'' is null' end,
      case when price < 10000 then 'Column ''price'' value ' || price::decimal(18,2) || ' below minimum 10000' end,
      case when price > 400000 then 'Column ''price'' value ' || price::decimal(18,2) || ' above maximum 400000' end,
      case when priority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') then 'Column ''priority'' value ' || priority || ' not in allowed set' end,
      case when status is null then 'Column ''status'' is null' end,
      case when status = 'P' then 'Column ''status'' failed custom check for value P' end) as error,
    price, priority, status from (select o_orderkey, price, priority, status from ({GAPPY}))"""


def ruled_orders(spark, d):
    return gappy_orders(spark, d).drop("o_custkey").withColumn("price", F.col("price").cast("decimal(18,2)"))


@query("v01_row_errors", f"select o_orderkey, error from ({RULE_SQL})")
def v01(spark, d):
    return validate.check_rows(ruled_orders(spark, d), RULES).select("o_orderkey", "error")


@query("v02_validation_report", f"""with r as ({RULE_SQL}) select 'total_rows' as measure, count(*) as value from r union all select 'valid_rows', count(*) - count(error) from r
    union all select 'row_errors', count(error) from r union all select 'missing_price', count(*) - count(price) from r
    union all select 'missing_priority', count(*) - count(priority) from r union all select 'missing_status', count(*) - count(status) from r
    union all select 'duplicate_rows', 0 union all select 'schema_errors', 0 union all select 'is_valid', 0""")
def v02(spark, d):
    return validate.validation_report(ruled_orders(spark, d), RULES)


@query("v03_clean", f"with r as ({RULE_SQL}) select distinct price, priority, status from r where error is null")
def v03(spark, d):
    return validate.clean(ruled_orders(spark, d).drop("o_orderkey"), RULES)


@query("v04_quarantine", f"select o_orderkey as row_id, 'DataValidationError' as error_type, error as message from ({RULE_SQL}) where error is not null")
def v04(spark, d):
    return validate.quarantine(ruled_orders(spark, d), RULES, "o_orderkey")


@query("v04_error_summary", f"""with e as (select * from ({RULE_SQL}) where error is not null)
    (select o_orderkey as row_id, '[DataValidationError] ' || error as line from e order by o_orderkey limit 20)
    union all select null, (count(*) - 20) || ' more error(s) not shown' from e having count(*) > 20""")
def v04_summary(spark, d):
    return validate.error_summary(validate.quarantine(ruled_orders(spark, d), RULES, "o_orderkey"))


APPLICANTS = """
  select o_orderkey, 18 + o_custkey % 60 - case when o_orderkey % 50 = 0 then 100 else 0 end as age, o_totalprice / 4 as income,
         250 + o_orderkey % 650 as credit_score, o_totalprice / 10 as loan_amount, (o_orderkey % 30)::double as years_employed,
         case when o_orderkey % 40 = 0 then ' ' else 'bachelor' end as education, o_orderstatus as employment_status, 'single' as marital_status,
         'rent' as housing_type, strftime(o_orderdate, '%Y-%m-%d') as application_date,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as target
  from orders"""


def applicants(spark, d):
    """Applicant records derived one per order."""
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.lit(18) + cust % 60 - F.when(key % 50 == 0, 100).otherwise(0)).alias("age"),
        (price / 4).alias("income"),
        (F.lit(250) + key % 650).alias("credit_score"),
        (price / 10).alias("loan_amount"),
        (key % 30).cast("double").alias("years_employed"),
        F.when(key % 40 == 0, " ").otherwise("bachelor").alias("education"),
        F.col("o_orderstatus").alias("employment_status"),
        F.lit("single").alias("marital_status"),
        F.lit("rent").alias("housing_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("application_date"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("target"),
    )


@query("v05_applicant_contract", f"""select count(*) as applicants, count(*) filter (age > 0 and income >= 0 and credit_score between 300 and 850 and loan_amount >= 0
    and years_employed >= 0 and trim(education) <> '') as accepted from ({APPLICANTS})""")
def v05(spark, d):
    df = validate.check_rows(applicants(spark, d), validate.applicant_rules())
    return df.agg(F.count("*").alias("applicants"), F.count_if(F.col("error").isNull()).alias("accepted"))


@query("v06_readiness", """select count(*) as rows, 10 as features, 0 as infinite_cells, count(distinct l_returnflag) as classes,
    round((select min(n) from (select count(*) n from lineitem group by l_returnflag)) * 100.0 / count(*), 6) as smallest_class_percent, count(*) >= 10 as ready from lineitem""")
def v06(spark, d):
    df = validate.readiness(table(spark, d, "lineitem"), "l_returnflag")
    return df.withColumn("smallest_class_percent", F.round("smallest_class_percent", 6))


@query("v07_fingerprint", "select p_partkey, md5(p_partkey || '||' || p_name || '||' || p_brand || '||' || p_size) as row_hash from part")
def v07(spark, d):
    df = table(spark, d, "part")
    return df.select("p_partkey", validate.fingerprint(df, ["p_partkey", "p_name", "p_brand", "p_size"]).alias("row_hash"))


@query("v07_collisions", "select md5(text) as row_hash, count(*) as copies from documents group by 1 having count(*) > 1")
def v07_collisions(spark, d):
    return validate.fingerprint_collisions(table(spark, d, "documents"), ["text"])


@query("v08_split_overlap", """
  with s as (select text, case when source < 'src15' then 'train' when source < 'src2' then 'validation' else 'test' end as split from documents),
       t as (select text, max((split = 'train')::int) as train, max((split = 'validation')::int) as validation, max((split = 'test')::int) as test from s group by text)
  select 'train' as "left", 'validation' as "right", sum(train * validation)::bigint as overlap, true as same_columns from t
  union all select 'train', 'test', sum(train * test)::bigint, true from t
  union all select 'validation', 'test', sum(validation * test)::bigint, true from t""")
def v08(spark, d):
    df = table(spark, d, "documents", "source", "text")
    parts = {"train": "source < 'src15'", "validation": "source >= 'src15' and source < 'src2'", "test": "source >= 'src2'"}
    return validate.split_overlaps({n: df.where(test) for n, test in parts.items()}, ["text"])
