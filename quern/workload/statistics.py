"""Aggregation, window, wide-series, top-k, set and lookup queries."""

from pyspark.sql import functions as F

from quern.core import describe_rows
from quern.core import read_table as table
from quern.functions import lists
from quern.operators import aggs, evaluate, ordered, sets, validate, wide, windows
from quern.workload.registry import query
from quern.workload.shaping import GAPPY, YEARLY, gappy_orders, yearly_orders


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("a01_group_mean_sum_count", """select l_returnflag, round(avg(l_extendedprice), 6) as mean, round(sum(l_extendedprice), 2) as total, count(*) as rows
    from lineitem group by 1""")
def a01(spark, d):
    df = aggs.group_stats(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return rounded(rounded(df, "mean"), "total", digits=2).orderBy("l_returnflag")


@query("a02_value_counts", "select event_type as value, count(*) as rows, round(count(*) / (select count(*) from events), 6) as share from events group by 1")
def a02(spark, d):
    return rounded(aggs.value_counts(table(spark, d, "events"), "event_type"), "share")


@query("a02_value_counts_with_missing", f"select priority as value, count(*) as rows, round(count(*) / (select count(*) from orders), 6) as share from ({GAPPY}) group by 1")
def a02_missing(spark, d):
    return rounded(aggs.value_counts(gappy_orders(spark, d), "priority", keep_missing=True), "share")


@query("a03_distinct_counts", " union all ".join(f"""select '{c}' as "column", count(distinct {c}) as "distinct" from lineitem""" for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")))
def a03(spark, d):
    return aggs.distinct_counts(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_quantity"])


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def describe_sql(c, source="lineitem", digits=6):
    return f"""select '{c}' as "column", count({c}) as "count", round(avg({c}), {digits}) as mean, round(stddev_samp({c}), {digits}) as std, min({c})::double as min,
      max({c})::double as max, round(skewness({c}), {digits}) + 0 as skewness, round(quantile_cont({c}, 0.25), {digits}) as q25,
      round(quantile_cont({c}, 0.5), {digits}) as q50, round(quantile_cont({c}, 0.75), {digits}) as q75 from {source}"""


@query("a04_describe_numbers", " union all ".join(describe_sql(c) for c in NUM))
def a04(spark, d):
    return rounded(aggs.describe_numbers(table(spark, d, "lineitem"), NUM), "mean", "std", "skewness", "q25", "q50", "q75")


@query("a04_describe_texts", " union all ".join(f"""select '{c}' as "column", count({c}) as "count", count(distinct {c}) as "unique",
    (select {c} from orders group by 1 order by count(*) desc, 1 limit 1) as top, (select count(*) from orders group by {c} order by 1 desc limit 1) as freq from orders""" for c in ("o_orderstatus", "o_orderpriority")))
def a04_texts(spark, d):
    return aggs.describe_texts(table(spark, d, "orders"))


TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}


@query("a05_quick_profile", " union all ".join(f"""select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing, '{t}' as dtype from part""" for c, t in TYPES.items()))
def a05(spark, d):
    return aggs.quick_profile(table(spark, d, "part"))


def profile_sql(c, numeric):
    stats = [f"round({e}, 4)" for e in (f"avg({c})", f"stddev_samp({c})", f"min({c})::double", f"max({c})::double", f"skewness({c})", *[f"quantile_cont({c}, {q})" for q in (0.25, 0.5, 0.75)])]
    names = ("mean", "std", "min", "max", "skewness", "q25", "q50", "q75")
    cells = ", ".join(f"{s if numeric else 'null'} as {n}" for s, n in zip(stats, names))
    return f"""select '{c}' as "column", count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0 / count(*), 2) as missing_percent, count(distinct {c}) as "distinct", {cells} from ({GAPPY})"""


@query("a06_full_profile", " union all ".join(profile_sql(c, c in ("o_orderkey", "o_custkey", "price")) for c in ("o_orderkey", "o_custkey", "price", "priority", "status")))
def a06(spark, d):
    return aggs.full_profile(gappy_orders(spark, d))


@query("a06_top_values", " union all ".join(f"""select * from (select '{c}' as "column", {c} as value, count(*) as rows, row_number() over (order by count(*) desc, {c}) as rank
    from part group by {c}) where rank <= 5""" for c in ("p_name", "p_brand", "p_type")))
def a06_top(spark, d):
    return aggs.top_values(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query("a06_warnings", """select 'c_name' as "column", 'high cardinality' as warning, count(distinct c_name)::double as amount from customer having count(distinct c_name) > 50""")
def a06_warnings(spark, d):
    return aggs.profile_warnings(table(spark, d, "customer"))


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


@query("a07_correlations", " union all ".join(f"select '{a}' as \"left\", '{b}' as \"right\", round(corr({a}, {b}), 6) + 0 as r from lineitem" for a, b in PAIRS))
def a07(spark, d):
    return rounded(aggs.correlations(table(spark, d, "lineitem"), NUM), "r")


GAPS = [f"case when l_linenumber <> {i} then {c} end" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity * l_tax", "0.5::double"))]


@query("a07_wide_correlations", "with g as (select " + ", ".join(f"{e} as c{i}" for i, e in enumerate(GAPS)) + " from lineitem) " + " union all ".join(
    f"select 'c{i}' as \"left\", 'c{j}' as \"right\", {'max(null::double)' if j == 9 else f'round(corr(c{i}, c{j}), 6) + 0'} as r from g" for i in range(10) for j in range(i + 1, 10)))
def a07_wide(spark, d):
    values = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")]
    values += [F.col("l_quantity") * F.col("l_tax"), F.lit(0.5)]
    gaps = table(spark, d, "lineitem").select(*[F.when(F.col("l_linenumber") != i, v).alias(f"c{i}") for i, v in enumerate(values)])
    return rounded(aggs.correlations(gaps), "r")


@query("a08_target_correlations", "select * from (" + " union all ".join(f"select '{c}' as \"column\", round(abs(corr({c}, l_extendedprice)), 6) as r from lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")")
def a08(spark, d):
    return rounded(aggs.target_correlations(table(spark, d, "lineitem"), "l_extendedprice", NUM), "r")


@query("a09_histogram", """with s as (select min(o_totalprice) lo, max(o_totalprice) hi from orders), w as (select lo, (hi - lo) / 20 as width from s),
    c as (select least(floor((o_totalprice - lo) / width), 19)::int as bin, count(*) as rows from orders, w group by 1)
    select g.bin::int as bin, round(lo + g.bin * width, 4) as low, round(lo + (g.bin + 1) * width, 4) as high, coalesce(rows, 0) as rows
    from range(20) g(bin) cross join w left join c on c.bin = g.bin""")
def a09(spark, d):
    return rounded(aggs.histogram(table(spark, d, "orders"), "o_totalprice"), "low", "high", digits=4)


@query("a10_box_stats", """with q as (select p_type, quantile_cont(p_retailprice, 0.25) q1, quantile_cont(p_retailprice, 0.5) m, quantile_cont(p_retailprice, 0.75) q3 from part group by 1)
    select p_type, round(any_value(q1), 6) as q1, round(any_value(m), 6) as median, round(any_value(q3), 6) as q3,
      min(p_retailprice) filter (p_retailprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_low,
      max(p_retailprice) filter (p_retailprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_high,
      count(*) filter (not p_retailprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers
    from part join q using (p_type) group by p_type""")
def a10(spark, d):
    return rounded(aggs.box_stats(table(spark, d, "part"), "p_type", "p_retailprice"), "q1", "median", "q3")


@query("a11_pivot", """select user_id, max(n) filter (event_type = 'click') as click, max(n) filter (event_type = 'error') as error, max(n) filter (event_type = 'purchase') as purchase,
    max(n) filter (event_type = 'signup') as signup, max(n) filter (event_type = 'view') as "view" from (select user_id, event_type, count(*) n from events group by 1, 2) group by 1""")
def a11(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return aggs.pivot_wide(counts, "user_id", "event_type", "n")


@query("a11_pivot_long", "select l_suppkey, l_partkey, sum(l_quantity) as quantity from lineitem group by 1, 2")
def a11_long(spark, d):
    """Every part is a level: far more than columns could hold."""
    cells = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").alias("quantity"))
    return aggs.pivot_long(cells, "l_suppkey", "l_partkey", "quantity", F.sum)


@query("a12_category_shares", """select c_mktsegment, round(avg(c_acctbal), 6) as mean, round(sum(c_acctbal) * 100 / (select sum(c_acctbal) from customer), 6) as percent from customer group by 1""")
def a12(spark, d):
    return rounded(aggs.category_shares(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), "mean", "percent")


@query("a13_metric_summary", "select event_type, round(avg(value), 6) as mean, round(min(value), 6) as min, round(max(value), 6) as max, round(stddev_pop(value), 6) as std from events group by 1")
def a13(spark, d):
    return aggs.summarize(table(spark, d, "events"), "value", ["event_type"])


@query("a14_confidence_interval", """select event_type, round(avg(value), 6) as mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) as lower,
    round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) as upper from events group by 1""")
def a14(spark, d):
    return rounded(aggs.confidence_interval(table(spark, d, "events"), ["event_type"], "value"), "mean", "lower", "upper")


@query("a15_consolidate", f"""select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey, arg_min(price, o_orderkey) filter (price is not null) as price,
    arg_min(status, o_orderkey) filter (status is not null) as status, string_agg(distinct priority, '; ' order by priority) as sources from ({GAPPY}) group by 1""")
def a15(spark, d):
    df = gappy_orders(spark, d)
    out = aggs.consolidate(df, ["o_custkey"], "o_orderkey", ["o_orderkey"], ["price", "status"], "priority")
    return out.withColumn("sources", F.when(F.col("sources") != "", F.col("sources")))


@query("a15_source_rows", "select l_suppkey, l_partkey, row_number() over (partition by l_suppkey order by l_partkey) as position from (select distinct l_suppkey, l_partkey from lineitem)")
def a15_rows(spark, d):
    return aggs.source_rows(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


RUNS = "(select l_returnflag as task, 'supplier ' || l_suppkey as model, avg(l_extendedprice) as r2, avg(l_discount) as rmse from lineitem group by 1, 2)"


@query("a16_best_per_task", f"""select task, 'r2' as metric, arg_max(model, r2) as best, round(max(r2), 6) as value from {RUNS} group by 1
    union all select task, 'rmse', arg_min(model, rmse), round(min(rmse), 6) from {RUNS} group by 1""")
def a16(spark, d):
    runs = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("task"), F.concat(F.lit("supplier "), "l_suppkey").alias("model")).agg(
        F.avg("l_extendedprice").alias("r2"), F.avg("l_discount").alias("rmse"))
    return rounded(aggs.best_rows(runs, "task", "model", ["r2"], ["rmse"]), "value")


@query("a17_exploded_counts", """select label, count(*) as rows from (select unnest([w for w in string_split(p_name, ' ')]) as label from part where p_size <> 7) group by 1 order by 2 desc, 1 limit 10""")
def a17(spark, d):
    literal = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))
    broken = F.when(F.col("p_size") == 7, F.col("p_name")).otherwise(literal)  # texts that are no lists are skipped
    return aggs.exploded_counts(table(spark, d, "part"), lists.literal_items(broken), 10)


@query("a18_class_balance", """select quality::varchar as "class", count(*) as rows, round(count(*) / sum(count(*)) over (), 6) as share, true as can_stratify from labels group by 1""")
def a18(spark, d):
    return rounded(aggs.class_balance(table(spark, d, "labels"), "quality"), "share")


@query("a19_task_type", """select * from (values ('l_returnflag', 'classification'), ('l_linenumber', 'classification'), ('l_quantity', 'classification'),
    ('l_extendedprice', 'regression'), ('l_discount', 'regression')) t("column", task)""")
def a19(spark, d):
    df = table(spark, d, "lineitem")
    cols = ["l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    return describe_rows(spark, [(c, aggs.detect_task_type(df, c)) for c in cols], "`column` string, task string")


# A simple guess of the price from the quantity, so the error measures have two columns to compare.
GUESS = "(select l_returnflag, l_extendedprice as y, l_quantity * 1500.0::double as p from lineitem)"


def guesses(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


@query("a20_regression_metrics", f"""select l_returnflag, round(avg(abs(y - p)), 4) as mae, round(avg((y - p) * (y - p)), 2) as mse, round(sqrt(avg((y - p) * (y - p))), 4) as rmse,
    round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2 from {GUESS} group by 1""")
def a20(spark, d):
    out = evaluate.regression_metrics(guesses(spark, d), "y", "p", ["l_returnflag"])
    return rounded(rounded(rounded(out, "mae", "rmse", digits=4), "mse", digits=2), "r2")


# Text length guesses the quality label.
SCORED = "(select doc_id, quality as y, n_chars / (n_chars + 2000.0) as p, (n_chars > 1500)::int as guess from documents join labels using (doc_id))"


def scored_documents(spark, d):
    docs = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    size = F.col("n_chars")
    return docs.select("doc_id", F.col("quality").alias("y"), (size / (size + 2000.0)).alias("p"), (size > 1500).cast("int").alias("guess"))


REPORT = f"""(with m as (select y::varchar label, guess::varchar predicted, count(*) n from {SCORED} group by 1, 2),
    l as (select label c, sum(n) support, sum(n) filter (label = predicted) hits from m group by 1), g as (select predicted c, sum(n) guesses from m group by 1)
    select coalesce(l.c, g.c) as c, coalesce(support, 0) support, coalesce(hits, 0) hits, coalesce(guesses, 0) guesses from l full join g on l.c = g.c)"""


@query("a21_class_report", f"""select c as "class", round(coalesce(hits / nullif(guesses, 0), 0), 6) as precision, round(coalesce(hits / nullif(support, 0), 0), 6) as recall,
    round(2 * hits / (guesses + support), 6) as f1, support::bigint as support from {REPORT}""")
def a21(spark, d):
    return rounded(evaluate.class_report(evaluate.confusion(scored_documents(spark, d), "y", "guess")), "precision", "recall", "f1")


@query("a21_confusion", f"select y::varchar as label, guess::varchar as predicted, count(*) as rows from {SCORED} group by 1, 2")
def a21_confusion(spark, d):
    return evaluate.confusion(scored_documents(spark, d), "y", "guess")


@query("a21_weighted_metrics", f"""select round(sum(hits) / sum(support), 6) as accuracy, round(sum(coalesce(hits / nullif(guesses, 0), 0) * support) / sum(support), 6) as precision,
    round(sum(hits) / sum(support), 6) as recall, round(sum(2 * hits / (guesses + support) * support) / sum(support), 6) as f1 from {REPORT}""")
def a21_metrics(spark, d):
    return rounded(evaluate.classification_metrics(scored_documents(spark, d), "y", "guess"), "accuracy", "precision", "recall", "f1")


@query("a22_roc_auc", f"""select round(sum(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0 end) / count(*), 6) as auc
    from (select p from {SCORED} where y = 1) a cross join (select p from {SCORED} where y = 0) b""")
def a22(spark, d):
    return rounded(evaluate.roc_auc(scored_documents(spark, d), "y", "p"), "auc")


@query("a23_curve_points", f"""with t as (select p, sum(y) pos, sum(1 - y) neg from {SCORED} group by p),
    r as (select p, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as allp, sum(neg) over () as alln from t window w as (order by p desc))
    select round(p, 8) as threshold, round(tp / allp, 6) as tpr, round(fp / alln, 6) as fpr, round(tp / (tp + fp), 6) as precision, round(tp / allp, 6) as recall from r""")
def a23(spark, d):
    out = evaluate.curve_points(scored_documents(spark, d), "y", "p")
    return rounded(rounded(out, "tpr", "fpr", "precision", "recall"), "threshold", digits=8)


@query("a24_calibration", f"select least(floor(p * 10), 9)::int as bin, round(avg(p), 6) as mean_predicted, round(avg(y), 6) as fraction_positive, count(*) as rows from {SCORED} group by 1")
def a24(spark, d):
    return rounded(evaluate.calibration(scored_documents(spark, d), "y", "p"), "mean_predicted", "fraction_positive")


@query("a25_residual_histogram", f"""with r as (select y - p as v from {GUESS}), s as (select min(v) lo, max(v) hi from r), w as (select lo, (hi - lo) / 30 as width from s),
    c as (select least(floor((v - lo) / width), 29)::int as bin, count(*) as rows from r, w group by 1)
    select g.bin::int as bin, coalesce(rows, 0) as rows from range(30) g(bin) left join c on c.bin = g.bin""")
def a25(spark, d):
    return aggs.histogram(evaluate.residuals(guesses(spark, d), "y", "p"), "residual", 30).select("bin", "rows")


@query("a26_grouped_importance", """with f as (select 'p_type' as source, sum(p_retailprice) as importance from part union all select 'p_brand', sum(p_size) from part)
    select source, round(importance, 4) as importance, round(importance * 100 / sum(importance) over (), 6) as percent, row_number() over (order by importance desc, source)::int as rank from f""")
def a26(spark, d):
    part = table(spark, d, "part")
    by_type = part.groupBy(F.concat(F.lit("p_type_"), "p_type").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    by_brand = part.groupBy(F.concat(F.lit("p_brand_"), "p_brand").alias("feature")).agg(F.sum("p_size").cast("double").alias("importance"))
    out = aggs.grouped_importance(by_type.unionByName(by_brand), ["p_type", "p_brand", "p"])
    return rounded(rounded(out, "importance", digits=4), "percent")


@query("a28_text_lengths", " union all ".join(f"""select '{c}' as "column", min(length(coalesce({c}, ''))) as min_chars, max(length(coalesce({c}, ''))) as max_chars, median(length(coalesce({c}, '')))::double as median_chars from documents""" for c in ("text", "lang", "source")))
def a28(spark, d):
    return aggs.text_lengths(table(spark, d, "documents"))


@query("w01_group_broadcast", """select c_custkey, count(c_acctbal) over w as group_count, round(sum(c_acctbal) over w, 4) as group_sum, round(avg(c_acctbal) over w, 6) as group_mean,
    (select count(distinct c_mktsegment) from customer x where x.c_nationkey = c.c_nationkey) as segments, round(median(c_acctbal) over w, 6) as group_median
    from customer c window w as (partition by c_nationkey)""")
def w01(spark, d):
    c = table(spark, d, "customer")
    out = windows.group_broadcast(c, ["c_nationkey"], "c_acctbal", ["count", "sum", "mean", "median"])
    out = windows.group_broadcast(out, ["c_nationkey"], "c_mktsegment", ["nunique"], prefix="segment").withColumnRenamed("segment_nunique", "segments")
    out = rounded(rounded(out, "group_sum", digits=4), "group_mean", "group_median")
    return out.select("c_custkey", "group_count", "group_sum", "group_mean", "segments", "group_median")


@query("w02_group_share", "select s_suppkey, round(s_acctbal / nullif(sum(s_acctbal) over (partition by s_nationkey), 0) * 100, 6) as share from supplier")
def w02(spark, d):
    return rounded(windows.group_share(table(spark, d, "supplier"), ["s_nationkey"], "s_acctbal"), "share").select("s_suppkey", "share")


@query("w03_group_deviation", "select c_custkey, round(c_acctbal - median(c_acctbal) over (partition by c_mktsegment), 6) + 0 as deviation from customer")
def w03(spark, d):
    return rounded(windows.group_deviation(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "median"), "deviation").select("c_custkey", "deviation")


@query("w04_composite_count", "select event_id, count(event_id) over (partition by user_id, event_type) as pair_count from events")
def w04(spark, d):
    return windows.group_broadcast(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["count"], "pair").select("event_id", "pair_count")


@query("w05_growth_rate", """select o_orderkey, growth_percent from (select o_orderkey, row_number() over w as rn,
    round((o_totalprice - lag(o_totalprice) over w) / nullif(lag(o_totalprice) over w, 0) * 100, 6) as growth_percent
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where rn > 1""")
def w05(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(windows.growth_rate(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice"), "growth_percent").select("o_orderkey", "growth_percent")


@query("w06_time_split", """select o_orderkey, case when row_number() over (order by o_orderdate, o_orderkey) <= floor(count(*) over () * 0.8::double) then 'train' else 'test' end as split from orders""")
def w06(spark, d):
    return windows.time_split(table(spark, d, "orders", "o_orderkey", "o_orderdate"), [], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


MA = """with recursive t as (select o_custkey, list(o_totalprice order by o_orderdate, o_orderkey) as v, 0 as step, 0.0::double as forecast from orders group by 1
    union all select o_custkey, list_append(v, list_avg(v[-3:])), step + 1, list_avg(v[-3:]) from t where step < 3)
    select o_custkey, step, round(forecast, 4) as forecast from t where step > 0"""


@query("w07_moving_average_forecast", MA)
def w07(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(windows.moving_average_forecast(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 3, 3), "forecast", digits=4)


@query("w08_rank", """select c_nationkey, total, row_number() over (order by total desc, c_nationkey)::int as rank from (select c_nationkey, round(sum(c_acctbal), 2) as total from customer group by 1)""")
def w08(spark, d):
    totals = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return windows.ranked(totals, "total", "c_nationkey")


@query("w09_position_and_total", """select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as position,
    count(*) over (partition by l_orderkey) as total from lineitem""")
def w09(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = ordered.position(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return windows.group_broadcast(out, ["l_orderkey"], "l_linenumber", ["count"], "line").select("l_orderkey", "l_linenumber", "l_partkey", "position", F.col("line_count").alias("total"))


@query("w10_length_budget", """with r as (select conv_id, turn, text, sum(length(text)) over (partition by conv_id order by turn) as upto from conversations)
    select conv_id, turn, case when upto <= 800 then text else substring(text, 1, (800 - (upto - length(text)))::int) || '...' end as kept_text from r
    where upto <= 800 or (upto - length(text) <= 800 and 800 - (upto - length(text)) > 80)""")
def w10(spark, d):
    return windows.length_budget(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text", 800, 80).select("conv_id", "turn", "kept_text")


@query("w11_edge_values", """select user_id, arg_max(value, ts) as latest, arg_min(value, ts) as first,
    (list(value order by ts desc))[2] as previous from events group by 1""")
def w11(spark, d):
    return windows.edge_values(table(spark, d, "events"), ["user_id"], "ts", "value")


@query("w12_folds", """select fold, count(*) as rows from (select floor(('0x' || substring(md5(o_orderkey || '|42'), 1, 8))::bigint / 4294967296.0 * 5)::int as fold from orders) group by 1""")
def w12(spark, d):
    folds = table(spark, d, "orders").select(windows.fold_of(F.col("o_orderkey")).alias("fold"))
    return folds.groupBy("fold").agg(F.count("*").alias("rows"))


YEARS = [f"y{y}" for y in range(1995, 2002)]
MELT = f"(select o_custkey, name, substring(name, 2)::int as year, v from ({YEARLY}) unpivot include nulls (v for name in ({', '.join(YEARS)})))"


@query("y01_coverage", f"""select o_custkey, count(v) as available_years, count(*) - count(v) as missing_years, round((count(*) - count(v)) / 7 * 100, 6) as missing_percent from {MELT} group by 1""")
def y01(spark, d):
    return rounded(yearly_orders(spark, d).select("o_custkey", *[e.alias(n) for n, e in wide.coverage(YEARS).items()]), "missing_percent")


@query("y02_row_statistics", f"""select o_custkey, round(avg(v), 4) as mean, round(median(v), 4) as median, round(min(v), 4) as min, round(max(v), 4) as max,
    round(stddev_samp(v), 4) as std, round(max(v) - min(v), 4) as range from {MELT} group by 1""")
def y02(spark, d):
    stats = wide.statistics(YEARS)
    return rounded(yearly_orders(spark, d).select("o_custkey", *[e.alias(n) for n, e in stats.items()]), *stats, digits=4)


@query("y03_first_to_latest", f"""select o_custkey, y1995 as first_value, y2001 as latest_value, round(y2001 - y1995, 4) as absolute_change,
    round((y2001 - y1995) / abs(nullif(y1995, 0)) * 100, 6) as percent_change from ({YEARLY})""")
def y03(spark, d):
    out = yearly_orders(spark, d).select("o_custkey", *[e.alias(n) for n, e in wide.first_to_latest(YEARS).items()])
    return rounded(rounded(out, "absolute_change", digits=4), "percent_change")


@query("y04_latest_change", f"""select o_custkey, y2000 as previous_value, round(y2001 - y2000, 4) as latest_change, round((y2001 - y2000) / abs(nullif(y2000, 0)) * 100, 6) as latest_change_percent from ({YEARLY})""")
def y04(spark, d):
    out = yearly_orders(spark, d).select("o_custkey", *[e.alias(n) for n, e in wide.latest_change(YEARS).items()])
    return rounded(rounded(out, "latest_change", digits=4), "latest_change_percent")


@query("y05_cagr", f"select o_custkey, case when y1995 > 0 and y2001 > 0 then round((pow(y2001 / y1995, 1.0 / 6) - 1) * 100, 6) end as cagr_percent from ({YEARLY})")
def y05(spark, d):
    return yearly_orders(spark, d).select("o_custkey", F.round(wide.cagr(YEARS), 6).alias("cagr_percent"))


@query("y06_trend", f"""select o_custkey, round(b, 4) + 0 as slope, case when b > 0 then 'Increasing' when b < 0 then 'Decreasing' when b = 0 then 'Stable' else 'No Trend' end as trend
    from (select o_custkey, case when count(v) >= 2 then regr_slope(v, year) end as b from {MELT} group by 1)""")
def y06(spark, d):
    slope = wide.slope(YEARS)
    return yearly_orders(spark, d).select("o_custkey", F.round(slope, 4).alias("slope"), wide.direction(slope).alias("trend"))


@query("y07_sign_status", f"""select o_custkey, case when y2001 > 300000 then 'Positive' when y2001 < 300000 then 'Negative' when y2001 = 300000 then 'Zero' else 'Missing' end as status from ({YEARLY})""")
def y07(spark, d):
    return yearly_orders(spark, d).select("o_custkey", wide.sign_status(F.col("y2001") - 300000).alias("status"))


@query("y08_log_or_missing", "select c_custkey, case when c_acctbal >= 1000 then round(ln(1 + (c_acctbal - 1000)), 6) end as balance_log from customer")
def y08(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(wide.log_or_missing(F.col("c_acctbal") - 1000), 6).alias("balance_log"))


NATION_YEARS = "(select n_name, c_mktsegment, {} from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)".format(
    ", ".join(f"round(sum(case when year(o_orderdate) = {y[1:]} then o_totalprice end), 2) as {y}" for y in YEARS))


@query("y09_selected_trend", f"""select * from (unpivot (select * from {NATION_YEARS} where lower(trim(n_name)) = 'nation_7') on {', '.join(YEARS)} into name year value value)
    """.replace("select * from (unpivot", "select n_name, c_mktsegment, substring(year, 2)::int as year, value from (unpivot"))
def y09(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    year = F.year("o_orderdate")
    yearly = o.groupBy("n_name", "c_mktsegment").agg(*[F.round(F.sum(F.when(year == int(y[1:]), F.col("o_totalprice"))), 2).alias(y) for y in YEARS])
    return wide.selected_trend(yearly, "n_name", " NATION_7 ", "c_mktsegment", YEARS)


@query("k01_sort", "select c_custkey, c_acctbal from customer")
def k01(spark, d):
    return sets.sort_rows(table(spark, d, "customer", "c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], descending=True)


@query("k02_top_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def k02(spark, d):
    return sets.top_rows(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 15)


@query("k03_top_groups", "select c_nationkey, round(sum(c_acctbal), 2) as total from customer group by 1 order by sum(c_acctbal) desc, 1 limit 10")
def k03(spark, d):
    return rounded(sets.top_groups(table(spark, d, "customer"), "c_nationkey", "c_acctbal", 10), "total", digits=2)


@query("k06_page", "select p_partkey, p_name from part order by p_partkey limit 25 offset 50")
def k06(spark, d):
    return sets.page(table(spark, d, "part", "p_partkey", "p_name"), ["p_partkey"], 50, 25)


@query("u01_concat", "select c_custkey as key, c_acctbal as balance, c_mktsegment from customer union all select s_suppkey, s_acctbal, null from supplier")
def u01(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return sets.concat_tables(c, s)


HALVES = ("(select * from documents where source < 'src15')", "(select * from documents where source >= 'src15')")


def halves(spark, d):
    """Documents in two parts by their source, as two loads of one corpus would arrive."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    return docs.where("source < 'src15'"), docs.where("source >= 'src15'")


@query("u02_shared_rows", f"select doc_id from {HALVES[0]} where text in (select text from {HALVES[1]})")
def u02(spark, d):
    a, b = halves(spark, d)
    return sets.shared_rows(a, b, ["text"]).select("doc_id")


@query("j03_unique_rows", f"select doc_id from {HALVES[0]} where text not in (select text from {HALVES[1]})")
def j03(spark, d):
    a, b = halves(spark, d)
    return sets.unique_rows(a, b, ["text"]).select("doc_id")


@query("u03_new_columns", "select 'growth_percent' as \"column\", count(*) as present from (select lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as p, o_totalprice from orders) where p is not null and p <> 0")
def u03(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    after = windows.growth_rate(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    name = sets.new_columns(o, after)[0]
    return after.agg(F.lit(name).alias("column"), F.count(name).alias("present"))


@query("u04_first_appearance", "select conv_id, role, min(turn) as first_turn from conversations group by 1, 2")
def u04(spark, d):
    out = sets.first_appearances(table(spark, d, "conversations"), ["conv_id"], "role", ["turn"])
    return out.select("conv_id", "role", F.col("first_at.turn").alias("first_turn"))


@query("j01_lookup", f"select o_orderkey, c_mktsegment as segment from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")
def j01(spark, d):
    ref = table(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return sets.lookup(table(spark, d, "orders"), ref, "o_custkey", "c_mktsegment", "segment").select("o_orderkey", "segment")


FOLDED = "(select *, floor(('0x' || substring(md5(o_orderkey || '|42'), 1, 8))::bigint / 4294967296.0 * 5)::int as fold from orders)"


@query("j02_fold_lookup", f"""with f as {FOLDED}, g as (select avg(o_totalprice) m from orders), k as (select o_custkey, fold, count(*) n, sum(o_totalprice) s from f group by 1, 2),
    a as (select o_custkey, sum(n) n, sum(s) s from k group by 1)
    select f.o_orderkey, f.fold, round(case when a.n > k.n then (a.s - k.s + 5 * m) / (a.n - k.n + 5) else m end, 4) as o_custkey_target_enc
    from f join k on k.o_custkey = f.o_custkey and k.fold = f.fold join a on a.o_custkey = f.o_custkey cross join g""")
def j02(spark, d):
    out = sets.target_encode_by_fold(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")
    return rounded(out, "o_custkey_target_enc", digits=4).select("o_orderkey", "fold", "o_custkey_target_enc")


@query("j04_phrase_matches", """with p as (select distinct lower(p_name) as phrase from part union select 'of the'),
    t as (select distinct lower(p_name || ' ' || p_brand || ' ' || p_type) as text from part)
    select p_partkey, phrase from part join p on regexp_matches(lower(p_name || ' ' || p_type), '\\b' || phrase || '\\b')""")
def j04(spark, d):
    part = table(spark, d, "part")
    phrases = part.select(F.lower("p_name").alias("phrase")).union(spark.sql("select 'of the'"))
    texts = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return sets.match_phrases(texts, "text", phrases, ["p_partkey"])
