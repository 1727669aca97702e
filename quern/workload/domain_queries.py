"""Domain feature jobs on tables derived from the given ones."""

from pyspark.sql import functions as F

from quern.core import read_table as table
from quern.plans import domains
from quern.workload.language import W
from quern.workload.registry import query
from quern.workload.statistics import NATION_YEARS, YEARS, rounded


def nation_years(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    year = F.year("o_orderdate")
    return o.groupBy("n_name", "c_mktsegment").agg(*[F.round(F.sum(F.when(year == int(y[1:]), F.col("o_totalprice"))), 2).alias(y) for y in YEARS])


MELTED = f"(unpivot {NATION_YEARS} on {', '.join(YEARS)} into name name value value)"


@query("dom_economic", f"""with s as (select n_name, c_mktsegment, avg(value) as mean, stddev_samp(value) as std, case when count(value) >= 2 then regr_slope(value, substring(name, 2)::int) end as slope from {MELTED} group by 1, 2),
    q as (select quantile_cont(mean, 0.25) q1, quantile_cont(mean, 0.75) q3 from s)
    select n_name, c_mktsegment, round(mean, 4) as mean, round(std, 4) as std, round(slope, 4) as trend_slope, case when slope > 0 then 'Increasing' when slope < 0 then 'Decreasing' when slope = 0 then 'Stable' else 'No Trend' end as trend_direction,
      dense_rank() over (order by n_name) - 1 as n_name_id, dense_rank() over (order by c_mktsegment) - 1 as c_mktsegment_id, count(*) over (partition by n_name) as n_name_records_count, count(*) over (partition by n_name, c_mktsegment) as pair_records_count,
      (mean < q1 - 1.5 * (q3 - q1) or mean > q3 + 1.5 * (q3 - q1))::int as mean_outlier, round((pow(y2001 / y1995, 1 / 6) - 1) * 100, 6) as cagr_percent, {" + ".join(f"({y} is null)::int" for y in YEARS)} as missing_values
    from s join {NATION_YEARS} using (n_name, c_mktsegment), q""")
def economic(spark, d):
    out = domains.economic_features(nation_years(spark, d), "n_name", "c_mktsegment")
    out = out.select("n_name", "c_mktsegment", "mean", "std", "trend_slope", "trend_direction", "n_name_id", "c_mktsegment_id", "n_name_records_count", "pair_records_count", "mean_outlier", "cagr_percent", "missing_values")
    return rounded(rounded(out, "mean", "std", "trend_slope", digits=4), "cagr_percent")


@query("dom_market", f"""select n_name, c_mktsegment, round(y2001 - y2000, 4) as latest_change, round((y2001 - y1995) / abs(y1995) * 100, 6) as percent_change, round(ln(1 + y2001), 6) as latest_log, case when y2001 > 0 then 'Positive' else 'Missing' end as latest_status from {NATION_YEARS}""")
def market(spark, d):
    named = nation_years(spark, d).withColumnsRenamed({y: f"{y[1:]} [YR{y[1:]}]" for y in YEARS})
    out = domains.market_features(named).select("n_name", "c_mktsegment", "latest_change", "percent_change", "latest_log", "latest_status")
    return rounded(rounded(out, "latest_change", digits=4), "percent_change", "latest_log")


@query("dom_works", """with w as (select s_suppkey, s_nationkey as state, s_name as district, count(*)::double as workers, sum(l_extendedprice) as expenditure, avg(l_quantity) as wage from supplier join lineitem on s_suppkey = l_suppkey group by 1, 2, 3)
    select s_suppkey, count(*) over (partition by state) as state_district_nunique, round(workers / sum(workers) over (partition by state) * 100, 6) as workers_share, round(expenditure / workers, 4) as expenditure_per_worker_lakhs, round(workers / wage, 6) as worker_wage_ratio,
      case when wage < (select median(wage) from w) then 'Below Median Wage' else 'At or Above Median Wage' end as wage_category, round(workers - median(workers) over (partition by state), 6) + 0 as workers_vs_state_median,
      (workers < (select quantile_cont(workers, 0.25) - 1.5 * (quantile_cont(workers, 0.75) - quantile_cont(workers, 0.25)) from w) or workers > (select quantile_cont(workers, 0.75) + 1.5 * (quantile_cont(workers, 0.75) - quantile_cont(workers, 0.25)) from w))::int as workers_outlier from w""")
def works(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("workers"), F.sum("l_extendedprice").alias("expenditure"), F.avg("l_quantity").alias("wage"))
    w = table(spark, d, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.col("s_nationkey").alias("state"), F.col("s_name").alias("district"), "workers", "expenditure", "wage")
    out = domains.works_features(w, "state", "district", "workers", "expenditure", "wage")
    out = out.select("s_suppkey", "state_district_nunique", "workers_share", "expenditure_per_worker_lakhs", "worker_wage_ratio", "wage_category", "workers_vs_state_median", "workers_outlier")
    return rounded(rounded(out, "workers_share", "worker_wage_ratio", "workers_vs_state_median"), "expenditure_per_worker_lakhs", digits=4)


@query("dom_papers", rf"""select doc_id, length(title) as title_characters, len(regexp_extract_all(title, '[{W}]+')) as title_words, len(regexp_extract_all(text, '[{W}]+')) as summary_words, len(regexp_extract_all(text, '[.!?]+')) as summary_sentences,
    (contains(lower(text), 'model') or contains(lower(text), 'method') or contains(lower(text), 'approach') or contains(lower(text), 'algorithm') or contains(lower(text), 'technique'))::int as summary_method,
    round(case when len(regexp_extract_all(text, '[{W}]+')) > 0 then len(regexp_extract_all(title, '[{W}]+')) / len(regexp_extract_all(text, '[{W}]+')) else 0 end, 6) as title_summary_ratio, 2 as items, lang as first_item
    from (select doc_id, text, lang, source, split_part(text, '.', 1) as title from documents)""")
def papers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("summary"), F.format_string("['%s', '%s']", "lang", "source").alias("terms"))
    out = domains.paper_features(docs, "title", "summary", "terms")
    return rounded(out.select("doc_id", "title_characters", "title_words", "summary_words", "summary_sentences", "summary_method", "title_summary_ratio", "items", "first_item"), "title_summary_ratio")


@query("dom_traffic", """with e as (select event_id, date_trunc('minute', ts) as t, value as vehicles, value * 0.9::double as speed, 100 - value as occupancy, event_type from events)
    select event_id, hour(t) as time_hour, case when hour(t) between 5 and 11 then 'Morning' when hour(t) between 12 and 16 then 'Afternoon' when hour(t) between 17 and 20 then 'Evening' when hour(t) between 21 and 23 then 'Night' else 'Late Night' end as time_period,
      case when speed < 20 then 'Very Slow' when speed <= 40 then 'Slow' when speed <= 60 then 'Moderate' else 'Fast' end as speed_category, (vehicles >= (select median(vehicles) from e))::int as high_traffic, (speed < (select median(speed) from e))::int as low_speed,
      (vehicles >= (select median(vehicles) from e) and speed < (select median(speed) from e))::int as congestion_risk, dense_rank() over (order by event_type) - 1 as event_type_id, round(vehicles - avg(vehicles) over (partition by event_type), 6) + 0 as vehicles_vs_event_type_mean from e""")
def traffic(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "dd-MM-yyyy HH:mm").alias("at"), F.col("value").alias("vehicles"), (F.col("value") * 0.9).alias("speed"), (F.lit(100) - F.col("value")).alias("occupancy"), "event_type")
    out = domains.traffic_features(e, "at", "vehicles", "speed", "occupancy", ["event_type"])
    return rounded(out.select("event_id", "time_hour", "time_period", "speed_category", "high_traffic", "low_speed", "congestion_risk", "event_type_id", "vehicles_vs_event_type_mean"), "vehicles_vs_event_type_mean")
