"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES (comma-separated) chooses other queries.
"""

import json
import os
import time

from quern.core import get_session, materialize, read_table
from quern.operators import models
from quern.plans import jobs
from quern.workload import QUERIES

HEADLINE = """
p02_standard_text p06_tighten_types d01_keep_first m01_median_with_mode m03_forward_fill v02_validation_report v08_split_integrity
a01_group_mean_sum_count a04_describe_numbers a06_full_profile a07_correlations a10_box_stats a22_roc_auc
w01_group_broadcast w05_growth_rate w07_moving_average_forecast w10_length_budget y02_row_statistics k03_top_groups k04_top_keywords
j02_fold_lookup j04_phrase_matches x02_extended_parts x20_clean_text x27_entities x28_domain_entities x32_word_error_rate
f01_iqr_flags f07_one_hot f12_fold_target_encode f13_polynomial f24_preprocess f26_transform_table
n03_tf_idf n04_chi_square r01_recursive_chunks r02_window_chunks r04_exact_l2 j05_all_pairs_top_k r06_context r13_grounding
g09_point_lookup s02_json_records s06_unwrap_payloads t05_update l06_linear_regression l19_autoregressive_forecast l21_threshold_sweep z03_hourly_means
""".split()


def messy_rows(spark, folder):
    """5,000 messy company rows, made from the first orders by key and stored."""
    o = read_table(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate").orderBy("o_orderkey").limit(5000)
    raw = o.selectExpr("concat(' Company ', o_orderkey) as `Company Name`", "case when o_orderkey % 50 = 0 then 'bad_value' else cast(o_totalprice as string) end as `Revenue`", "o_orderpriority as `Region`", "date_format(o_orderdate, 'yyyy-MM-dd') as `Report Date`")
    return materialize(raw, "bench")


def scoring(spark, folder):
    """A fitted logistic model and all line items prepared for scoring."""
    rows = read_table(spark, folder, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag").selectExpr("*", "cast(l_returnflag = 'R' as int) as label")
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return models.train(rows, features, "label", "LogisticRegression", {"max_iter": 5}), rows


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    run(read_table(spark, folder, "orders").groupBy("o_orderstatus").count())
    times = {}
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    if names is HEADLINE:
        rows = messy_rows(spark, folder)
        start = time.perf_counter()
        run(jobs.transform_with_profile(rows, "company_financials"))
        times["transform_5000_rows"] = round(time.perf_counter() - start, 3)
        model, rows = scoring(spark, folder)
        for label, part in (("score_150_rows", rows.limit(150)), ("score_all_line_items", rows)):
            start = time.perf_counter()
            run(models.batch_predict(model, part))
            times[label] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
