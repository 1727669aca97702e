"""Split, model, run-history, spatial and streaming queries."""

from pyspark.sql import functions as F

from quern.core import describe_rows, scratch_dir, spread
from quern.core import read_table as table
from quern.operators import aggs, evaluate, models, ordered, spatial, validate, windows
from quern.plans import training
from quern.streaming import streams
from quern.workload.registry import query
from quern.workload.shaping import GAPPY, RULES, gappy_orders
from quern.workload.statistics import rounded

UNIT = "('0x' || substring(md5({k} || '|{s}'), 1, 8))::bigint / 4294967296.0"


@query("l01_random_split", f"""select o_orderkey, case when u < 0.7 then 'train' when u < 0.85 then 'validation' else 'test' end as split from (select o_orderkey, {UNIT.format(k='o_orderkey', s=42)} as u from orders)""")
def l01(spark, d):
    return models.random_split(table(spark, d, "orders", "o_orderkey"), "o_orderkey", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query("l02_stratified_split", f"""select o_orderkey, case when row_number() over (partition by o_orderstatus order by u, o_orderkey) <= round(count(*) over (partition by o_orderstatus) * 0.2) then 'test' else 'train' end as split
    from (select *, {UNIT.format(k='o_orderkey', s=42)} as u from orders)""")
def l02(spark, d):
    return models.stratified_split(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus").select("o_orderkey", "split")


def document_sizes(spark, d):
    """All documents with simple size features."""
    docs = spread(table(spark, d, "documents"))
    t = F.col("text")
    return docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("chars"), F.size(F.split(t, " ")).cast("double").alias("words"), F.regexp_count(t, F.lit("[.!?]")).cast("double").alias("marks"),
        F.regexp_count(t, F.lit("[0-9]")).cast("double").alias("digits"))


def document_table(spark, d):
    """Labelled documents with simple size features."""
    return document_sizes(spark, d).join(table(spark, d, "labels"), "doc_id")


DOC_FEATURES = ["chars", "words", "marks", "digits"]


def price_table(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name_length"), F.col("p_retailprice").alias("price"))


@query("l03_cross_validation", f"""with r as (select p_size::double as x, p_retailprice as y, floor({UNIT.format(k='p_partkey', s=42)} * 5)::int as fold from part),
    m as (select f.fold, regr_slope(y, x) as s, regr_intercept(y, x) as i, any_value(f.own) as own from r join (select fold, avg(y) as own from r group by 1) f on r.fold <> f.fold group by 1)
    select fold, round(1 - sum(power(y - i - s * x, 2)) / sum(power(y - own, 2)), 6) as score from r join m using (fold) group by 1""")
def l03(spark, d):
    return rounded(models.cross_validate(price_table(spark, d), "p_partkey", ["size"], "price", "LinearRegression"), "score")


@query("l03_classifier_folds")
def l03_classifier(spark, d):
    return rounded(models.cross_validate(document_table(spark, d), "doc_id", DOC_FEATURES, "quality", "LogisticRegression", 5, {"max_iter": 20}), "score", digits=4)


@query("l04_grid_search")
def l04(spark, d):
    _, results = models.tune(document_table(spark, d), "doc_id", DOC_FEATURES, "quality", "DecisionTree")
    return rounded(results, "score", digits=4)


@query("l05_classifiers")
def l05(spark, d):
    """Every classifier on one stratified split."""
    rows = models.stratified_split(document_table(spark, d), "doc_id", "quality")
    results, _ = models.compare(rows.where("split = 'train'"), rows.where("split = 'test'"), DOC_FEATURES, "quality", {name: {} for name in training.BASELINES["classification"]})
    return describe_rows(spark, [(r["model_name"], round(r["metrics"]["accuracy"], 4), round(r["metrics"]["f1_score"], 4), r["error"]) for r in results], "model string, accuracy double, f1 double, error string")


@query("l06_linear_regression", """select p_partkey, round(intercept + slope * p_size, 4) as prediction from part, (select regr_slope(p_retailprice, p_size) as slope, regr_intercept(p_retailprice, p_size) as intercept from part)""")
def l06(spark, d):
    rows = price_table(spark, d)
    model = models.train(rows, ["size"], "price", "LinearRegression")
    return models.batch_predict(model, rows).select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query("l08_compare_regressors")
def l08(spark, d):
    rows = models.random_split(price_table(spark, d), "p_partkey", {"train": 0.8, "test": 0.2})
    results, _ = models.compare(rows.where("split = 'train'"), rows.where("split = 'test'"), ["size", "name_length"], "price", {name: {} for name in training.BASELINES["regression"]})
    return describe_rows(spark, [(r["model_name"], round(r["metrics"]["rmse"], 3), round(r["metrics"]["r2"], 4), r["error"]) for r in results], "model string, rmse double, r2 double, error string")


NEIGHBOUR_SQL = f"""with e as (select vec_id, label, {UNIT.format(k='vec_id', s=42)} < 0.8 as train, list_transform(embedding[1:8], lambda x: x::double) as v from embeddings),
    d as (select a.vec_id, a.label as truth, b.label, b.vec_id as other, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d from e a join e b on not a.train and b.train),
    n as (select *, row_number() over (partition by vec_id order by d, other) as r from d),
    t as (select 5 as k, 'KNearestNeighbors' as model union all select 3, 'k=3'),
    v as (select model, vec_id, truth, label, count(*) as votes from n join t on r <= k group by all),
    p as (select model, vec_id, any_value(truth) as truth, arg_min(label, -votes * 1000 + label) as prediction from v group by 1, 2)
    select model, count(*) as rows, round(avg((truth = prediction)::int), 6) as accuracy from p group by 1"""


@query("l08_compare_neighbours", NEIGHBOUR_SQL)
def l08_neighbours(spark, d):
    """Nearest neighbours in the comparison of models, on the first eight dimensions of the vectors."""
    names = [f"e{i}" for i in range(8)]
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    rows = models.random_split(e, "vec_id", {"train": 0.8, "test": 0.2})
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    found = [(n, models.compare(train, test, names, "label", {"KNearestNeighbors": p})[0][0]) for n, p in (("KNearestNeighbors", {}), ("k=3", {"knn_neighbors": 3}))]
    held = test.count()
    return describe_rows(spark, [(n, held, round(r["metrics"]["accuracy"], 6)) for n, r in found], "model string, rows long, accuracy double")


@query("l10_feature_importance")
def l10(spark, d):
    model = models.train(document_table(spark, d), DOC_FEATURES, "quality", "RandomForest")
    rows = [(f, round(v, 4)) for f, v in models.feature_importance(model, DOC_FEATURES)]
    return windows.ranked(describe_rows(spark, rows, "feature string, importance double"), "importance", "feature")


@query("l11_permutation_importance")
def l11(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("price"))
    model = models.train(rows, ["quantity", "tax"], "price", "LinearRegression")
    return rounded(models.permutation_importance(model, rows, "l_orderkey", ["quantity", "tax"], "price", "regression", repeats=3), "mean_importance", "std_importance", digits=4)


@query("l12_batch_predict")
def l12(spark, d):
    """Fitted on the labelled documents, applied to all."""
    model = models.train(document_table(spark, d), DOC_FEATURES, "quality", "LogisticRegression", {"max_iter": 20})
    return rounded(models.batch_predict(model, document_sizes(spark, d)).select("doc_id", "prediction", "probability_class_0", "probability_class_1"), "probability_class_0", "probability_class_1", digits=3)


@query("l13_prediction_intervals", """select p_partkey, round(intercept + slope * p_size - 1.96 * s, 4) as lower, round(intercept + slope * p_size + 1.96 * s, 4) as upper from part, (select regr_slope(p_retailprice, p_size) as slope, regr_intercept(p_retailprice, p_size) as intercept from part),
    (select stddev_samp(p_retailprice - (select regr_intercept(p_retailprice, p_size) from part) - (select regr_slope(p_retailprice, p_size) from part) * p_size) as s from part)""")
def l13(spark, d):
    rows = price_table(spark, d)
    scored = models.batch_predict(models.train(rows, ["size"], "price", "LinearRegression"), rows)
    scale = scored.agg(F.stddev_samp(F.col("price") - F.col("prediction"))).collect()[0][0]
    return rounded(evaluate.prediction_interval(scored, "prediction", scale).select("p_partkey", "lower", "upper"), "lower", "upper", digits=4)


@query("l14_forest_forecast")
def l14(spark, d):
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", F.month("o_orderdate").cast("double").alias("month"), F.year("o_orderdate").cast("double").alias("year"), F.weekday("o_orderdate").cast("double").alias("dow"), F.col("o_totalprice").alias("price"))
    _, m = models.forest_forecast(rows, "o_orderkey", ["month", "year", "dow"], "price")
    return describe_rows(spark, [(k, round(m[k], 3)) for k in ("mae", "rmse", "r2")], "metric string, value double")


@query("l15_signed_log_regression", """with t as (select *, sign(p_retailprice) * ln(1 + abs(p_retailprice)) as y from part), m as (select regr_slope(y, p_size) b, regr_intercept(y, p_size) a from t), s as (select p_retailprice as p, y, a + b * p_size as g from t, m),
    o as (select p, y, g, sign(g) * (exp(abs(g)) - 1) as back from s)
    select 'log' as scale, round(avg(abs(y - g)), 6) as mae, round(avg((y - g) * (y - g)), 6) as mse, round(sqrt(avg((y - g) * (y - g))), 6) as rmse, round(1 - avg((y - g) * (y - g)) / var_pop(y), 6) as r2 from o
    union all select 'original', round(avg(abs(p - back)), 6), round(avg((p - back) * (p - back)), 6), round(sqrt(avg((p - back) * (p - back))), 6), round(1 - avg((p - back) * (p - back)) / var_pop(p), 6) from o""")
def l15(spark, d):
    rows = price_table(spark, d)
    return rounded(models.signed_log_regression(rows, rows, ["size"], "price"), "mae", "mse", "rmse", "r2")


@query("l16_learning_curve")
def l16(spark, d):
    out = models.learning_curve(document_table(spark, d), "doc_id", DOC_FEATURES, "quality", "DecisionTree")
    return rounded(out, "train_score", "test_score", digits=4)


@query("l17_baseline_job")
def l17(spark, d):
    runs, best = training.run_baseline(document_table(spark, d).drop("toxic"), "doc_id", "quality", "documents", scratch_dir(spark, "runs"))
    winner = best.collect()[0]["model_name"]
    return runs.select("model_name", "task_type", F.round(F.col("metrics")["f1_score"], 4).alias("f1"), F.lit(winner).alias("best"))


RUN_ROWS = "(select l_suppkey, l_returnflag, round(avg(l_discount) * 10, 6) as f1, round(avg(l_tax), 6) as rmse from lineitem group by 1, 2)"


def run_rows(spark, d):
    """A training history with one run per supplier and return flag."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_discount") * 10, 6).alias("f1"), F.round(F.avg("l_tax"), 6).alias("rmse"))
    metrics = F.to_json(F.struct(F.col("f1").alias("f1_score"), "rmse"))
    return g.select(
        F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("timestamp"), F.concat(F.lit("model "), "l_suppkey").alias("model_name"), F.col("l_returnflag").alias("dataset_name"), F.lit("classification").alias("task_type"),
        F.lit(1.0).alias("training_time_seconds"), F.create_map(F.lit("flag"), "l_returnflag").alias("hyperparameters"), metrics.alias("metrics"))


def stored_runs(spark, d):
    path = scratch_dir(spark, "runs")
    rows = run_rows(spark, d)
    models.append_runs(rows.where("dataset_name = 'R'"), path)
    models.append_runs(rows.where("dataset_name != 'R'"), path)
    return models.load_runs(spark, path)


@query("l18_run_history", f"select 'model ' || l_suppkey as model_name, l_returnflag as dataset_name, f1, rmse from {RUN_ROWS}")
def l18(spark, d):
    return stored_runs(spark, d).select("model_name", "dataset_name", F.col("metrics")["f1_score"].alias("f1"), F.col("metrics")["rmse"].alias("rmse"))


@query("u05_append_runs", f"select l_returnflag as dataset_name, count(*) as runs from {RUN_ROWS} group by 1")
def u05(spark, d):
    return stored_runs(spark, d).groupBy("dataset_name").agg(F.count("*").alias("runs"))


@query("l09_best_run", f"""select * from (select l_returnflag as dataset_name, 'f1_score' as best_metric, 'model ' || l_suppkey as model_name, f1 as best_value from {RUN_ROWS} qualify row_number() over (partition by l_returnflag order by f1 desc, l_suppkey) = 1)
    union all select * from (select l_returnflag, 'rmse', 'model ' || l_suppkey, rmse from {RUN_ROWS} qualify row_number() over (partition by l_returnflag order by rmse, l_suppkey) = 1)""")
def l09(spark, d):
    runs = stored_runs(spark, d).withColumn("set", F.col("dataset_name"))
    both = models.best_run(runs, by=["set"]).unionByName(models.best_run(runs, metric="rmse", by=["set"]))
    return both.select("dataset_name", "best_metric", "model_name", "best_value")


@query("l09_comparison_table", f"select 'model ' || l_suppkey as model_name, l_returnflag as dataset_name, round(f1, 4) as f1_score, round(rmse, 4) as rmse from {RUN_ROWS}")
def l09_table(spark, d):
    return models.comparison_table(stored_runs(spark, d), ["f1_score", "rmse"]).drop("training_time_seconds", "timestamp")


@query("l19_autoregressive_forecast", """with d as (select o_custkey, o_orderdate, o_orderkey, o_totalprice as v, o_totalprice - lag(o_totalprice) over w as d1 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
    e as (select *, lag(d1) over (partition by o_custkey order by o_orderdate, o_orderkey) as d0, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as age from d),
    f as (select o_custkey, case when count(d0) >= 2 then regr_slope(d1, d0) end as b, case when count(d0) >= 2 then regr_intercept(d1, d0) end as a, max(v) filter (age = 1) as last, max(d1) filter (age = 1) as ld from e group by 1 having count(d0) >= 2)
    select o_custkey, 1 as step, round(last + a + b * ld, 2) as forecast from f union all select o_custkey, 2, round(last + a + b * ld + a + b * (a + b * ld), 2) from f""")
def l19(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(windows.autoregressive_forecast(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 2), "forecast", digits=2)


@query("l20_ground_truth_check")
def l20(spark, d):
    """On labelled documents that the model has not seen."""
    rows = models.random_split(document_table(spark, d), "doc_id", {"train": 0.8, "test": 0.2})
    model = models.train(rows.where("split = 'train'"), DOC_FEATURES, "quality", "LogisticRegression", {"max_iter": 20})
    return models.ground_truth_check(model, rows.where("split = 'test'").drop("split"), "doc_id", "quality", 150)[1]


SCORES = "(select quality as y, n_chars / (n_chars + 2000.0) as p from documents join labels using (doc_id))"


@query("l21_threshold_sweep", " union all ".join(f"""select {t}::double as threshold, round(avg(((p >= {t}) = (y = 1))::int), 6) as accuracy, round(coalesce(count(*) filter (p >= {t} and y = 1) / nullif(count(*) filter (p >= {t}), 0), 0), 6) as precision,
    round(coalesce(count(*) filter (p >= {t} and y = 1) / nullif(count(*) filter (y = 1), 0), 0), 6) as recall, round(coalesce(2 * count(*) filter (p >= {t} and y = 1) / nullif(count(*) filter (p >= {t}) + count(*) filter (y = 1), 0), 0), 6) as f1 from {SCORES}""" for t in (0.35, 0.5, 0.65)))
def l21(spark, d):
    docs = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    scored = docs.select(F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"))
    return rounded(evaluate.threshold_sweep(scored, "y", "p", [0.35, 0.5, 0.65]), "accuracy", "precision", "recall", "f1")


@query("l03_score_summary", "select round(avg(value), 6) as mean, round(min(value), 6) as min, round(max(value), 6) as max, round(stddev_pop(value), 6) as std from events")
def l03_summary(spark, d):
    return aggs.summarize(table(spark, d, "events"), "value")


# ---- spatial --------------------------------------------------------------------------

# One square (or two) per customer: lower left corner, side 0.5, some defects for the audits.
BOXES = """(select c_custkey, n_name as state, c_name as district, 60.125 + (c_custkey * 7 % 160) / 4.0::double as x, 5.125 + (c_custkey * 11 % 128) / 4.0::double as y, c_acctbal as density,
    c_custkey % 3 = 0 as multi, c_custkey % 50 = 1 as open_ring, c_custkey % 60 = 2 as far_off from customer join nation on c_nationkey = n_nationkey)"""


def boundary_texts(spark, d):
    """One FeatureCollection text per customer."""
    c = spread(table(spark, d, "customer")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    x, y = F.lit(60.125) + (key * 7 % 160) / 4, F.lit(5.125) + (key * 11 % 128) / 4
    x = F.when(key % 60 == 2, x + 200).otherwise(x)

    def square(a, b):
        ring = [F.array(a, b), F.array(a + 0.5, b), F.array(a + 0.5, b + 0.5), F.array(a, b + 0.5)]
        return F.array(F.when(key % 50 == 1, F.array(*ring)).otherwise(F.array(*ring, ring[0])))

    names = F.when(key % 2 == 0, F.create_map(F.lit("NAME_1"), "n_name", F.lit("NAME_2"), "c_name", F.lit("density"), F.col("c_acctbal").cast("string"))).otherwise(
        F.create_map(F.lit("state"), "n_name", F.lit("district"), "c_name", F.lit("density"), F.col("c_acctbal").cast("string")))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), square(x, y).alias("coordinates")))
    two = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(square(x, y), square(x + 1, y)).alias("coordinates")))
    geometry = F.when(key % 3 == 0, two).otherwise(one)
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), F.to_json(names), F.lit(',"geometry":'), geometry, F.lit("}]}"))
    return c.select("c_custkey", text.alias("value"))


def boundaries(spark, d):
    return spatial.parse_collections(boundary_texts(spark, d), "value", ["c_custkey"])


def order_points(spark, d):
    key = F.col("o_orderkey")
    return spread(table(spark, d, "orders", "o_orderkey")).select("o_orderkey", (F.lit(60.0) + (key * 13 % 4200) / 100).alias("lon"), (F.lit(5.0) + (key * 17 % 3300) / 100).alias("lat"))


@query("g01_load_tiers", f"select 2 as tier, case when multi then 'MultiPolygon' else 'Polygon' end as geometry_type, count(*) as features, sum(case when multi then 2 else 1 end)::bigint as rings from {BOXES} group by 2")
def g01(spark, d):
    path = scratch_dir(spark, "tier")
    boundary_texts(spark, d).select("value").write.text(path)
    features = spatial.parse_collections(spark.read.text(path).withColumn("tier", F.lit(2)), "value", ["tier"])
    return features.groupBy("tier", "geometry_type").agg(F.count("*").alias("features"), F.sum(F.size("rings")).alias("rings"))


@query("g02_state_filter", f"select c_custkey from {BOXES} where lower(state) = 'nation_3'")
def g02(spark, d):
    return spatial.in_state(boundaries(spark, d), "  NaTion_3 ").select("c_custkey")


@query("g03_name_search", f"select c_custkey from {BOXES} where contains(lower(district), '#00000012')")
def g03(spark, d):
    return spatial.named_like(boundaries(spark, d), "CUSTOMER#00000012").select("c_custkey")


@query("g04_standard_attributes", f"select c_custkey, state, district from {BOXES}")
def g04(spark, d):
    return spatial.standard_attributes(boundaries(spark, d)).select("c_custkey", "state", "district")


@query("g05_bounds_audit", f"select c_custkey, not far_off as in_world, not far_off and x + case when multi then 1.5 else 0.5 end <= 100 and y + 0.5 <= 40 as in_country from {BOXES}")
def g05(spark, d):
    return spatial.audit(boundaries(spark, d)).select("c_custkey", "in_world", "in_country")


@query("g06_ring_audit", f"select c_custkey, not open_ring as rings_closed, case when multi then 2 else 1 end as ring_count from {BOXES}")
def g06(spark, d):
    return spatial.audit(boundaries(spark, d)).select("c_custkey", "rings_closed", "ring_count")


@query("g07_summary", f"select count(*) as districts, count(distinct state) as states, round(avg(density), 6) as mean_density from {BOXES}")
def g07(spark, d):
    return rounded(spatial.summary(boundaries(spark, d)), "mean_density")


@query("g07_districts_per_state", f"select state, count(*) as districts from {BOXES} group by 1")
def g07_states(spark, d):
    return spatial.districts_per_state(boundaries(spark, d))


@query("g08_sample_points", f"""select 60.0::double + (o_orderkey * 13 % 4200) / 100.0::double as lon, 5.0::double + (o_orderkey * 17 % 3300) / 100.0::double as lat, o_totalprice as weight from orders order by {UNIT.format(k='o_orderkey', s=42)}, o_orderkey limit 100""")
def g08(spark, d):
    p = order_points(spark, d).join(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_orderkey")
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    props = F.to_json(F.create_map(F.lit("weight"), F.col("o_totalprice").cast("string")))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geometry, F.lit("}]}"))
    features = spatial.parse_collections(p.select("o_orderkey", text.alias("value")), "value", ["o_orderkey"])
    return spatial.sample_points(features, 100, F.col("o_orderkey"))


@query("g09_point_lookup", f"""with p as (select o_orderkey, 60.0::double + (o_orderkey * 13 % 4200) / 100.0::double as lon, 5.0::double + (o_orderkey * 17 % 3300) / 100.0::double as lat from orders),
    s as (select c_custkey, x, y from {BOXES} where not open_ring and not far_off union all select c_custkey, x + 1, y from {BOXES} where multi and not open_ring and not far_off)
    select o_orderkey, c_custkey from p join s on lon > x and lon < x + 0.5 and lat > y and lat < y + 0.5""")
def g09(spark, d):
    good = spatial.audit(boundaries(spark, d)).where("rings_closed and in_world")
    return spatial.locate(order_points(spark, d), good.select("c_custkey", "rings"), keep=["c_custkey"]).select("o_orderkey", "c_custkey")


@query("g10_box_overlap", f"select c_custkey from {BOXES} where not far_off and x <= 80 and x + case when multi then 1.5 else 0.5 end >= 75 and y <= 20 and y + 0.5 >= 15")
def g10(spark, d):
    return spatial.overlapping(boundaries(spark, d), 75, 15, 80, 20).select("c_custkey")


# ---- streaming ------------------------------------------------------------------------


def arriving_events(spark, d, files=6):
    """The events written file after file in time order, as they would arrive."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return land_in_order(e, scratch_dir(spark, "arrivals"), files), e.schema


def land_in_order(events, path, files=6):
    cuts = events.agg(F.percentile_approx(F.unix_micros("ts"), [i / files for i in range(1, files)])).collect()[0][0]
    part = ordered.cut_tree(F.unix_micros("ts"), cuts)
    for i in range(files):
        events.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return path


@query("z01_chunked_append", "select event_id, case when event_type = 'purchase' then round(value * 1.18::double, 6) else value end as taxed from events")
def z01(spark, d):
    from quern.operators.shape import conditional_uplift

    path, schema = arriving_events(spark, d)
    out = scratch_dir(spark, "out")
    stream = streams.file_stream(spark, path, schema, files_per_batch=2)
    streams.append_all(stream, out, scratch_dir(spark, "checkpoint"), lambda s: conditional_uplift(s, "value", "event_type", value="purchase").select("event_id", "taxed"))
    done = spark.read.parquet(out)
    return done.select("event_id", F.when(F.col("taxed").isNotNull(), F.round("taxed", 6)).alias("taxed"))


@query("z02_poll", "select event_type, count(*) as rows, 6 as batches from events group by 1")
def z02(spark, d):
    path, schema = arriving_events(spark, d)
    out = scratch_dir(spark, "out")
    stream = streams.file_stream(spark, path, schema, files_per_batch=1)
    n = streams.poll(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch_dir(spark, "checkpoint"), "0 seconds", max_batches=6)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("rows"), F.lit(n).alias("batches"))


@query("z03_hourly_means", """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, round(avg(value), 6) as mean, count(*) as rows from events group by 1, 2""")
def z03(spark, d):
    path, schema = arriving_events(spark, d)
    out = scratch_dir(spark, "out")
    streams.end_of_input(spark, path, schema, "ts")
    stream = streams.file_stream(spark, path, schema, files_per_batch=2)
    streams.append_all(stream, out, scratch_dir(spark, "checkpoint"), lambda s: streams.windowed_means(s, "ts", "value", ["event_type"]))
    done = spark.read.parquet(out)
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", F.round("mean", 6).alias("mean"), "rows")


@query("z04_validate_on_arrival", f"""select o_orderkey, price is null or price not between 10000 and 400000 or priority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') and priority is not null or status is null or status = 'P' as quarantined from ({GAPPY})""")
def z04(spark, d):
    path = scratch_dir(spark, "orders")
    rows = gappy_orders(spark, d)
    rows.repartition(4).write.parquet(path)
    good, bad = scratch_dir(spark, "good"), scratch_dir(spark, "bad")
    streams.validate_on_arrival(streams.file_stream(spark, path, rows.schema, files_per_batch=2), RULES, good, bad, scratch_dir(spark, "checkpoint"))
    kept = spark.read.parquet(good).select("o_orderkey", F.lit(False).alias("quarantined"))
    return kept.unionByName(spark.read.parquet(bad).select("o_orderkey", F.lit(True).alias("quarantined")))


@query("z05_drop_repeats", "select event_id, event_type from events")
def z05(spark, d):
    """Three arrivals, a run for each: every arrival repeats the rows of the one before, which only the kept state can tell."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = (int(v) for v in e.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts")) + 1).collect()[0])
    third = F.floor((F.unix_seconds("ts") - first) * 3 / (last - first))
    path, out, mark = (scratch_dir(spark, n) for n in ("arrivals", "out", "checkpoint"))
    for arrival in range(3):
        e.where(third.between(arrival - 1, arrival)).write.mode("append").parquet(path)
        stream = streams.file_stream(spark, path, e.schema)
        streams.append_all(stream, out, mark, lambda s: streams.drop_repeats(s, "ts", ["event_id"], f"{last - first} seconds").select("event_id", "event_type"))
    return spark.read.parquet(out)


@query("v08_split_integrity", """select 'train' as "left", 'validation' as "right", 0 as overlap, true as same_columns union all select 'train', 'test', 0, true union all select 'validation', 'test', 0, true""")
def v08_integrity(spark, d):
    o = models.random_split(table(spark, d, "orders"), "o_orderkey", {"train": 0.7, "validation": 0.15, "test": 0.15})
    parts = {n: o.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}
    return validate.split_overlaps(parts, ["o_orderkey", "o_custkey", "o_totalprice"])
