"""Outlier, scaling, encoding, construction and whole-job queries."""

from pyspark.sql import functions as F

from quern.core import describe_rows
from quern.core import read_table as table
from quern.operators import features, models, sets
from quern.plans import jobs
from quern.workload.model_queries import UNIT
from quern.workload.registry import query
from quern.workload.shaping import GAPPY, MODES, gappy_orders
from quern.workload.statistics import rounded

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey")
LK = ", ".join(LINE_KEY)
FENCE = "(select quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 from lineitem)"


@query("f01_iqr_flags", f"select {LK}, (l_extendedprice < q1 - 0.2 * (q3 - q1) or l_extendedprice > q3 + 0.2 * (q3 - q1))::int as l_extendedprice_outlier from lineitem, {FENCE}")
def f01(spark, d):
    df = table(spark, d, "lineitem", *LINE_KEY, "l_extendedprice")
    return features.mark_outliers(df, ["l_extendedprice"], 0.2).drop("l_extendedprice")


@query("f02_zscore_flags", f"select {LK}, abs(l_extendedprice - m) / s > 1.5 as flag from lineitem, (select avg(l_extendedprice) m, stddev_pop(l_extendedprice) s from lineitem)")
def f02(spark, d):
    df = table(spark, d, "lineitem", *LINE_KEY, "l_extendedprice")
    return df.select(*LINE_KEY, features.zscore_flags(df, ["l_extendedprice"], 1.5)["l_extendedprice"].alias("flag"))


@query("f03_clip_iqr", f"select {LK}, round(least(greatest(l_extendedprice, q1 - 0.2 * (q3 - q1)), q3 + 0.2 * (q3 - q1)), 6) as l_extendedprice from lineitem, {FENCE}")
def f03(spark, d):
    df = table(spark, d, "lineitem", *LINE_KEY, "l_extendedprice")
    return rounded(features.handle_outliers(df, "iqr", 0.2, "clip", ["l_extendedprice"]), "l_extendedprice")


@query("f03_remove", f"select {LK} from lineitem, {FENCE} where l_extendedprice between q1 - 0.2 * (q3 - q1) and q3 + 0.2 * (q3 - q1)")
def f03_remove(spark, d):
    df = table(spark, d, "lineitem", *LINE_KEY, "l_extendedprice")
    return features.handle_outliers(df, "iqr", 0.2, "remove", ["l_extendedprice"]).drop("l_extendedprice")


@query("f03_winsorize", f"""select {LK}, round(least(greatest(l_extendedprice, a), b), 6) as l_extendedprice from lineitem,
    (select quantile_cont(l_extendedprice, 0.05) a, quantile_cont(l_extendedprice, 0.95) b from lineitem)""")
def f03_winsorize(spark, d):
    df = table(spark, d, "lineitem", *LINE_KEY, "l_extendedprice")
    return rounded(features.handle_outliers(df, "iqr", 0.2, "winsorize", ["l_extendedprice"]), "l_extendedprice")


@query("f04_minmax", """select p_partkey, round((p_retailprice - a) / (b - a), 6) as p_retailprice_norm, round((p_size - c) / (e - c), 6) as p_size_norm from part,
    (select min(p_retailprice) a, max(p_retailprice) b, min(p_size) c, max(p_size) e from part)""")
def f04(spark, d):
    df = features.scale(table(spark, d, "part"), ["p_retailprice", "p_size"], "minmax", "_norm")
    return rounded(df.select("p_partkey", "p_retailprice_norm", "p_size_norm"), "p_retailprice_norm", "p_size_norm")


@query("f05_zscore", "select c_custkey, round((c_acctbal - m) / s, 6) + 0 as c_acctbal from customer, (select avg(c_acctbal) m, stddev_samp(c_acctbal) s from customer)")
def f05(spark, d):
    return rounded(features.scale(table(spark, d, "customer", "c_custkey", "c_acctbal"), ["c_acctbal"], "zscore"), "c_acctbal")


@query("f06_standard_scaler", """select o_orderkey, round((o_totalprice - m) / s, 6) + 0 as o_totalprice from orders, (select avg(o_totalprice) m, stddev_pop(o_totalprice) s
    from orders where o_orderstatus <> 'P')""")
def f06(spark, d):
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    fitted = features.fit_scaler(df.where("o_orderstatus != 'P'"), ["o_totalprice"], "standard")
    return rounded(features.apply_scaler(df, fitted), "o_totalprice").drop("o_orderstatus")


LEVELS = ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"]


@query("f07_one_hot", f"""select o_orderkey, {", ".join(f"coalesce(lower(priority) = '{v}', false)::int as \"priority_{v}\"" for v in LEVELS)}, (priority is null)::int as priority_nan from ({GAPPY})""")
def f07(spark, d):
    return features.one_hot(gappy_orders(spark, d).select("o_orderkey", "priority"), ["priority"])


@query("f07_sparse_levels", "select c_custkey, lower(trim(c_name)) as c_name, dense_rank() over (order by lower(trim(c_name))) - 1 as c_name_code, (select count(distinct lower(trim(c_name))) from customer) as levels from customer")
def f07_sparse(spark, d):
    """One level per customer name."""
    rows, codes = features.one_hot_sparse(table(spark, d, "customer", "c_custkey", "c_name"), "c_name")
    return rows.drop("c_name_onehot").withColumn("levels", F.lit(codes.count()))


@query("f08_one_hot_capped", """with c as (select p_brand, count(*) n from part group by 1), k as (select p_brand from c order by n desc, p_brand desc limit 9),
    l as (select p_brand, row_number() over (order by p_brand) rn from k)
    select 'kept' as kind, p.p_brand as level, count(*) as rows from part p join l on l.p_brand = p.p_brand where rn > 1 group by 2
    union all select 'kept', 'infrequent_sklearn', count(*) from part where p_brand not in (select p_brand from k)""")
def f08(spark, d):
    df = table(spark, d, "part", "p_brand")
    wide = features.apply_one_hot_capped(df, features.fit_one_hot_capped(df, ["p_brand"], drop_first=True, max_categories=10))
    sums = wide.agg(*[F.sum(F.col(f"`{c}`")).cast("bigint").alias(c) for c in wide.columns])
    cells = F.array(*[F.struct(F.lit("kept").alias("kind"), F.lit(c[len("p_brand_"):]).alias("level"), F.col(f"`{c}`").alias("rows")) for c in wide.columns])
    return sums.select(F.inline(cells))


@query("f09_label_codes", """select p_partkey, (select count(distinct x.p_brand) from part x where x.p_brand < p.p_brand) as p_brand, (select count(distinct x.p_type) from part x where x.p_type < p.p_type) as p_type from part p""")
def f09(spark, d):
    return features.label_encode(table(spark, d, "part", "p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query("f09_codes_missing_negative", f"select o_orderkey, case when status is null then -1 else (dense_rank() over (order by status nulls last) - 1) end as status from ({GAPPY})")
def f09_negative(spark, d):
    return features.label_encode(gappy_orders(spark, d).select("o_orderkey", "status"), ["status"], missing="negative")


@query("f10_frequency", f"select o_orderkey, case when status is not null then round(count(*) over (partition by status) / (select count(*) from orders), 6) end as status_freq from ({GAPPY})")
def f10(spark, d):
    return rounded(features.frequency_encode(gappy_orders(spark, d).select("o_orderkey", "status"), ["status"]), "status_freq").drop("status")


@query("f11_target_encode", """select o_orderkey, round((count(*) over w * avg(o_totalprice) over w + 5 * m) / (count(*) over w + 5), 4) as o_orderpriority_target_enc
    from orders, (select avg(o_totalprice) m from orders) window w as (partition by o_orderpriority)""")
def f11(spark, d):
    out = sets.target_encode(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(out, "o_orderpriority_target_enc", digits=4).select("o_orderkey", "o_orderpriority_target_enc")


@query("f12_fold_target_encode", """with f as (select *, floor(('0x' || substring(md5(o_orderkey || '|42'), 1, 8))::bigint / 4294967296.0 * 5)::int as fold from orders), g as (select avg(o_totalprice) m from orders),
    k as (select o_orderpriority, fold, count(*) n, sum(o_totalprice) s from f group by 1, 2), a as (select o_orderpriority, sum(n) n, sum(s) s from k group by 1)
    select f.o_orderkey, f.fold, round((a.s - k.s + 5 * m) / (a.n - k.n + 5), 4) as o_orderpriority_target_enc from f join k using (o_orderpriority, fold) join a using (o_orderpriority) cross join g""")
def f12(spark, d):
    out = sets.target_encode_by_fold(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return rounded(out, "o_orderpriority_target_enc", digits=4).select("o_orderkey", "fold", "o_orderpriority_target_enc")


@query("f13_polynomial", f"""select {LK}, round(l_quantity * l_quantity, 6) as "l_quantity^2", round(l_quantity * l_discount, 6) as l_quantity_x_l_discount, round(l_quantity * l_tax, 6) as l_quantity_x_l_tax,
    round(l_discount * l_discount, 6) as "l_discount^2", round(l_discount * l_tax, 6) as l_discount_x_l_tax, round(l_tax * l_tax, 6) as "l_tax^2" from lineitem""")
def f13(spark, d):
    df = table(spark, d, "lineitem", *LINE_KEY, "l_quantity", "l_discount", "l_tax")
    out = features.polynomial(df, ["l_quantity", "l_discount", "l_tax"])
    made = sets.new_columns(df, out)
    return out.select(*LINE_KEY, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in made])


@query("f14_ratios", f"select {LK}, round(l_extendedprice / (l_quantity + 1e-10), 4) as l_extendedprice_div_l_quantity from lineitem")
def f14(spark, d):
    df = features.ratios(table(spark, d, "lineitem"), [("l_extendedprice", "l_quantity")])
    return rounded(df, "l_extendedprice_div_l_quantity", digits=4).select(*LINE_KEY, "l_extendedprice_div_l_quantity")


@query("f15_quantile_bins", """select p_partkey, ((p_retailprice >= a)::int + (p_retailprice >= b)::int + (p_retailprice >= c)::int + (p_retailprice >= e)::int)::double as p_retailprice_binned from part,
    (select quantile_cont(p_retailprice, 0.2) a, quantile_cont(p_retailprice, 0.4) b, quantile_cont(p_retailprice, 0.6) c, quantile_cont(p_retailprice, 0.8) e from part)""")
def f15(spark, d):
    return features.bin_columns(table(spark, d, "part"), ["p_retailprice"]).select("p_partkey", "p_retailprice_binned")


@query("f15_uniform_one_hot", """select p_partkey, (i = 0)::double as p_size_bin_0, (i = 1)::double as p_size_bin_1, (i = 2)::double as p_size_bin_2 from (select p_partkey,
    (p_size >= a + (b - a) / 3)::int + (p_size >= a + (b - a) * 2 / 3)::int as i from part, (select min(p_size)::double a, max(p_size)::double b from part))""")
def f15_uniform(spark, d):
    return features.bin_columns(table(spark, d, "part"), ["p_size"], 3, "uniform", "onehot").select("p_partkey", "p_size_bin_0", "p_size_bin_1", "p_size_bin_2")


@query("f16_log_transform", "select c_custkey, round(ln(1 + c_acctbal + case when m <= 0 then 1 - m else 0 end), 6) as c_acctbal from customer, (select min(c_acctbal) m from customer)")
def f16(spark, d):
    return rounded(features.log_transform(table(spark, d, "customer", "c_custkey", "c_acctbal"), ["c_acctbal"])[0], "c_acctbal")


@query("f16_skewed_columns", " union all ".join(f"""select '{c}' as "column" from lineitem having abs(skewness({e})) > 1""" for c, e in (("l_tax", "l_tax"), ("l_quantity", "l_quantity"), ("cube", "pow(l_quantity, 6)"))))
def f16_skewed(spark, d):
    df = table(spark, d, "lineitem", "l_tax", "l_quantity").withColumn("cube", F.pow("l_quantity", F.lit(6)))
    return describe_rows(spark, [(c,) for c in features.skewed_columns(df, ["l_tax", "l_quantity", "cube"])], "column string")


@query("f17_boxcox")
def f17(spark, d):
    out, _ = features.boxcox_transform(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice"])
    return rounded(out, "o_totalprice", digits=4)


@query("f18_variance_selection", "select l_extendedprice, l_quantity, l_returnflag from lineitem")
def f18(spark, d):
    return features.select_by_variance(table(spark, d, "lineitem", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity", "l_tax"), 0.01)[0]


@query("f19_drop_correlated", "select p_size, p_retailprice from part")
def f19(spark, d):
    df = table(spark, d, "part", "p_size", "p_retailprice").withColumns({"double_size": F.col("p_size") * 2 + 1, "opposite": -F.col("p_retailprice")})
    return features.drop_correlated(df)[0]


COV = "(select var_samp(p_size) a, var_samp(p_retailprice) b, covar_samp(p_size, p_retailprice) c from part)"


@query("f20_pca_variance", f"""select 'pca_1' as "component", round((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c), 3) as variance from {COV}
    union all select 'pca_2', round((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 3) from {COV}""")
def f20(spark, d):
    out, _ = features.pca_columns(table(spark, d, "part"), ["p_size", "p_retailprice"], 2)
    parts = out.agg(*[F.round(F.var_samp(c), 3).alias(c) for c in ("pca_1", "pca_2")])
    return parts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("variance")) for c in ("pca_1", "pca_2")])))


@query("f20_pca_embeddings")
def f20_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    out, _ = features.pca_columns(wide, [f"x{i}" for i in range(64)], 8)
    return out.select("vec_id", *[F.round(F.abs(f"pca_{i + 1}"), 4).alias(f"pca_{i + 1}") for i in range(8)])


@query("f21_clusters")
def f21(spark, d):
    return features.cluster_labels(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"]).select("c_custkey", "cluster_label")


HASHED = "(select *, ('0x' || substring(md5(doc_id || '|42'), 1, 8))::bigint / 4294967296.0 as u from labels)"


@query("f22_random_undersample", f"""select doc_id, quality, toxic from (select *, row_number() over (partition by quality order by u, doc_id) as pos from {HASHED})
    where pos <= (select min(n) from (select count(*) n from labels group by quality))""")
def f22(spark, d):
    return features.random_undersample(table(spark, d, "labels"), "quality", "doc_id")


@query("f22_random_oversample", f"""select doc_id, quality, toxic from (select *, row_number() over (partition by quality order by u, doc_id) as pos, count(*) over (partition by quality) as n from {HASHED}) r,
    (select max(n) m from (select count(*) n from labels group by quality)) x, range(1000) c(i) where i < m // r.n + (pos <= m % r.n)::int""")
def f22_over(spark, d):
    return features.random_oversample(table(spark, d, "labels"), "quality", "doc_id")


def labelled_sizes(spark, d):
    """Labelled documents with two size measures as features."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"))
    return docs.join(table(spark, d, "labels", "doc_id", "toxic"), "doc_id")


@query("f23_smote_balance", "select 0 as toxic, count(*) filter (toxic = 0) as rows from labels union all select 1, count(*) filter (toxic = 0) from labels")
def f23(spark, d):
    return features.resample(labelled_sizes(spark, d), "toxic", "doc_id", ["chars", "words"], "smote").groupBy("toxic").agg(F.count("*").alias("rows"))


@query("f23_adasyn")
def f23_adasyn(spark, d):
    out = features.adasyn(labelled_sizes(spark, d), "toxic", 1, "doc_id", ["chars", "words"])
    return out.select("_base", "_copy", F.round("chars", 4).alias("chars"), F.round("words", 4).alias("words"))


F24_SQL = f"""with i as (select o_orderkey, o_custkey, coalesce(price, (select avg(price) from ({GAPPY}))) as price, coalesce(priority, 'nan') as priority, coalesce(status, 'nan') as status from ({GAPPY})),
    k as (select *, dense_rank() over (order by priority) - 1 as pc, dense_rank() over (order by status) - 1 as sc from i)
    select o_orderkey, round((o_custkey - avg(o_custkey) over ()) / stddev_pop(o_custkey) over (), 6) + 0 as o_custkey, round((price - avg(price) over ()) / stddev_pop(price) over (), 6) + 0 as price,
    round((pc - avg(pc) over ()) / stddev_pop(pc) over (), 6) + 0 as priority, round((sc - avg(sc) over ()) / stddev_pop(sc) over (), 6) + 0 as status from k"""


@query("f24_preprocess", F24_SQL)
def f24(spark, d):
    out, _ = jobs.preprocess(gappy_orders(spark, d), row_id="o_orderkey")
    return rounded(out, "o_custkey", "price", "priority", "status")


J07_SQL = f"""with g as (select *, {UNIT.format(k='o_orderkey', s=42)} < 0.8 as train from ({GAPPY})), m as (select avg(price) as p from g where train),
    i as (select o_orderkey, train, o_custkey, coalesce(price, p) as price, coalesce(priority, 'nan') as priority, coalesce(status, 'nan') as status from g, m),
    a as (select priority, row_number() over (order by priority) - 1 as pc from (select distinct priority from i where train)), b as (select status, row_number() over (order by status) - 1 as sc from (select distinct status from i where train)),
    k as (select o_orderkey, train, o_custkey, price, coalesce(pc, -1) as priority, coalesce(sc, -1) as status from i left join a using (priority) left join b using (status)),
    f as (select {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in ("o_custkey", "price", "priority", "status"))} from k where train)
    select o_orderkey, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0 as {c}" for c in ("o_custkey", "price", "priority", "status"))} from k, f where not train"""


@query("j07_apply_preprocess", J07_SQL)
def j07(spark, d):
    """Fitted on four fifths of the orders, applied to the rest."""
    rows = models.random_split(gappy_orders(spark, d), "o_orderkey", {"train": 0.8, "test": 0.2})
    train, test = (rows.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    _, fitted = jobs.preprocess(train, row_id="o_orderkey")
    return rounded(jobs.apply_preprocess(test, fitted), "o_custkey", "price", "priority", "status")


@query("f25_engineer_features", """select p_partkey, p_size, p_retailprice, length(p_name) as p_name_length, length(p_brand) as p_brand_length, length(p_type) as p_type_length, p_partkey * p_size as p_partkey_x_p_size,
    round(p_partkey * p_retailprice, 4) as p_partkey_x_p_retailprice, round(p_size * p_retailprice, 4) as p_size_x_p_retailprice, p_name, p_brand, p_type from part""")
def f25(spark, d):
    """All that the selection leaves, by the names it has."""
    out, _ = jobs.engineer_features(table(spark, d, "part"))
    return rounded(out, "p_partkey_x_p_retailprice", "p_size_x_p_retailprice", digits=4)


@query("f25_feature_report")
def f25_report(spark, d):
    return jobs.engineer_features(table(spark, d, "orders"), {"feature_selection_method": "correlation"})[1]


F26_SQL = f"""with c as (select o_orderkey, o_custkey, coalesce(price, (select median(price) from ({GAPPY}))) as price, coalesce(priority, {MODES['priority']}) as priority, coalesce(status, {MODES['status']}) as status,
      (select strftime(o.o_orderdate, '%Y-%m-%d') from orders o where o.o_orderkey = g.o_orderkey) as day from ({GAPPY}) g)
    select o_orderkey, o_custkey, round((price - avg(price) over ()) / stddev_samp(price) over (), 6) + 0 as price, status, year(day::date) as day_year, month(day::date) as day_month, day(day::date) as day_day,
      isodow(day::date) - 1 as day_dow, quarter(day::date) as day_quarter, {", ".join(f"(lower(priority) = '{v}')::int as \"priority_{v}\"" for v in LEVELS)} from c"""


def transform_input(spark, d):
    days = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias(" Day! "))
    return gappy_orders(spark, d).withColumnRenamed("price", "Price ").join(days, "o_orderkey")


@query("f26_transform_table", F26_SQL)
def f26(spark, d):
    out = jobs.transform_table(transform_input(spark, d), normalize_cols=["price"], date_col="day", categorical_cols=["priority"])
    return rounded(out.drop("day"), "price")


@query("f26_profile", """with b as (select 'country ' || c_nationkey as country, year(o_orderdate) as year, o_totalprice as value, c_mktsegment as indicator, o_orderkey from orders join customer on o_custkey = c_custkey),
    f as (select * from (select *, row_number() over (partition by country, year order by o_orderkey) as rn from b) where rn = 1)
    select country, year, round((value - avg(value) over ()) / stddev_samp(value) over (), 6) + 0 as value, o_orderkey, (indicator = 'AUTOMOBILE')::int as indicator_automobile, (indicator = 'BUILDING')::int as indicator_building,
      (indicator = 'FURNITURE')::int as indicator_furniture, (indicator = 'HOUSEHOLD')::int as indicator_household, (indicator = 'MACHINERY')::int as indicator_machinery from f""")
def f26_profile(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = o.select(F.concat(F.lit("country "), "c_nationkey").alias("Country"), F.year("o_orderdate").alias("Year"), F.col("o_totalprice").alias("Value"), F.col("c_mktsegment").alias("Indicator"), "o_orderkey")
    return rounded(jobs.transform_with_profile(df, "economic_indicators", dedup_order=["o_orderkey"]), "value")
