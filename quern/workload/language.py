"""Date, number, list and text function queries."""

from pyspark.sql import functions as F

from quern.core import explode_rows
from quern.core import read_table as table
from quern.core import spread
from quern.functions import dates, lists, nlu, numeric, text
from quern.operators import sets
from quern.workload.registry import query
from quern.workload.statistics import rounded


def texts(spark, d, *cols):
    """The documents, dealt out to all cores."""
    return spread(table(spark, d, "documents", *cols))


def sql_list(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


# Order dates as text, some of them not dates.
DAY_TEXT = "(select o_orderkey, case when o_orderkey % 10 = 0 then 'n/a' else strftime(o_orderdate, '%Y-%m-%d') end as day from orders)"


def day_texts(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("x01_calendar_parts", f"""select o_orderkey, year(t) as day_year, month(t) as day_month, day(t) as day_day, isodow(t) - 1 as day_dow, quarter(t) as day_quarter
    from (select o_orderkey, try_cast(day as timestamp) as t from {DAY_TEXT})""")
def x01(spark, d):
    parts = dates.calendar_parts(dates.to_time(F.col("day")), "day")
    return day_texts(spark, d).select("o_orderkey", *[e.alias(n) for n, e in parts.items()])


@query("x02_extended_parts", """select event_id, year(ts) as ts_year, month(ts) as ts_month, day(ts) as ts_day, isodow(ts) - 1 as ts_day_of_week, quarter(ts) as ts_quarter,
    (isodow(ts) >= 6)::int as ts_is_weekend, dayofyear(ts) as ts_day_of_year, weekofyear(ts) as ts_week_of_year, hour(ts) as ts_hour, minute(ts) as ts_minute, second(ts) as ts_second from events""")
def x02(spark, d):
    parts = dates.extended_parts(F.col("ts"), "ts")
    return table(spark, d, "events").select("event_id", *[e.alias(n) for n, e in parts.items()])


@query("x03_date_names", f"""select o_orderkey, strftime(t, '%Y-%m-%d') as day_date, monthname(t) as day_month_name, dayname(t) as day_day_name, (t is null)::int as day_missing
    from (select o_orderkey, try_cast(day as timestamp) as t from {DAY_TEXT})""")
def x03(spark, d):
    parts = dates.names(dates.to_time(F.col("day")), "day")
    out = day_texts(spark, d).select("o_orderkey", *[e.alias(n) for n, e in parts.items()])
    return out.withColumn("day_date", F.date_format("day_date", "yyyy-MM-dd"))


@query("x04_pattern_time", "select event_id, case when event_id % 8 = 0 then null else strftime(ts, '%Y-%m-%d %H:%M') end as parsed from events")
def x04(spark, d):
    raw = F.when(F.col("event_id") % 8 == 0, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm"))
    e = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", F.date_format(dates.to_time(F.col("raw"), "dd-MM-yyyy HH:mm"), "yyyy-MM-dd HH:mm").alias("parsed"))


@query("x05_day_period", """select event_id, case when h between 5 and 11 then 'Morning' when h between 12 and 16 then 'Afternoon' when h between 17 and 20 then 'Evening'
    when h between 21 and 23 then 'Night' else 'Late Night' end as time_period, (h between 7 and 10)::int as is_morning_peak, (h between 17 and 20)::int as is_evening_peak,
    (h between 7 and 10 or h between 17 and 20)::int as is_peak_hour, (not (h between 7 and 10 or h between 17 and 20))::int as is_off_peak_hour
    from (select event_id, hour(ts) as h from events)""")
def x05(spark, d):
    parts = dates.day_period(F.hour("ts"))
    return table(spark, d, "events").select("event_id", *[e.alias(n) for n, e in parts.items()])


@query("x06_threshold_category", """select p_partkey, case when p_size < 20 then 'Very Slow' when p_size <= 40 then 'Slow' when p_size <= 60 then 'Moderate' else 'Fast' end as speed,
    case when p_size * 2 < 25 then 'Low Occupancy' when p_size * 2 <= 50 then 'Moderate Occupancy' when p_size * 2 <= 75 then 'High Occupancy' else 'Very High Occupancy' end as occupancy from part""")
def x06(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", numeric.threshold_category(size, *numeric.SPEED_EDGES).alias("speed"), numeric.threshold_category(size * 2, *numeric.OCCUPANCY_EDGES).alias("occupancy"))


@query("x07_median_category", """select p_partkey, case when p_retailprice < (select median(p_retailprice) from part) then 'Below Median' else 'At or Above Median' end as category from part""")
def x07(spark, d):
    return numeric.median_category(table(spark, d, "part"), "p_retailprice", "Below Median", "At or Above Median", "category").select("p_partkey", "category")


@query("x08_safe_ratio", """select l_orderkey, l_linenumber, l_partkey, round(case when l_discount > 0 then l_tax / l_discount * 100 end, 6) as ratio,
    round(case when l_tax <> 0 then l_extendedprice / l_tax end, 2) as per_tax from lineitem""")
def x08(spark, d):
    ratio = numeric.safe_ratio(F.col("l_tax"), F.col("l_discount"), 100)
    per_tax = numeric.safe_ratio(F.col("l_extendedprice"), F.col("l_tax"), positive=False)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(ratio, 6).alias("ratio"), F.round(per_tax, 2).alias("per_tax"))


@query("x09_joint_risk", """with m as (select median(p_size) a, median(p_retailprice) b from part) select p_partkey, (p_size >= a)::int as high_flag, (p_retailprice < b)::int as low_flag,
    (p_size >= a and p_retailprice < b)::int as risk_flag from part, m""")
def x09(spark, d):
    return numeric.joint_risk(table(spark, d, "part"), "p_size", "p_retailprice").select("p_partkey", "high_flag", "low_flag", "risk_flag")


# Part names as list literals, comma lists, single values and blanks.
LIST_TEXT = """(select p_partkey, case p_partkey % 4 when 0 then '[''' || replace(p_name, ' ', ''', ''') || ''']' when 1 then replace(p_name, ' ', ', ') when 2 then p_name else '  ' end as raw,
    case p_partkey % 4 when 0 then string_split(p_name, ' ') when 1 then string_split(p_name, ' ') when 2 then [p_name] else []::varchar[] end as items from part)"""


def list_texts(spark, d):
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    literal = F.concat(F.lit("['"), F.replace(name, F.lit(" "), F.lit("', '")), F.lit("']"))
    raw = F.when(kind == 0, literal).when(kind == 1, F.replace(name, F.lit(" "), F.lit(", "))).when(kind == 2, name).otherwise("  ")
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", raw.alias("raw"))


@query("x10_parse_list", f"select p_partkey, array_to_string(items, '|') as items, len(items) as n from {LIST_TEXT}")
def x10(spark, d):
    items = lists.parse_list(F.col("raw"))
    return list_texts(spark, d).select("p_partkey", F.array_join(items, "|").alias("items"), F.size(items).alias("n"))


@query("x11_list_features", f"""select p_partkey, len(items) as items, coalesce(items[1], 'Unknown') as first_item, length(array_to_string(items, ', ')) as joined_length, (len(items) > 1)::int as several from {LIST_TEXT}""")
def x11(spark, d):
    parts = lists.list_features(lists.parse_list(F.col("raw")))
    return list_texts(spark, d).select("p_partkey", *[e.alias(n) for n, e in parts.items()])


@query("x12_first_label", f"select p_partkey, coalesce(items[1], raw) as label from {LIST_TEXT}")
def x12(spark, d):
    return list_texts(spark, d).select("p_partkey", lists.first_label(F.col("raw")).alias("label"))


NUM_TEXT = """(select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then 'n/a' when 2 then 'about ' || l_quantity::int || ' units' when 3 then l_quantity::int || ',000'
    when 4 then l_quantity::int || '.25%' when 5 then 'none' when 6 then '-' || l_quantity::int || 'e-1' else 'no digits' end as raw from lineitem)"""


def number_texts(spark, d):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    raw = (F.when(n == 1, "n/a").when(n == 2, F.concat(F.lit("about "), q, F.lit(" units"))).when(n == 3, F.concat(q, F.lit(",000")))
           .when(n == 4, F.concat(q, F.lit(".25%"))).when(n == 5, "none").when(n == 6, F.concat(F.lit("-"), q, F.lit("e-1"))).otherwise("no digits"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))


@query("x13_number_in_text", f"""select l_orderkey, l_linenumber, l_partkey, case when lower(trim(raw)) not in ('nan', 'none', 'null', 'na', 'n/a') then
    try_cast(nullif(regexp_extract(regexp_replace(raw, '[,%]', '', 'g'), '[-+]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?'), '') as double) end as number from {NUM_TEXT}""")
def x13(spark, d):
    return number_texts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", numeric.number_in_text(F.col("raw")).alias("number"))


@query("x14_metric_names", """select p_partkey, case p_size % 8 when 0 then 'R2' when 1 then 'MAE' when 2 then 'RMSE' when 3 then 'Accuracy' when 4 then 'F1_Score' when 5 then 'Precision' when 6 then 'Recall' end as metric from part""")
def x14(spark, d):
    spell = F.element_at(F.array(*[F.lit(x) for x in ("R-Squared", " MAE ", "Root Mean Squared Error", "Accuracy %", "Macro F1", "precision score", "RECALL", "loss")]), F.col("p_size") % 8 + 1)
    return table(spark, d, "part").select("p_partkey", numeric.metric_name(spell).alias("metric"))


@query("x16_text_flags", """select doc_id, (contains(text, '?'))::int as question, (contains(text, '-'))::int as hyphen,
    (contains(lower(text), 'method') or contains(lower(text), 'model') or contains(lower(text), 'the'))::int as keyword from documents""")
def x16(spark, d):
    t = F.col("text")
    return texts(spark, d).select(
        "doc_id", text.contains_any(t, "?").alias("question"), text.contains_any(t, "-").alias("hyphen"), text.contains_any(t, "method", "model", "the").alias("keyword"))


@query("x17_cell_lengths", "select conv_id, turn, length(coalesce(text, '')) as text_length, length(conv_id::varchar) as id_length, (role = 'system')::int as role_missing from conversations")
def x17(spark, d):
    role = F.when(F.col("role") != "system", F.col("role"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("text_length"), F.length(F.col("conv_id").cast("string")).alias("id_length"), role.isNull().cast("int").alias("role_missing"))


# SQL spellings of the Unicode word class and of whitespace.
W = r"\p{L}\p{M}\p{N}_"
_CLEAN = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(<c>, 'https?://\S+|www\.\S+', ' ', 'g'), '[^{W}\s]', ' ', 'g'), '\s+', ' ', 'g')))"



def clean_sql(c):
    return _CLEAN.replace("<c>", c)


@query("x20_clean_text", f"select doc_id, md5({clean_sql('text')}) as cleaned from documents")
def x20(spark, d):
    return texts(spark, d).select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query("x20_clean_pages", f"select page_id, md5({clean_sql('html')}) as cleaned from pages")
def x20_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.clean_text(F.col("html"))).alias("cleaned"))


NOISY = "(select doc_id, '  ' || replace(replace(text, ' ', '  '), chr(10), ' ' || chr(13) || chr(10) || chr(10) || chr(10) || ' ') || chr(7) || chr(9) || chr(9) || 'end ' as raw from documents)"
CLEAN_DOC = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\r\n|\r', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\t+', chr(9), 'g'), '\n +', chr(10), 'g'), ' +\n', chr(10), 'g'))"


@query("x21_clean_document", f"select doc_id, md5({CLEAN_DOC}) as cleaned from {NOISY}")
def x21(spark, d):
    breaks = F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \r\n\n\n "))
    raw = F.concat(F.lit("  "), breaks, F.lit("\x07\t\tend "))
    docs = texts(spark, d).select("doc_id", raw.alias("raw"))
    return text.clean_documents(docs, "raw").select("doc_id", F.md5("raw").alias("cleaned"))


@query("x22_clean_ascii", r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) as cleaned from documents")
def x22(spark, d):
    return texts(spark, d).select("doc_id", F.md5(text.clean_ascii(F.col("text"))).alias("cleaned"))


def split_sql(c):
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


@query("x23_text_features", f"""select doc_id, length(text) as text_length, len({split_sql('text')}) as text_word_count, len(list_distinct({split_sql('text')})) as text_unique_word_count from documents""")
def x23(spark, d):
    return texts(spark, d).select("doc_id", *[e.alias(n) for n, e in text.text_features(F.col("text"), "text").items()])


@query("x24_word_and_sentence_counts", f"""select doc_id, n as words, s as sentences, round(case when n > 0 then length(text) / n else 0 end, 6) as mean_length from
    (select doc_id, text, len(regexp_extract_all(text, '[{W}]+')) as n, len(regexp_extract_all(text, '[.!?]+')) as s from documents)""")
def x24(spark, d):
    t = F.col("text")
    return texts(spark, d).select("doc_id", text.regex_words(t).alias("words"), text.sentence_marks(t).alias("sentences"), F.round(text.mean_word_length(t), 6).alias("mean_length"))


@query("x25_prompt_stats", rf"""select conv_id, turn, length(text) as characters, len({split_sql('text')}) as words, len(regexp_extract_all(text, '\n')) + 1 as lines,
    length(replace(replace(text, ' ', ''), chr(10), '')) as dense from conversations""")
def x25(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", *[e.alias(n) for n, e in text.prompt_stats(t).items()], text.dense_characters(t).alias("dense"))


# Part names and sizes as short reports with lexicon words.
MOOD = """(select p_partkey, p_name || case p_size % 5 when 0 then ': strong growth, no risk!' when 1 then ': Poor result - loss and delay' when 2 then ': good and bad' when 3 then ': record profit (great)' else ': as usual' end as note from part)"""


def notes(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (": strong growth, no risk!", ": Poor result - loss and delay", ": good and bad", ": record profit (great)", ": as usual")]), F.col("p_size") % 5 + 1)
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", tail).alias("note"))


@query("x26_sentiment", f"""select p_partkey, case when s > 0.15 then 'Positive' when s < -0.15 then 'Negative' else 'Neutral' end as label, round(s, 3) as score from
    (select p_partkey, coalesce((p - n) / nullif(p + n, 0), 0) as s from (select p_partkey, len(list_filter(t, lambda w: list_contains({sql_list(text.POSITIVE_WORDS)}, w))) as p,
     len(list_filter(t, lambda w: list_contains({sql_list(text.NEGATIVE_WORDS)}, w))) as n from (select p_partkey, string_split({clean_sql('note')}, ' ') as t from {MOOD})))""")
def x26(spark, d):
    return notes(spark, d).select("p_partkey", text.sentiment(F.col("note")).alias("s")).select("p_partkey", "s.label", "s.score")


PLAIN = r"regexp_replace(text, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g')"
MARKED = "(select doc_id, text || ' Acme Corp paid ₹ ' || n_chars || ' crore and €5.' || (n_chars % 10) || ' million, up ' || (n_chars % 100) || '.5 % since ' || (1990 + n_chars % 60) || ' or 3/' || (1 + n_chars % 28) || '/2024' as text from documents)"


def entity_sql(c, p):
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({c}, '{p}'), lambda x: trim(x)), lambda x: x <> ''))), '|')"



def marked_documents(spark, d):
    """Whole documents with a money, percent and date passage of their own at the end."""
    n = F.col("n_chars")
    tail = F.concat(
        F.lit(" Acme Corp paid ₹ "), n.cast("string"), F.lit(" crore and €5."), (n % 10).cast("string"), F.lit(" million, up "), (n % 100).cast("string"),
        F.lit(".5 % since "), (F.lit(1990) + n % 60).cast("string"), F.lit(" or 3/"), (F.lit(1) + n % 28).cast("string"), F.lit("/2024"))
    return texts(spark, d).select("doc_id", F.concat("text", tail).alias("text"))


@query("x27_entities", rf"""select doc_id, md5({entity_sql(PLAIN, r'\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b')}) as names,
    {entity_sql('text', r'(?i)[₹$€£]\s?\d[\d,]*(?:\.\d+)?\s?(?:crore|lakh|million|billion|trillion)?')} as money,
    {entity_sql('text', r'\d+(?:\.\d+)?\s?%')} as percents, {entity_sql(PLAIN, r'\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:19|20)\d{2}\b')} as dates from {MARKED}""")
def x27(spark, d):
    e = marked_documents(spark, d).select("doc_id", text.entities(F.col("text")).alias("e"))

    def spans(label):
        return F.array_join(F.coalesce(F.try_element_at("e", F.lit(label)), F.array().cast("array<string>")), "|")

    return e.select("doc_id", F.md5(spans("PERSON_OR_ORG")).alias("names"), spans("MONEY").alias("money"), spans("PERCENT").alias("percents"), spans("DATE").alias("dates"))


# One question per order, its kind chosen by the order priority.
LOC = f"({sql_list(nlu.KNOWN_LOCATIONS)})[1 + o_orderkey % {len(nlu.KNOWN_LOCATIONS)}]"
MET = f"({sql_list(nlu.KNOWN_METRICS)})[1 + o_custkey % {len(nlu.KNOWN_METRICS)}]"
QUESTIONS = f"""(select o_orderkey, case o_orderpriority
    when '1-URGENT' then 'Predict default for a ' || (18 + o_custkey % 60) || '-year-old with income $' || (o_totalprice::bigint // 1000) || ',500, credit score ' || (300 + o_custkey % 550)
        || ', loan amount ' || (o_totalprice::bigint // 10) || ', employed for ' || (o_orderkey % 30) || ' years on ' || strftime(o_orderdate, '%Y-%m-%d')
    when '2-HIGH' then 'Show the district boundary map of ' || upper({LOC}) || ' and rangareddy'
    when '3-MEDIUM' then 'Give ' || {MET} || ' statistics of ' || {LOC} || ' in ' || (2010 + o_orderkey % 30)
    when '4-NOT SPECIFIED' then 'Explain how credit risk is handled, please'
    else case when o_orderkey % 2 = 0 then '  ' else 'random noise ' || o_orderstatus end end as q from orders)"""


def questions(spark, d):
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")

    def pick(items, index):
        return F.element_at(F.array(*[F.lit(x) for x in items]), (index % len(items) + 1).cast("int"))

    s = lambda c: c.cast("string")
    whole = F.round(price, 0).cast("bigint")
    predict = F.concat(
        F.lit("Predict default for a "), s(F.lit(18) + cust % 60), F.lit("-year-old with income $"), s(F.floor(whole / 1000)), F.lit(",500, credit score "), s(F.lit(300) + cust % 550),
        F.lit(", loan amount "), s(F.floor(whole / 10)), F.lit(", employed for "), s(key % 30), F.lit(" years on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    view = F.concat(F.lit("Show the district boundary map of "), F.upper(pick(nlu.KNOWN_LOCATIONS, key)), F.lit(" and rangareddy"))
    metric = F.concat(F.lit("Give "), pick(nlu.KNOWN_METRICS, cust), F.lit(" statistics of "), pick(nlu.KNOWN_LOCATIONS, key), F.lit(" in "), s(F.lit(2010) + key % 30))
    other = F.when(key % 2 == 0, "  ").otherwise(F.concat(F.lit("random noise "), "o_orderstatus"))
    kind = F.col("o_orderpriority")
    q = F.when(kind == "1-URGENT", predict).when(kind == "2-HIGH", view).when(kind == "3-MEDIUM", metric).when(kind == "4-NOT SPECIFIED", "Explain how credit risk is handled, please").otherwise(other)
    return spread(table(spark, d, "orders")).select("o_orderkey", q.alias("q"))


def first_sql(p, groups, flags="low"):
    parts = ", ".join(f"nullif(regexp_extract({flags}, '{p}', {g}), '')" for g in range(1, groups + 1))
    return f"try_cast(replace(coalesce({parts}), ',', '') as double)"


FEATS = ", ".join(f"{first_sql(p, g)} as {n}" for n, (p, g) in nlu.ATTRIBUTE_PATTERNS.items())
ENTITY_SQL = rf"""(select o_orderkey, q, list_transform(list_sort(list_filter({sql_list(nlu.KNOWN_LOCATIONS)}, lambda p: regexp_matches(low, '\b' || p || '\b'))),
      lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) as locations,
    list_sort(list_filter({sql_list(nlu.KNOWN_METRICS)}, lambda p: regexp_matches(low, '\b' || p || '\b'))) as metrics,
    list_sort(list_distinct(list_concat(regexp_extract_all(q, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), regexp_extract_all(q, '\b20[1-3][0-9]\b')))) as dates, {FEATS}
    from (select o_orderkey, q, lower(trim(q)) as low from {QUESTIONS}))"""


@query("x28_domain_entities", f"select o_orderkey, array_to_string(locations, '|') as locations, array_to_string(metrics, '|') as metrics, array_to_string(dates, '|') as dates, age, income, credit_score, loan_amount, years_employed from {ENTITY_SQL}")
def x28(spark, d):
    e = questions(spark, d).select("o_orderkey", nlu.domain_entities(F.col("q")).alias("e"))
    return e.select("o_orderkey", *[F.array_join(f"e.{n}", "|").alias(n) for n in ("locations", "metrics", "dates")], "e.features.*")


INTENT_CASE = " ".join("when " + " or ".join(f"contains(lower(q), '{k}')" for k in ks) + f" then '{label}'" for label, _, ks in nlu.INTENT_RULES)
CONF_CASE = " ".join(f"when '{label}' then {conf}" for label, conf, _ in nlu.INTENT_RULES)
INTENT_SQL = f"(select *, case when trim(q) = '' then 'UNKNOWN_INTENT' {INTENT_CASE} else 'UNKNOWN_INTENT' end as intent from {ENTITY_SQL})"


@query("x29_intent", f"""select o_orderkey, intent, case when trim(q) = '' then 0 else case intent {CONF_CASE} else 0.3 end end as confidence,
    case intent when 'GIS_VIEW' then 'gis' when 'PREDICTION' then 'ml' when 'DATA_METRIC' then 'rag' when 'FAQ' then 'rag' else 'unknown' end as route from {INTENT_SQL}""")
def x29(spark, d):
    return questions(spark, d).select("o_orderkey", nlu.intent(F.col("q")).alias("i")).select("o_orderkey", "i.*")


@query("x30_structured_request", f"""select o_orderkey, case intent when 'GIS_VIEW' then 'GIS_SPATIAL_SERVICE' when 'PREDICTION' then 'ML_INFERENCE_SERVICE' when 'DATA_METRIC' then 'BACKEND_DATA_SERVICE'
      when 'FAQ' then 'RAG_KNOWLEDGE_SERVICE' else 'FALLBACK_HANDLER' end as service,
    case intent when 'GIS_VIEW' then case when len(locations) > 0 then '/api/v1/spatial/query' else '/api/v1/spatial/boundaries/1' end when 'PREDICTION' then '/predict' when 'DATA_METRIC' then '/process' when 'FAQ' then '/api/v1/ai/query' end as endpoint,
    case when intent = 'GIS_VIEW' then locations[1] end as place, case when intent = 'PREDICTION' then coalesce(income, 50000) end as income,
    case when intent = 'PREDICTION' then coalesce(dates[1], '2026-09-21') end as application_date, case when intent = 'DATA_METRIC' then metrics[1] end as metric, case when intent = 'FAQ' then q end as faq from {INTENT_SQL}""")
def x30(spark, d):
    q = questions(spark, d).withColumns({"i": nlu.intent(F.col("q")), "e": nlu.domain_entities(F.col("q"))})
    r = q.select("o_orderkey", nlu.structured_request(F.col("q"), F.col("i.intent"), F.col("e")).alias("r"))
    at = lambda path: F.get_json_object("r", path)
    body = "$.request_schema"
    return r.select(
        "o_orderkey", at("$.target_service").alias("service"), at(f"{body}.endpoint").alias("endpoint"), at(f"{body}.params.q").alias("place"),
        at(f"{body}.payload.income").cast("double").alias("income"), at(f"{body}.payload.application_date").alias("application_date"),
        at(f"{body}.payload.filters.metrics[0]").alias("metric"), at(f"{body}.payload.query").alias("faq"))


WORD_CASE = " ".join("when " + " or ".join(f"contains(low, '{s}')" for s in ss) + f" then '{v}'" for ss, v in nlu.CATEGORY_WORDS)
ANY = r"try_cast(replace(regexp_extract_all(q, '\b\d{1,3}(?:,\d{3})*\b')[1], ',', '') as double)"


FIELDS_SQL = rf"""(select o_orderkey, coalesce({first_sql(nlu.FIELD_PATTERNS['age'], 1)}, {ANY}) as age, coalesce({first_sql(nlu.FIELD_PATTERNS['income'], 1)}, {ANY}) as income,
    try_cast(nullif(regexp_extract(q, '\b\d{{3}}\b'), '') as double) as credit_score, coalesce({first_sql(nlu.FIELD_PATTERNS['loan_amount'], 1)}, {ANY}) as loan_amount,
    coalesce({first_sql(nlu.FIELD_PATTERNS['years_employed'], 1)}, {ANY}) as years_employed, case {WORD_CASE} end as education from (select o_orderkey, q, lower(q) as low from {QUESTIONS}))"""


TEXT_SQL = ", ".join(f"education as {n}" for n in nlu.TEXT_FIELDS[1:])


@query("x31_applicant_fields", f"select *, {TEXT_SQL} from {FIELDS_SQL}")
def x31(spark, d):
    return questions(spark, d).select("o_orderkey", nlu.applicant_fields(F.col("q")).alias("f")).select("o_orderkey", "f.*")


FILLED_SQL = ", ".join([*[f"coalesce({n}, 0) as {n}" for n in nlu.NUMBER_FIELDS], *[f"coalesce(education, '{nlu.REQUEST_TEXTS.get(n, '2026-09-21')}') as {n}" for n in nlu.TEXT_FIELDS]])


@query("x31_missing_fields", f"""select o_orderkey, (age is null)::int + (income is null)::int + (credit_score is null)::int + (loan_amount is null)::int + (years_employed is null)::int + 5 * (education is null)::int as n_missing,
    {FILLED_SQL} from {FIELDS_SQL}""")
def x31_missing(spark, d):
    f = questions(spark, d).select("o_orderkey", nlu.applicant_fields(F.col("q")).alias("f"))
    g = f.withColumn("g", nlu.filled_fields(F.col("f"), F.lit("2026-09-21")))
    return g.select("o_orderkey", F.size(nlu.missing_fields(F.col("f"))).alias("n_missing"), "g.*")


X32_SQL = r"""with recursive p as (
    select conv_id, turn, list_filter(regexp_split_to_array(lower(before), '\s+'), lambda x: x <> '') as r, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as h
    from (select conv_id, turn, coalesce(text, '') as text, lag(text) over (partition by conv_id order by turn) as before from conversations) where before is not null),
s as (
    select conv_id, turn, r, h, 0 as i, range(0, len(h) + 1) as d from p
    union all
    select conv_id, turn, r, h, i + 1, list_transform(b, lambda x, j: list_min(list_transform(b[1:j], lambda y, k: y + j - k)))
    from (select *, list_prepend((i + 1)::bigint, list_transform(h, lambda w, j: least(d[j] + (w <> r[i + 1])::bigint, d[j + 1] + 1))) as b from s where i < len(r)))
select conv_id, turn, round(case when len(r) > 0 then d[len(h) + 1]::double / len(r) when len(h) > 0 then 1.0 else 0.0 end, 6)::double as wer from s where i = len(r)"""


@query("x32_word_error_rate", X32_SQL)
def x32(spark, d):
    """Every answer against the turn before it."""
    from quern.operators import ordered

    turns = ordered.previous(table(spark, d, "conversations"), ["conv_id"], ["turn"], {"before": "text"}).where("before is not null")
    return turns.select("conv_id", "turn", F.round(text.word_error_rate(F.col("before"), F.col("text")), 6).alias("wer"))


NORMAL = rf"list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '\p{{Nd}}+', '', 'g'), '[[:punct:]]', '', 'g'), '\s+'), lambda w: w <> '' and not list_contains({sql_list(text.ENGLISH_STOPS)}, w))"


@query("x33_normal_tokens", f"select doc_id, len(t) as tokens, md5(array_to_string(t, ' ')) as joined from (select doc_id, {NORMAL} as t from documents)")
def x33(spark, d):
    t = texts(spark, d).select("doc_id", text.normal_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ")).alias("joined"))


@query("a27_token_reduction", rf"""select sum(b)::bigint as original_tokens, sum(a)::bigint as processed_tokens, sum(b - a)::bigint as removed_tokens, round(avg(round((b - a) * 100.0 / nullif(b, 0), 2)), 6) as mean_reduction
    from (select len(regexp_extract_all(text, '[{W}]+|[^{W}\s]')) as b, len({NORMAL}) as a from documents)""")
def a27(spark, d):
    parts = texts(spark, d).select(*[e.alias(n) for n, e in text.token_reduction(F.col("text")).items()])
    return parts.agg(F.sum("original_tokens").alias("original_tokens"), F.sum("processed_tokens").alias("processed_tokens"), F.sum("removed_tokens").alias("removed_tokens"), F.round(F.avg("reduction_percent"), 6).alias("mean_reduction"))


@query("x34_sentences", r"""select doc_id, len(s) as sentences, md5(array_to_string(s, '|')) as joined from (select doc_id,
    list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as s from documents)""")
def x34(spark, d):
    s = texts(spark, d).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|")).alias("joined"))


LOGS = "(select l_suppkey, 'Run done. R2 : 0.' || count(*) || chr(10) || 'mean_absolute_error= ' || sum(l_linenumber) || '.5; RMSE=' || max(l_quantity)::int || ' accuracy_score: .' || count(*) as log from lineitem group by 1)"


def logs(spark, d):
    s = lambda c: c.cast("string")
    n = s(F.count("*"))
    log = F.concat(F.lit("Run done. R2 : 0."), n, F.lit("\nmean_absolute_error= "), s(F.sum("l_linenumber")), F.lit(".5; RMSE="), s(F.max("l_quantity").cast("int")), F.lit(" accuracy_score: ."), n)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(log.alias("log"))


@query("x35_log_metrics", f"""select l_suppkey, try_cast(regexp_extract(low, '\\br2(?:_score)?\\b\\s*[:=]\\s*([-+]?\\d*\\.?\\d+)', 1) as double) as "R2", try_cast(regexp_extract(low, 'mean_absolute_error\\s*[:=]\\s*([-+]?\\d*\\.?\\d+)', 1) as double) as "MAE",
    try_cast(regexp_extract(low, '\\brmse\\b\\s*[:=]\\s*([-+]?\\d*\\.?\\d+)', 1) as double) as "RMSE", try_cast(regexp_extract(low, '\\baccuracy(?:_score)?\\b\\s*[:=]\\s*([-+]?\\d*\\.?\\d+)', 1) as double) as "Accuracy",
    null::double as "Precision", null::double as "Recall", null::double as "F1_Score" from (select l_suppkey, lower(log) as low from {LOGS})""")
def x35(spark, d):
    return logs(spark, d).select("l_suppkey", *[e.alias(n) for n, e in numeric.metrics_in_log(F.col("log")).items()])


@query("x36_dataset_tag", """select page_id, case when page_id % 4 = 0 then 'Smart City Intelligence' when page_id % 4 = 1 then 'Market Analysis' when page_id % 4 = 2 then 'Research Intelligence' end as dataset,
    case when page_id % 4 in (0, 2) then 'Classification' when page_id % 4 = 1 then 'Regression' end as task, page_id % 4 <> 2 as is_result from pages""")
def x36(spark, d):
    names = ["out/Smart City/final report.csv", "market-analysis/smart/Metrics.json", "Research Intelligence results/notes.txt", "misc/other/score.log"]
    path = F.concat(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 4 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", *[e.alias(n) for n, e in numeric.dataset_tag(path).items()], numeric.is_result_file(path).alias("is_result"))


KEY_SQL = r"regexp_replace(regexp_replace(replace(lower(trim({c})), '%', 'percent'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
TAG_SQL = [" ".join(f"when contains(k, '{w}') then '{v[i]}'" for w, v in numeric.DATASET_TAGS.items()) for i in (0, 1)]


@query("x36_page_dataset_tag", f"""select page_id, case {TAG_SQL[0]} end as dataset, case {TAG_SQL[1]} end as task, {" or ".join(f"contains(n, '{w}')" for w in numeric.RESULT_WORDS)} as is_result
    from (select page_id, {KEY_SQL.format(c='url')} as k, {KEY_SQL.format(c="string_split(url, '/')[-1]")} as n from pages)""")
def x36_pages(spark, d):
    """The tags of the pages' own paths."""
    path = F.col("url")
    return table(spark, d, "pages").select("page_id", *[e.alias(n) for n, e in numeric.dataset_tag(path).items()], numeric.is_result_file(path).alias("is_result"))


@query("x37_metric_pairs", f"""with r as (select l_orderkey, l_linenumber * 10000000000 + round(l_extendedprice * 100)::bigint as pos, case l_linenumber % 3 when 0 then 'MAE' when 1 then 'R2' end as metric, l_quantity::double / 100 as value from lineitem)
    select l_orderkey, metric, arg_max(value, pos) as value from r where metric is not null group by 1, 2""")
def x37(spark, d):
    n = F.col("l_linenumber")
    label = F.when(n % 3 == 0, "Mean Absolute Error").when(n % 3 == 1, "r2 score").otherwise("loss")
    rows = table(spark, d, "lineitem").select("l_orderkey", label.alias("name"), F.concat((F.col("l_quantity") / 100).cast("string"), F.lit(" %")).alias("raw"), (n * F.lit(10_000_000_000) + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("at"))
    return numeric.metrics_from_pairs(rows, ["l_orderkey"], "name", "raw", "at")


@query("x37_metric_columns", """select l_suppkey, 'MAE' as metric, arg_min(l_tax, l_orderkey * 100000 + l_partkey) as value from lineitem where l_tax > 0.01 group by 1
    union all select l_suppkey, 'F1_Score', arg_min(l_discount, l_orderkey * 100000 + l_partkey) from lineitem group by 1""")
def x37_columns(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("at"),
        F.when(F.col("l_tax") > 0.01, F.col("l_tax").cast("string")).otherwise("n/a").alias("mae"), F.col("l_discount").alias("Macro F1"), F.col("l_quantity").alias("epochs"))
    return numeric.metrics_from_columns(rows, ["l_suppkey"], "at")


@query("k04_top_keywords", f"""select doc_id, word, n, rank from (select doc_id, word, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, min(pos)) as rank
    from (select doc_id, unnest(t) as word, generate_subscripts(t, 1) as pos from (select doc_id, list_filter(string_split({clean_sql('text')}, ' '), lambda w: length(w) > 2 and not list_contains({sql_list(text.KEYWORD_STOPS)}, w)) as t from documents)) group by 1, 2) where rank <= 10""")
def k04(spark, d):
    # Dealt by document once, so neither the counts nor the ranks move the words.
    docs = table(spark, d, "documents", "doc_id", "text").repartition("doc_id")
    tokens = explode_rows(docs, ["doc_id"], text.keyword_tokens(F.col("text")), "word", "pos")
    counts = tokens.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return sets.top_per_group(counts, ["doc_id"], [F.desc("n"), F.col("first_pos")], 10).drop("first_pos")
