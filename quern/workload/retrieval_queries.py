"""Term, vector, chunk and retrieval queries."""

from pyspark.sql import functions as F

from quern.core import describe_rows, scratch_dir
from quern.core import read_table as table
from quern.functions import nlu, text
from quern.operators import chunks, ordered, retrieval, terms, vectors
from quern.plans import knowledge
from quern.workload.language import W, sql_list, texts
from quern.workload.registry import query
from quern.workload.statistics import rounded

# ---- term tables ----------------------------------------------------------------------


def tokens_sql(stops=()):
    found = f"list_filter(regexp_extract_all(lower(text), '[{W}]+'), lambda w: length(w) > 1)"
    return f"list_filter({found}, lambda w: not list_contains({sql_list(stops)}, w))" if stops else found


COUNTS = f"(select doc_id, term, count(*) as n from (select doc_id, unnest({tokens_sql()}) as term from documents) group by 1, 2)"
RARE = f"(select term, count(*) as df, sum(n) as total from {COUNTS} group by 1 having count(*) between 5 and 0.5 * (select count(*) from documents))"


@query("n01_bag_of_words", f'select doc_id, term, n as "count", df from {COUNTS} join {RARE} using (term)')
def n01(spark, d):
    return terms.bag_of_words(texts(spark, d, "doc_id", "text"), "doc_id", terms.term_tokens(F.col("text")), 5, 0.5)


@query("n02_corpus_frequencies", f'select term, sum(n)::bigint as "count" from {COUNTS} group by 1')
def n02(spark, d):
    return terms.corpus_frequencies(texts(spark, d, "text"), terms.term_tokens(F.col("text")))


def tfidf_sql(rows, tf="n", vocabulary="row_number() over () > 0", having="true"):
    return f"""(with c as {rows}, v as (select term, count(*) df, sum(n) total from c group by 1 having {having} qualify {vocabulary}),
      r as (select c.doc_id, term, {tf} * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as raw from c join v using (term))
      select doc_id, term, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from r)"""


@query("n03_tf_idf", f"select doc_id, term, round(weight, 6) as weight from {tfidf_sql(COUNTS, having='count(*) >= 2')}")
def n03(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return rounded(terms.tf_idf(docs, "doc_id", terms.term_tokens(F.col("text")), min_df=2), "weight")


BIGRAMS = f"""(select doc_id, term, count(*) as n from (select doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])) as term
    from (select doc_id, {tokens_sql(text.ENGLISH_STOPS)} as t from documents)) group by 1, 2)"""


@query("n03_tf_idf_bigrams_sublinear", f"select doc_id, term, round(weight, 6) as weight from {tfidf_sql(BIGRAMS, '(1 + ln(n))', 'row_number() over (order by sum(n) desc, term) <= 2000')}")
def n03_bigrams(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    tokens = terms.term_tokens(F.col("text"), text.ENGLISH_STOPS, bigrams=True)
    return rounded(terms.tf_idf(docs, "doc_id", tokens, max_features=2000, sublinear=True), "weight")


def document_weights(spark, d):
    """With the language of each document."""
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    return terms.tf_idf(docs, "doc_id", terms.term_tokens(F.col("text")), min_df=2, keep=["lang"])


@query("k05_top_terms_per_class", f"""select lang, term, round(weight, 6) as weight, rank from (select lang, term, sum(weight) as weight, row_number() over (partition by lang order by sum(weight) desc, term) as rank
    from {tfidf_sql(COUNTS, having='count(*) >= 2')} join documents using (doc_id) group by 1, 2) where rank <= 30""")
def k05(spark, d):
    return rounded(terms.top_terms(document_weights(spark, d), "lang", 30), "weight")


@query("n04_chi_square", f"""with w as {tfidf_sql(COUNTS, having='count(*) >= 2')}, l as (select doc_id, lang from documents), o as (select term, lang, sum(weight) as o from w join l using (doc_id) group by 1, 2),
    t as (select term, sum(o) as total from o group by 1), c as (select lang, count(*) / (select count(*) from l) as share from l group by 1)
    select term, round(sum(pow(coalesce(o, 0) - total * share, 2) / (total * share)), 6) as chi2 from t cross join c left join o using (term, lang) group by 1""")
def n04(spark, d):
    return rounded(terms.chi_square(document_weights(spark, d), "doc_id", table(spark, d, "documents", "doc_id", "lang"), "lang"), "chi2")


def labelled_texts(spark, d):
    return texts(spark, d, "doc_id", "text").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id").withColumn("label", F.col("quality").cast("string"))


@query("n05_text_naive_bayes")
def n05(spark, d):
    """Fitted on the labelled texts, applied to all."""
    model = terms.train_text_classifier(labelled_texts(spark, d), "text", "label")
    return terms.classify_texts(model, texts(spark, d, "doc_id", "text")).select("doc_id", "predicted", F.round(F.array_max("probability"), 4).alias("probability"))


@query("n06_text_logistic")
def n06(spark, d):
    """Fitted on the labelled texts, applied to all."""
    model = terms.train_text_classifier(labelled_texts(spark, d), "text", "label", "logistic")
    return terms.classify_texts(model, texts(spark, d, "doc_id", "text")).select("doc_id", "predicted", F.round(F.array_max("probability"), 3).alias("probability"))


@query("n06_class_terms")
def n06_terms(spark, d):
    model = terms.train_text_classifier(texts(spark, d, "text", "lang"), "text", "lang", "logistic", features=2000)
    return describe_rows(spark, terms.class_top_terms(model, 30), "label string, term string, coefficient double")


PROBS = "[x / (1 + x + y + z), 1 / (1 + x + y + z), y / (1 + x + y + z), z / (1 + x + y + z)]"


@query("n07_confident_intent", f"""select p_partkey, case when list_max(p) < 0.4 then 'UNKNOWN_INTENT' else (['GIS_VIEW', 'PREDICTION', 'DATA_METRIC', 'FAQ'])[list_position(p, list_max(p))] end as intent
    from (select p_partkey, {PROBS} as p from (select p_partkey, p_size / 20.0 as x, p_retailprice / 1000 as y, length(p_name) / 10.0 as z from part))""")
def n07(spark, d):
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 20).alias("x"), (F.col("p_retailprice") / 1000).alias("y"), (F.length("p_name") / 10).alias("z"))
    total = 1 + F.col("x") + F.col("y") + F.col("z")
    probability = F.array(F.col("x") / total, 1 / total, F.col("y") / total, F.col("z") / total)
    return parts.select("p_partkey", nlu.confident_intent(["GIS_VIEW", "PREDICTION", "DATA_METRIC", "FAQ"], probability).alias("intent"))


def drawn_sql(items, seed):
    return f"({sql_list(items)})[floor(('0x' || substring(md5(item_id || '|' || copy || '|{seed}'), 1, 8))::bigint / 4294967296.0 * 5)::int + 1]"


@query("n08_augment", f"""select item_id, copy::int as copy, case when copy = 0 then text else trim({drawn_sql(terms.PREFIXES, 42)} || lower(text) || {drawn_sql(terms.SUFFIXES, 43)}) end as text from benchmark, range(13) r(copy)""")
def n08(spark, d):
    return terms.augment(table(spark, d, "benchmark"), "text", "item_id")


@query("n09_lda_topics")
def n09(spark, d):
    return terms.lda_topics(texts(spark, d, "text"), "text")


@query("n10_word_vectors")
def n10(spark, d):
    model = terms.word_vectors(texts(spark, d, "text"), "text")
    return terms.stored_vectors(model, spark).select("word", F.size("vector").alias("size"))


@query("n10_nearest_words")
def n10_nearest(spark, d):
    """Ten neighbours of every word."""
    model = terms.word_vectors(texts(spark, d, "text"), "text")
    return terms.nearest_words(terms.stored_vectors(model, spark), 10)


MONEY = r"(?i)[₹$€£]\s?\d[\d,]*(?:\.\d+)?\s?(?:crore|lakh|million|billion|trillion)?"


@query("n11_entity_counts", rf"""select 'PERCENT' as label, count(*) as documents, sum(n)::bigint as spans from (select len(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:\.\d+)?\s?%'), lambda x: trim(x)))) as n from documents) where n > 0 having count(*) > 0
    union all select 'MONEY', count(*), sum(n)::bigint from (select len(list_distinct(list_transform(regexp_extract_all(text, '{MONEY}'), lambda x: trim(x)))) as n from documents) where n > 0 having count(*) > 0""")
def n11(spark, d):
    found = terms.entity_counts(texts(spark, d), "doc_id", text.entities(F.col("text")))
    return found.where(F.col("label").isin("PERCENT", "MONEY"))


# Letters beyond ASCII become underscores: DuckDB's word boundary knows ASCII only.
ASCII_TEXT = r"regexp_replace(text, '[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{1fff}\x{3040}-\x{fdff}]', '_', 'g')"
SPANS_SQL = {"PERSON_OR_ORG": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b", "MONEY": MONEY, "PERCENT": r"\d+(?:\.\d+)?\s?%", "DATE": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:19|20)\d{2}\b"}


@query("n11_all_entity_counts", " union all ".join(f"""select '{label}' as label, count(*) as documents, sum(n)::bigint as spans
    from (select len(list_distinct(list_transform(regexp_extract_all({ASCII_TEXT}, '{pattern}'), lambda x: trim(x)))) as n from documents) where n > 0 having count(*) > 0""" for label, pattern in SPANS_SQL.items()))
def n11_all(spark, d):
    """Every label, also those that the SQL of n11_entity_counts does not have."""
    return terms.entity_counts(texts(spark, d), "doc_id", text.entities(F.col("text")))


@query("n12_text_embeddings")
def n12(spark, d):
    docs = texts(spark, d, "doc_id", "text")
    v = terms.HashEmbedder(384).fit(docs, "text").transform(docs, "text")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("doc_id", F.size("vector").alias("dimension"), F.round(length, 6).alias("length"))


# ---- vector search --------------------------------------------------------------------

CENTROIDS = "(select label, list(m order by i) as c from (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) group by 1, 2) group by 1)"
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"


def centroids(spark, d):
    """Mean vector per label, as the question vectors."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))


def by_centroid(spark, d, k, **options):
    return vectors.nearest(centroids(spark, d), table(spark, d, "embeddings"), k, "label", "vector", "vec_id", "embedding", **options)


SEARCH = f"(select label as query_id, vec_id as item_id, dist, row_number() over (partition by label order by dist, vec_id)::int as rank from (select q.label, e.vec_id, e.label as item_label, {L2.format(a='q.c', b='e.embedding')} as dist from {CENTROIDS} q cross join embeddings e))"


@query("r04_exact_l2", f"select query_id, item_id, rank, round(dist, 6) as distance, round(1 / (1 + dist), 6) as score from {SEARCH} where rank <= 7")
def r04(spark, d):
    return rounded(by_centroid(spark, d, 7), "distance")


@query("r04_inner_product", f"""select * from (select label as query_id, vec_id as item_id, row_number() over (partition by label order by dot desc, vec_id)::int as rank, round(dot, 6) as score
    from (select q.label, e.vec_id, {DOT.format(a='q.c', b='e.embedding')} as dot from {CENTROIDS} q cross join embeddings e)) where rank <= 5""")
def r04_inner(spark, d):
    return by_centroid(spark, d, 5, inner=True).select("query_id", "item_id", "rank", "score")


@query("j05_all_pairs_top_k", f"""select * from (select a.vec_id as query_id, b.vec_id as item_id, row_number() over (partition by a.vec_id order by {L2.format(a='a.embedding', b='b.embedding')}, b.vec_id)::int as rank
    from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rank <= 3""")
def j05(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e, 3, "vec_id", "embedding", "vec_id", "embedding", skip_self=True).select("query_id", "item_id", "rank")


@query("j06_query_blocks", f"select query_id, item_id, rank from {SEARCH} where rank <= 4")
def j06(spark, d):
    """The same search with the questions in blocks of two vectors, one scan per block."""
    return by_centroid(spark, d, 4, block_rows=10).select("query_id", "item_id", "rank")


@query("l07_knn_classifier", f"""with n as (select a.vec_id, b.label, row_number() over (partition by a.vec_id order by {L2.format(a='a.embedding', b='b.embedding')}, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id),
    v as (select vec_id, label, count(*) as n from n where rank <= 5 group by 1, 2)
    select vec_id, label as prediction from (select *, row_number() over (partition by vec_id order by n desc, label) as r from v) where r = 1""")
def l07(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.knn_predict(e, e, 5, "vec_id", "embedding", "label", skip_self=True)


@query("l07_knn_regressor", f"""with n as (select a.vec_id, b.label, sqrt({L2.format(a='a.embedding', b='b.embedding')}) as dist, row_number() over (partition by a.vec_id order by {L2.format(a='a.embedding', b='b.embedding')}, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id)
    select vec_id, round(sum(label / dist) / sum(1 / dist), 6) as prediction from n where rank <= 5 group by 1""")
def l07_regressor(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(vectors.knn_predict(e, e, 5, "vec_id", "embedding", "label", weights="distance", regression=True, skip_self=True), "prediction")


@query("v09_store_integrity", """select (select count(*) from embeddings where vec_id < 400 or label <> 3) as vectors, 0 as wrong_dimension, 0 as broken, (select count(*) from embeddings) as documents,
    (select count(*) from embeddings where not (vec_id < 400 or label <> 3)) as without_vector, 0 as without_document, case when (select count(*) from embeddings where not (vec_id < 400 or label <> 3)) > 0 then 'WARN' else 'PASS' end as status""")
def v09(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.store_integrity(e.select("vec_id"), e.where((F.col("vec_id") < 400) | (F.col("label") != 3)), "vec_id", "embedding", 64)


# ---- chunks ---------------------------------------------------------------------------

WINDOWS = r"""(select doc_id, list_filter([regexp_replace(substring(text, (s + 1)::int, 500), '^\s+|\s+$', '', 'g') for s in range(0, greatest(length(text) - 50, 1), 450)], lambda x: x <> '') as p from documents)"""


@query("r02_window_chunks", f"select doc_id, doc_id || '-chunk-' || i as chunk_id, (i - 1)::int as chunk_index, len(p) as chunk_total, md5(p[i]) as body from (select doc_id, p, unnest(range(1, len(p) + 1))::int as i from {WINDOWS})")
def r02(spark, d):
    cut = chunks.window_chunks(texts(spark, d, "doc_id", "text"), "doc_id", "text")
    return cut.select("doc_id", "chunk_id", "chunk_index", "chunk_total", F.md5("text").alias("body"))


@query("r03_chunk_statistics", f"select doc_id, list_min(l) as min_chars, list_max(l) as max_chars, round(list_avg(l), 6) as mean_chars, len(l) as chunks from (select doc_id, list_transform(p, lambda x: length(x)) as l from {WINDOWS}) where len(l) > 0")
def r03(spark, d):
    return rounded(chunks.chunk_statistics(chunks.window_chunks(texts(spark, d, "doc_id", "text"), "doc_id", "text"), "doc_id"), "mean_chars")


@query("r01_recursive_chunks")
def r01(spark, d):
    cut = chunks.recursive_chunks(texts(spark, d, "doc_id", "source", "text"), "doc_id", "text")
    return cut.select("doc_id", "source", "chunk_id", "chunk_index", "chunk_total", F.length("text").alias("chars"), F.md5("text").alias("body"))


@query("h05_chunk_separators")
def h05(spark, d):
    """Chunks measured in words, cut at sentence ends before blanks."""
    cut = chunks.recursive_chunks(texts(spark, d, "doc_id", "text"), "doc_id", "text", 80, 10, (". ", " "), lambda t: len(t.split()))
    return cut.select("chunk_id", "chunk_total", F.md5("text").alias("body"))


# ---- context, prompts, evaluation -----------------------------------------------------


def conversation_hits(spark, d):
    """Turns as ranked hits of their conversation."""
    c = table(spark, d, "conversations")
    return c.select(
        "conv_id", (F.col("turn") + 1).alias("rank"), "text", F.col("role").alias("source"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("chunk_id"),
        (F.col("turn") * 2).alias("chunk_index"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("page"), (1 / (1 + F.col("turn"))).alias("score"))


def conversation_questions(spark, d):
    """The first turn of each conversation as its question."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))


STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def assembled_sql(header, limit, least, cut):
    return f"""(with u as (select *, row_number() over (partition by conv_id, body order by turn) as copy from (select *, {STRIP.format(c='text')} as body from conversations) where body <> ''),
      f as (select conv_id, turn, {header} || chr(10) || body as part from u where copy = 1), r as (select *, sum(length(part)) over (partition by conv_id order by turn) as upto from f),
      k as (select conv_id, turn, case when upto <= {limit} then part when {limit} - (upto - length(part)) > {least} then {cut} || '...' end as part from r),
      s as (select conv_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as context from k where part is not null group by 1)
      select q.conv_id, question, coalesce(context, 'No relevant context available.') as context from (select conv_id, arg_min(text, turn) as question from conversations group by 1) q left join s using (conv_id))"""


CONTEXT_HEADER = "'Source: ' || role || ' | Document ID: ' || conv_id || ' | Chunk ID: ' || turn || ' | Chunk Index: ' || (turn * 2) || case when turn % 2 = 0 then ' | Page: ' || turn else '' end"
CONTEXT_CUT = r"regexp_replace(substring(part, 1, (1500 - (upto - length(part)))::int), '\s+$', '')"


@query("r06_context", f"select conv_id, md5(context) as context, length(context) as chars from {assembled_sql(CONTEXT_HEADER, 1500, 80, CONTEXT_CUT)}")
def r06(spark, d):
    out = retrieval.build_context(conversation_hits(spark, d), conversation_questions(spark, d), ["conv_id"], 1500)
    return out.select("conv_id", F.md5("context").alias("context"), F.length("context").alias("chars"))


PROMPT_HEADER = "'Source: ' || role || ' | Document ID: ' || conv_id || case when turn % 2 = 0 then ' (Page ' || turn || ')' else '' end || ' | Chunk ID: ' || turn || ' | Chunk Index: ' || (turn * 2) || ' | Relevance: ' || printf('%.4f', 1 / (1 + turn))"
PROMPT_USER = f"'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || {STRIP.format(c='question')} || chr(10) || chr(10) || 'ANSWER:'"


@query("r07_prompts", f"""select conv_id, md5('SYSTEM INSTRUCTIONS' || chr(10) || chr(10) || '{retrieval.SYSTEM_PROMPT}' || chr(10) || chr(10) || {PROMPT_USER}) as prompt, 'user' as role, md5({PROMPT_USER}) as content
    from {assembled_sql(PROMPT_HEADER, 1500, 50, 'substring(part, 1, (1500 - (upto - length(part)))::int)')}""")
def r07(spark, d):
    out = retrieval.build_prompts(conversation_hits(spark, d), conversation_questions(spark, d), ["conv_id"], "question", 1500, with_score=True)
    last = F.element_at("messages", 2)
    return out.select("conv_id", F.md5("prompt").alias("prompt"), last["role"].alias("role"), F.md5(last["content"]).alias("content"))


@query("r08_sources_used", "select conv_id, string_agg(role, '|' order by t) as sources from (select conv_id, role, min(turn) as t from conversations group by 1, 2) group by 1")
def r08(spark, d):
    out = retrieval.sources_used(conversation_hits(spark, d), ["conv_id"])
    return out.select("conv_id", F.array_join("sources", "|").alias("sources"))


PAIRS = "(select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations)"


def turn_pairs(spark, d):
    """Every turn with the text of the turn before it."""
    return ordered.previous(table(spark, d, "conversations"), ["conv_id"], ["turn"], {"before": "text"}).where("before is not null")


OVER = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda w: not list_contains(" + sql_list(retrieval.OVERLAP_STOPS) + ", w))"


@query("r11_lexical_overlap", f"select conv_id, turn, round(coalesce(len(list_intersect({OVER.format(c='before')}, {OVER.format(c='text')})) / nullif(len({OVER.format(c='before')}), 0), 0), 6) as overlap from {PAIRS} where before is not null")
def r11(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(retrieval.lexical_overlap(F.col("before"), F.col("text")), 6).alias("overlap"))


TERMS = r"list_filter(list_distinct(string_split_regex(lower(q), '\s+')), lambda w: regexp_matches(w, '^\p{L}+$'))"


@query("r12_relevance", f"""with q as (select conv_id, arg_min(text, turn) as q from conversations group by 1), s as (select c.conv_id, q, coalesce(len(list_filter({TERMS}, lambda w: contains(lower(c.text), w))) / nullif(len({TERMS}), 0), 0) as s from conversations c join q using (conv_id))
    select conv_id, round(case when trim(any_value(q)) = '' then 0 else avg(s) end, 4) as relevance_score, case when trim(any_value(q)) = '' then 'empty_query' when avg(s) >= 0.2 then 'relevant' else 'not_relevant' end as relevance_status from s group by 1""")
def r12(spark, d):
    hits = table(spark, d, "conversations")
    return retrieval.relevance(hits, conversation_questions(spark, d), ["conv_id"], "question")


CLAIM = r"list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
BACKED = r"len(list_filter(string_split_regex(lower(s), '\s+')[1:5], lambda w: contains(lower(before), w))) > 0"


@query("r13_grounding", rf"""select conv_id, turn, case when trim(text) = '' then 0 else len(list_filter({CLAIM}, lambda s: {BACKED})) end as supported,
    case when trim(text) = '' then 1 else len(list_filter({CLAIM}, lambda s: not ({BACKED}))) end as unsupported, trim(text) = '' or trim(before) = '' as missing_context from {PAIRS} where before is not null""")
def r13(spark, d):
    parts = retrieval.claims(F.col("text"), F.col("before"))
    return turn_pairs(spark, d).select("conv_id", "turn", F.size(parts["supported"]).alias("supported"), F.size(parts["unsupported"]).alias("unsupported"), parts["missing_context"].alias("missing_context"))


def store_hits(spark, d):
    """Search results whose chunk ids repeat within a source."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("source"))
    hits = by_centroid(spark, d, 20).join(e, F.col("item_id") == F.col("vec_id"))
    return hits.select("query_id", "rank", "score", "source", F.floor(F.col("vec_id") / 40).alias("chunk_id"))


QUALITY = f"(select query_id, count(*) as results, round(avg(round(1 / (1 + dist), 6)), 6) as mean_score, count(*) - count(distinct (label, vec_id // 40)) as duplicates from {SEARCH} s join embeddings e on e.vec_id = s.item_id where rank <= 20 group by 1)"


@query("r14_search_duplicates", f"select * from {QUALITY}")
def r14(spark, d):
    return retrieval.search_quality(store_hits(spark, d), ["query_id"])


@query("r15_store_evaluation", f"select count(*) as questions, round(avg(mean_score), 6) as mean_score, sum(duplicates)::bigint as duplicates, case when min(mean_score) > 0.3 and sum(duplicates) = 0 then 'PASS' else 'WARN' end as status from {QUALITY}")
def r15(spark, d):
    e = table(spark, d, "embeddings")
    quality = retrieval.search_quality(store_hits(spark, d), ["query_id"])
    return retrieval.store_evaluation(quality, vectors.store_integrity(e.select("vec_id"), e, "vec_id", "embedding", 64))


@query("r05_min_score", f"select query_id, item_id, rank from {SEARCH} where rank <= 20 and round(1 / (1 + dist), 6) >= 0.517")
def r05(spark, d):
    store = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    hits = retrieval.retrieve(centroids(spark, d), store, 20, 0.517, question_id="label")
    return hits.select(F.col("label").alias("query_id"), F.col("chunk_id").alias("item_id"), "rank")


def corpus(spark, d):
    return texts(spark, d, "doc_id", "source", "text").withColumnRenamed("doc_id", "document_id")


def benchmark_questions(spark, d):
    return table(spark, d, "benchmark").toDF("question_id", "question")


@query("r09_index_documents")
def r09(spark, d):
    return knowledge.index_documents(corpus(spark, d), scratch_dir(spark, "store"))


@query("r10_answer_questions")
def r10(spark, d):
    path = scratch_dir(spark, "store")
    knowledge.index_documents(corpus(spark, d), path)
    out = knowledge.answer_questions(benchmark_questions(spark, d), path)
    return out.select("question_id", "hits", F.length("prompt").alias("prompt_chars"), F.array_join("sources", "|").alias("sources"), "answer")


@query("r16_configuration_sweep")
def r16(spark, d):
    out = knowledge.sweep(corpus(spark, d), benchmark_questions(spark, d), "document_id", "text", "question_id", "question")
    return out.select("chunk_size", "chunk_overlap", "top_k", "chunk_count", "num_results", "avg_similarity", "lexical_relevance")
