"""One registered query per operator, over the whole of the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.core import materialize, read_table
from quern.llm import alignment, chat, fingerprints, language, mixing, pieces, quality_rules, simhash, substrings, token_counts, toxicity, trie, url_filter
from quern.llm.batches import words
from quern.llm.registry import QUERIES, SQL, query  # noqa: F401


@query("op1_language_spans")
def op1_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the two thirds that are not held out."""
    docs = read_table(spark, folder, "documents", "doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = language.fit(docs.where(~held))
    out = language.label(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Exact token counts, and the longest prefix of each document within 512 tokens."""
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts.count_tokens(sized, public_tokenizers.path("byte_bpe_50k.json"), budget=512)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_chars")


@query("op5_piece_ids")
def op5_piece_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document and the text they decode to, as digests."""
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics of every document and the verdict of the robust outlier rule."""
    docs = read_table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    measured = materialize(quality_rules.measure(docs).drop("text", "lang", "source"), "measures")
    out = quality_rules.judge(measured, materialize(quality_rules.fit(measured), "mcd"))
    return out.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "distance")


MIX_SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT as size from documents),
s as (select source, sum(size)::BIGINT as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::DOUBLE as w, source_size * 2.0::DOUBLE as cap from s),
f as (
  select *, row_number() over fill as k, sum(source_size) over () * 1.5::DOUBLE as everything, sum(cap) over fill as capped,
         sum(w) over fill as closed, sum(w) over () as weight, lead(cap / w) over fill as next
  from w window fill as (order by cap / w, source nulls last)),
l as (select *, case when weight > closed then (everything - capped) / (weight - closed) end as level from f),
level as (
  select case when max(everything / weight) <= min(cap / w) then max(everything / weight)
              else coalesce(min_by(level, k) filter (level <= next), 'inf'::DOUBLE) end as level from l),
goal as (select source, source_size, least(cap, level.level * w) as target from l, level),
g as (select *, case when source_size > 0 then floor(target / source_size)::BIGINT else 0 end as whole from goal),
r as (
  select d.doc_id, d.size, d.source, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size as rest,
         ((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|42'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) as u
  from d join g on d.source is not distinct from g.source),
h as (select source, length(bin(size))::DOUBLE as x, sum(size) as n, any_value(rest) as rest from r group by 1, 2),
f2 as (
  select source, x, (rest - coalesce(sum(n) over (partition by source order by x desc rows between unbounded preceding and 1 preceding), 0))
         / nullif(sum(x * n) over (partition by source order by x rows between unbounded preceding and current row), 0) as factor from h),
i as (select source, max_by(factor, x) as factor from f2 where factor * x <= 1 group by 1),
p as (select r.*, least(1.0::DOUBLE, i.factor * length(bin(size))::DOUBLE) as p from r left join i on i.source is not distinct from r.source),
q as (
  select *, case when p >= 1 then 0 else coalesce(floor(q / (q + 1.0::DOUBLE) * 1125899906842624.0::DOUBLE)::BIGINT, 1125899906842623) end as k
  from (select *, (u / (1.0::DOUBLE - u)) / nullif(p / nullif(1.0::DOUBLE - p, 0), 0) as q from p)),
o as (
  select *, sum(size) over (partition by source order by k, doc_id nulls last, size
                            rows between unbounded preceding and current row) as upto from q)
select doc_id, size, source_size, target, (size * (whole + case when rest > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end))::BIGINT as taken from o
"""


@query("op6_source_mix", MIX_SQL)
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """A mix of 150% of all words over the sources, weighted 3, 1, 2 in turn."""
    docs = read_table(spark, folder, "documents", "doc_id", "source", "text")
    mixed = mixing.mix(docs, F.size(words(F.col("text"))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


FINGERPRINT_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id), first(t) over (order by doc_id rows between unbounded preceding and unbounded following)) as nx from d),
e as (select *, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) as ed from n),
l as (select *, {fingerprints.sql_lanes("t")} as a, {fingerprints.sql_lanes("ed")} as b, {fingerprints.sql_lanes("nx")} as c from e)
select doc_id, length(t)::BIGINT as n_chars, sha256(ed) as edited_sha256, {fingerprints.sql_text("a")} as fingerprint, {fingerprints.sql_text("b")} as edited_fingerprint,
       {fingerprints.sql_likeness("a", "b")} as near_edited, {fingerprints.sql_likeness("a", "c")} as near_next
from l
"""


@query("op9_multiset_hash", FINGERPRINT_SQL)
def op9_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are to it."""
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    both = fingerprints.fingerprint(fingerprints.edited(docs), "text")
    both = fingerprints.fingerprint(both, "edited_text", "edited_fingerprint")
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_lanes")
    return both.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprints.as_text(a).alias("fingerprint"), fingerprints.as_text(b).alias("edited_fingerprint"), fingerprints.likeness(a, b).alias("near_edited"), fingerprints.likeness(a, c).alias("near_next"))


CHAT_SQL = """
with c as (
  select conv_id, list({r: coalesce('=' || role, '-'), t: coalesce('=' || text, '-')} order by turn nulls first, role nulls first, text) as l,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by turn nulls first, role nulls first, text) as rendered
  from conversations group by conv_id),
w as (select l, min(conv_id) as conv_id, count(*) as copies, min_by(rendered, conv_id) as rendered from c group by l),
p as (select distinct l[1:k] as l from (select l, unnest(range(1, len(l))) as k from w))
select conv_id, len(l)::BIGINT as n_turns, copies, rendered from w anti join p using (l)
"""


@query("op2_snapshot_collapse", CHAT_SQL)
def op2_snapshot_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that no longer logged one extends, rendered."""
    return chat.collapse(read_table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op7_path_templates")
def op7_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page by rule or by learned path template; a page is bad if its label says low quality or toxic."""
    labels = read_table(spark, folder, "labels", "doc_id", "quality", "toxic")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    pages = read_table(spark, folder, "pages", "page_id", "url")
    out = url_filter.judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad")), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op10_simhash_tiles")
def op10_simhash_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of every document and the component it belongs to at two differing bits or fewer."""
    out = simhash.components(read_table(spark, folder, "documents", "doc_id", "text"))
    return out.select(F.col("k").alias("doc_id"), F.lower(F.lpad(F.hex(F.get("lanes", 0)), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op8_window_doubling")
def op8_window_doubling(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document when repeated windows of 20 words go."""
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    out = substrings.remove_repeats(docs, size=20, n_words="n_words", n_removed="n_removed")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("kept_sha256"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap links and groups of the tokens of two tokenizers in every document."""
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    out = alignment.corpus_links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, folder, "labels", "doc_id", "toxic").where(~held))
    out = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")


TRIE_SQL = """
with t as (
  select conv_id as c, list({r: coalesce(role, ''), t: coalesce(text, '')} order by turn nulls first, coalesce(role, ''), text) as l from conversations where conv_id is not null group by 1),
h as (
  select c, l, c - c % 100 as b, xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT for x in string_split(c::VARCHAR, '')],
    lambda a, x: list_reduce([xor(a, x)] || [0::BIGINT for i in range(8)], lambda k, i: xor(k >> 1, (k & 1) * 3988292384))), 4294967295) % 6 as h from t),
r as (select h.c, coalesce(t.l, [])[1:h.h] || coalesce(h.l[h.h + 1:], []) as l from h left join t on t.c = h.b),
p as (select c, l, unnest(range(0, len(l) + 1)) as d from r),
n as (select l[1:d] as path, d, min(c) as conv_id, count(*) as n_convs from p group by 1, 2),
k as (select path[1:d - 1] as path, count(*) as n_children from n where d > 0 group by 1),
w as (select n.*, coalesce(n_children, 0) as n_children, case when d > 0 then (n_convs - 1) * length(path[d].t) else 0 end as saved from n left join k using (path)),
s as (select path[1:x] as path, sum(saved) as saved_tokens, sum(case when n_children = 0 then 1 else 0 end) as n_leaves
      from (select path, saved, n_children, unnest(range(0, d + 1)) as x from w) group by 1),
e as (select l as path, sha256(string_agg(c::VARCHAR, ',' order by c)) as ends_sha256 from r group by 1)
select w.conv_id, w.d as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children::BIGINT as n_children, s.n_leaves::BIGINT as n_leaves,
       s.saved_tokens::BIGINT as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from w join s using (path) left join e using (path) left join w u on w.d > 0 and u.d = w.d - 1 and u.path = w.path[1:w.d - 1]
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.trie(read_table(spark, folder, "conversations", "conv_id", "turn", "role", "text"), rebuilt=True)
