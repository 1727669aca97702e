"""Source, sink, table and user-function queries; files are derived from the given tables."""

import io
import threading
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import read_table as table
from quern.core import scratch_dir, spread
from quern.functions import text, udfs
from quern.operators import validate
from quern.sources import catalogue, documents, files, payloads, tables, workbooks
from quern.workload.registry import query


def as_csv(df, spark, label, **options):
    path = scratch_dir(spark, label) + ".csv"
    df.write.options(header=True, **options).csv(path)
    return path


@query("s01_csv", "select o_orderkey::varchar as o_orderkey, o_totalprice, year(o_orderdate) as year, month(o_orderdate) as month, o_orderpriority from orders")
def s01(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = as_csv(o, spark, "orders", sep="|")
    df = files.read_csv(spark, path, delimiter="|", dtype_overrides={"o_orderkey": "string"}, parse_dates=["o_orderdate"])
    return df.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_orderpriority")


@query("s01_csv_headerless", """select p_partkey as "0", p_name as "1", p_size as "2" from part""")
def s01_headerless(spark, d):
    path = scratch_dir(spark, "part") + ".csv"
    table(spark, d, "part", "p_partkey", "p_name", "p_size").write.csv(path)
    return files.read_csv(spark, path, has_header=False)


@query("s02_json_records", """select l_orderkey as "order.key", l_linenumber as "order.line.number", l_partkey as part, l_returnflag as "order.line.flag" from lineitem""")
def s02(spark, d):
    line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("flag"))
    record = F.struct(F.struct(F.col("l_orderkey").alias("key"), line.alias("line")).alias("order"), F.col("l_partkey").alias("part"))
    path = scratch_dir(spark, "nested") + ".jsonl"
    table(spark, d, "lineitem").select(F.struct(F.array(record).alias("records")).alias("results")).write.json(path)
    return files.read_json(spark, path, record_path="results.records", lines=True)


@query("s03_json_lines", "select event_id, event_type, props from events")
def s03(spark, d):
    path = scratch_dir(spark, "events") + ".jsonl"
    table(spark, d, "events").select("event_id", "event_type", "props").write.json(path)
    return files.load_records(spark, path)


@query("s03_csv_as_text", "select s_suppkey::varchar as s_suppkey, s_nationkey::varchar as s_nationkey from supplier")
def s03_csv(spark, d):
    return files.load_records(spark, as_csv(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), spark, "supplier"))


@query("s04_load_by_extension", "select c_custkey, c_name, c_acctbal from customer")
def s04(spark, d):
    return files.load_table(spark, f"{d}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")


SHEET_ROWS = 500


def workbook_bytes(pdf: pd.DataFrame, sheets: list[tuple[str, list[str]]]) -> bytes:
    """A small spreadsheet file with inline texts: a title row, a header row, then the rows."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, (_, cols) in enumerate(sheets, 1):
            rows = [["Report"], cols, *pdf[cols].astype(str).values.tolist()]
            cells = "".join(
                f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return buffer.getvalue()


@query("s05_workbooks", """select 'mem/' || (c_custkey // 500) || '.xlsx' as path, 'People' as sheet, c_custkey::varchar as c_custkey, c_name, null::varchar as c_nationkey from customer
    union all select 'mem/' || (c_custkey // 500) || '.xlsx', 'Places', c_custkey::varchar, null, c_nationkey::varchar from customer""")
def s05(spark, d):
    def build(pdf):
        content = workbook_bytes(pdf, [("People", ["c_custkey", "c_name"]), ("Places", ["c_custkey", "c_nationkey"])])
        return pd.DataFrame({"path": [f"mem/{pdf['book'].iloc[0]}.xlsx"], "content": [content]})

    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey").withColumn("book", F.floor(F.col("c_custkey") / SHEET_ROWS))
    books = c.groupBy("book").applyInPandas(build, "path string, content binary")
    return workbooks.promote_header(workbooks.parse_workbooks(books), header_row=0, skip_rows=1, columns=["c_custkey", "c_name", "c_nationkey"]).drop("row_no")


def payload_rows(spark, d):
    """One API payload per order in four envelope shapes."""
    o = spread(table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"))
    record = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    two = F.array(record, record)
    shape = F.col("o_orderkey") % 4
    payload = (F.when(shape == 0, F.to_json(two)).when(shape == 1, F.to_json(F.struct(F.lit("ok").alias("status"), two.alias("data"))))
               .when(shape == 2, F.to_json(F.struct(F.lit(1).alias("results"), two.alias("items")))).otherwise(F.to_json(record)))
    return o.select("o_orderkey", payload.alias("payload"))


@query("s06_unwrap_payloads", "select o_orderkey, i::int as position, o_orderkey as key, o_totalprice as price from orders, range(2) r(i) where i = 0 or o_orderkey % 4 <> 3")
def s06(spark, d):
    return payloads.read_payloads(payload_rows(spark, d), "payload", "key bigint, price double", ["o_orderkey"])


@query("s07_assemble_pages", """with n as (select l_orderkey, l_linenumber as page, count(*) as n from lineitem group by 1, 2), p as (select l_orderkey, page, least(n, 2) as n from n),
    e as (select l_orderkey, min(page) as last from p where n < 2 group by 1) select p.l_orderkey, sum(n)::bigint as records from p left join e using (l_orderkey) where last is null or page <= last group by 1""")
def s07(spark, d):
    """Pages of up to two records per order and line number."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.count("*").alias("n"))
    payload = F.to_json(F.struct(F.array_repeat(F.struct(F.col("page").alias("line")), F.least("n", F.lit(2)).cast("int")).alias("results")))
    pages = n.select("l_orderkey", "page", payload.alias("payload"))
    rows = payloads.assemble_pages(pages, "page", "payload", 2, ["l_orderkey"], "line int")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("records"))


@query("s08_records_table", "select event_id, (props->>'k')::int as k from events")
def s08(spark, d):
    return payloads.read_payloads(table(spark, d, "events"), "props", "k int", ["event_id"]).drop("position")


@query("s09_named_source", "select s_suppkey, s_name from supplier")
def s09(spark, d):
    path = as_csv(table(spark, d, "supplier"), spark, "source", sep=";")
    known = catalogue.Catalogue({"csv_sources": {"suppliers": {"path": path}}, "defaults": {"csv": {"delimiter": ";"}}})
    return known.ingest(spark, "csv_sources", "suppliers").select("s_suppkey", "s_name")


@query("s11_partitioned_sink", "select c_mktsegment, count(*) as rows, round(sum(c_acctbal), 2) as total from customer group by 1")
def s11(spark, d):
    path = scratch_dir(spark, "customers")
    files.save(table(spark, d, "customer"), path, partition_by=["c_mktsegment"])
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("s12_text_corpus", r"select 'doc_' || doc_id || '.txt' as file_name, 'txt' as document_type, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) as body from documents")
def s12(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    raw = docs.select(F.concat(F.lit("file:/corpus/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return documents.as_documents(raw).select("file_name", "document_type", F.md5("text").alias("body"))


@query("s12_latin1_fallback", "select p_partkey, 'café ' || p_name as text from part")
def s12_latin(spark, d):
    raw = table(spark, d, "part").select("p_partkey", F.encode(F.concat(F.lit("café "), "p_name"), "ISO-8859-1").alias("content"))
    return raw.select("p_partkey", documents.decode_text(F.col("content")).alias("text"))


@query("s13_rows_as_documents", """select row_number() over (order by s_suppkey) - 1 as row, count(*) over () as total_rows, 's_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || s_name || chr(10) || 's_nationkey: ' || s_nationkey as text from supplier""")
def s13(spark, d):
    return documents.rows_as_documents(table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey"), "/data/supplier.csv", ["s_suppkey"]).select("row", "total_rows", "text")


@query("s14_word_documents", r"select doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(text, '[^\x20-\x7E\n]', '_', 'g'), chr(10)), lambda x: trim(x) <> ''), chr(10))) as body from documents")
def s14(spark, d):
    def build(batches):
        for batch in batches:
            content = []
            for t in batch["text"]:
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in t.split("\n"))
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                content.append(buffer.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": content})

    plain = F.regexp_replace("text", r"[^\x20-\x7E\n]", "_")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), plain.alias("text"))
    parsed = workbooks.parse_word_files(docs.mapInPandas(build, "path string, content binary"))
    return parsed.select(F.col("path").cast("bigint").alias("doc_id"), F.md5("text").alias("body"))


@query("s15_document_ids", """select doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || printf('%02x', (('0x' || substring(h, 17, 2))::int & 63) | 128) || substring(h, 19, 2) || '-' || substring(h, 21, 12) as document_id
    from (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('/corpus/doc_' || doc_id || '.txt')) as h from documents)""")
def s15(spark, d):
    path = F.concat(F.lit("/corpus/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", documents.metadata(path, "txt")["document_id"].alias("document_id"))


@query("s16_chunked_table", "select l_returnflag, round(sum(l_extendedprice * 1.18::double), 2) as total from lineitem group by 1")
def s16(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_extendedprice")
    out = files.map_chunks(li, lambda pdf: pdf.assign(l_extendedprice=pdf["l_extendedprice"] * 1.18), li.schema, rows=2000)
    return out.groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


def customer_table(spark, d):
    """A fresh row table holding all customers, numbered by their key."""
    store = tables.Tables(spark, scratch_dir(spark, "tables"))
    sample = {"c_custkey": 1, "c_name": "x", "c_nationkey": 1, "c_acctbal": 1.0, "c_mktsegment": "x"}
    store.create("customer", tables.sample_types(sample), auto_id=True)
    store.insert("customer", table(spark, d, "customer"), order=["c_custkey"])
    return store


@query("t01_create_from_sample", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, row_number() over (order by c_custkey) as id from customer")
def t01(spark, d):
    return customer_table(spark, d).frame("customer")


@query("t02_insert_counts", "select count(*) as written, 0 as empty, count(*) as stored from customer")
def t02(spark, d):
    store = customer_table(spark, d)
    written = store.insert("customer", table(spark, d, "customer").where("false"), order=["c_custkey"])
    return store.frame("customer").agg(F.count("*").alias("written"), F.lit(written).alias("empty"), F.count_distinct("id").alias("stored"))


@query("t03_read", "select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3 order by c_acctbal desc limit 10")
def t03(spark, d):
    return customer_table(spark, d).read("customer", ["c_custkey", "c_acctbal"], {"c_mktsegment": "BUILDING", "c_nationkey": "3"}, "c_acctbal desc", 10)


@query("t04_count", "select count(*) as rows from customer where c_mktsegment = 'MACHINERY'")
def t04(spark, d):
    store = customer_table(spark, d)
    return store.read("customer", where={"c_mktsegment": "MACHINERY"}).agg(F.count("*").alias("rows"))


@query("t05_update", "select c_custkey, case when c_mktsegment = 'FURNITURE' then 0 else c_acctbal end as c_acctbal from customer")
def t05(spark, d):
    store = customer_table(spark, d)
    store.update("customer", {"c_acctbal": 0}, {"c_mktsegment": "FURNITURE"})
    return store.read("customer", ["c_custkey", "c_acctbal"])


@query("t06_delete", "select c_custkey from customer where not (c_nationkey = 7 and c_mktsegment = 'HOUSEHOLD')")
def t06(spark, d):
    store = customer_table(spark, d)
    store.delete("customer", {"c_nationkey": 7, "c_mktsegment": "HOUSEHOLD"})
    return store.read("customer", ["c_custkey"])


@query("t07_page", "select row_number() over (order by c_custkey) as id, c_custkey from customer order by c_custkey limit 20 offset 40")
def t07(spark, d):
    return customer_table(spark, d).page("customer", 40, 20).select("id", "c_custkey")


@query("t08_concurrent_appends", "select c_mktsegment, count(*) as rows, count(*) as ids from customer group by 1")
def t08(spark, d):
    """Every market segment is appended by a thread of its own."""
    store = tables.Tables(spark, scratch_dir(spark, "tables"))
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    store.create("customer", {"c_custkey": "bigint", "c_mktsegment": "string"}, auto_id=True)
    parts = [r[0] for r in c.select("c_mktsegment").distinct().collect()]
    jobs = [threading.Thread(target=store.insert, args=("customer", c.where(F.col("c_mktsegment") == p)), kwargs={"order": ["c_custkey"]}) for p in parts]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    return store.frame("customer").groupBy("c_mktsegment").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query("h01_value_check", "select p_partkey, case when p_size % 2 = 1 then 'Column ''p_size'' failed custom check for value ' || p_size end as error from part")
def h01(spark, d):
    even = udfs.value_check(lambda s: s % 2 == 0)
    return validate.check_rows(table(spark, d, "part"), validate.RuleSet([validate.Rule("p_size", custom_check=even)])).select("p_partkey", "error")


@query("h02_text_scorer", """select p_partkey, case when s > 0.15 then 'Positive' when s < -0.15 then 'Negative' else 'Neutral' end as label, round(s, 3) as score
    from (select p_partkey, greatest(least((length(p_name) - 10) / 4, 1), -1) as s from part)""")
def h02(spark, d):
    scorer = udfs.text_scorer(lambda s: (s.str.len() - 10) / 4)
    return table(spark, d, "part").select("p_partkey", text.sentiment(F.col("p_name"), scorer).alias("s")).select("p_partkey", "s.label", "s.score")


@query("h04_parallel_column", "select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def h04(spark, d):
    li = table(spark, d, "lineitem")
    out = udfs.column_of(li, ["l_extendedprice", "l_discount"], lambda p: p["l_extendedprice"] * (1 - p["l_discount"]), T.DoubleType(), "net")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("net", 4).alias("net"))
