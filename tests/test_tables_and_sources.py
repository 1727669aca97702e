"""Row tables, sources, catalogue, validation and job edge cases on small hand-made rows."""

import io
import json
import logging
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.core import scratch_dir
from quern.functions import lists, numeric
from quern.operators import quality, shape, validate
from quern.plans import jobs
from quern.sources import catalogue, documents, files, payloads, tables, workbooks
from quern.workload.source_queries import workbook_bytes


@pytest.fixture
def store(spark):
    t = tables.Tables(spark, scratch_dir(spark, "store"))
    t.create("company", tables.sample_types({"name": "x", "balance": 1.5, "rank": 1}), auto_id=True)
    return t


def test_crud_round_trip(store):
    rows = [{"name": f"c{i}", "balance": i / 3, "rank": i} for i in range(5)]
    assert store.insert("company", rows) == 5
    assert store.insert("company", []) == 0
    assert store.insert("company", {"name": "late", "balance": 9.0, "rank": 9}) == 1
    assert [r["id"] for r in store.page("company", 0, 0).collect()] == [1, 2, 3, 4, 5, 6]
    assert [r["id"] for r in store.page("company", 2, 2).collect()] == [3, 4]
    assert store.read_one("company", {"name": "c2"})["balance"] == pytest.approx(2 / 3)
    assert store.read_one("company", {"name": "nobody"}) is None
    assert store.count("company", {"rank": "3"}) == 1
    assert store.update("company", {"balance": -1.0}, {"name": "c1"}) == 1
    assert store.count("company", {"balance": -1.0}) == 1
    assert store.delete("company", {"rank": 4}) == 1
    assert store.count("company") == 5
    with pytest.raises(tables.TableError):
        store.delete("company", {})
    store.drop("company")
    with pytest.raises(tables.TableError):
        store.frame("company")


def test_writers_at_the_same_time_lose_nothing(spark, store):
    """Inserts from two stores while rows are updated and deleted: no row is lost, no id repeats."""
    other = tables.Tables(spark, store.root)
    store.insert("company", [{"name": "base", "balance": 0.0, "rank": i} for i in range(4)])

    def append(t, name):
        for i in range(4):
            t.insert("company", [{"name": name, "balance": 1.0, "rank": 100 + i}, {"name": name, "balance": 2.0, "rank": 200 + i}])

    work = [(append, store, "a"), (append, other, "b"), (store.update, "company", {"balance": -1.0}, {"name": "base"}), (other.update, "company", {"name": "moved"}, {"rank": 0}), (other.delete, "company", {"rank": 3})]
    with ThreadPoolExecutor(len(work)) as pool:
        for job in [pool.submit(f, *args) for f, *args in work]:
            job.result()
    rows = store.frame("company").collect()
    assert sorted(r["id"] for r in rows) == sorted({r["id"] for r in rows}) and len(rows) == 4 - 1 + 16
    assert sorted(r["rank"] for r in rows if r["name"] in "ab") == sorted([*range(100, 104), *range(200, 204)] * 2)
    assert {(r["name"], r["rank"]) for r in rows if r["rank"] < 4} == {("moved", 0), ("base", 1), ("base", 2)}
    assert all(r["balance"] == -1.0 for r in rows if r["name"] == "base")


def test_insert_during_a_rewrite_stays(spark, store):
    store.insert("company", [{"name": "x", "balance": 0.0, "rank": 1}])
    with ThreadPoolExecutor(1) as pool:
        waiting = []

        def late(df, hit):
            waiting.append(pool.submit(tables.Tables(spark, store.root).insert, "company", [{"name": "late", "balance": 0.0, "rank": 2}]))
            return df.where(~hit)

        assert store._rewrite("company", {"rank": 1}, late) == 1
        assert waiting[0].result() == 1
    assert [r["name"] for r in store.frame("company").collect()] == ["late"]


def test_unfinished_version_is_not_read(spark, store):
    store.insert("company", [{"name": "x", "balance": 0.0, "rank": 1}])
    store.frame("company").limit(0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.root}/company/v2/rows")
    assert store.count("company") == 1
    assert store.update("company", {"rank": 7}, {"name": "x"}) == 1
    assert store.read_one("company", {"name": "x"})["rank"] == 7


def test_hostile_values_are_plain_values(store):
    store.insert("company", {"name": "'; DROP TABLE company; --", "balance": 0.0, "rank": 0})
    assert store.count("company", {"name": "' OR '1'='1"}) == 0
    assert store.count("company", {"name": "'; DROP TABLE company; --"}) == 1


def test_json_record_path(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"results": {"records": [{"a": 1, "b": {"c": 2, "d": [1, 2]}}, {"a": 3, "b": {"c": 4, "d": []}}]}}))
    df = files.read_json(spark, str(path), "results.records")
    assert df.columns == ["a", "b.c", "b.d"] and df.count() == 2
    with pytest.raises(KeyError, match="rows"):
        files.read_json(spark, str(path), "results.rows")


def test_load_records_by_extension(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1}')
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert files.load_records(spark, str(tmp_path / "one.json")).count() == 1
    assert files.load_records(spark, str(tmp_path / "lines.jsonl")).count() == 2
    assert dict(files.load_records(spark, str(tmp_path / "t.csv")).dtypes) == {"a": "string", "b": "string"}
    with pytest.raises(ValueError):
        files.load_records(spark, str(tmp_path / "x.txt"))
    with pytest.raises(FileNotFoundError):
        files.load_table(spark, str(tmp_path / "absent.parquet"))


def test_catalogue(spark, tmp_path, caplog):
    (tmp_path / "t.csv").write_text("a;b\n1;x\n")
    (tmp_path / "empty.csv").write_text("a;b\n")
    settings = {"csv_sources": {"t": {"path": str(tmp_path / "t.csv")}, "gone": {"path": "/nowhere/x.csv"}, "empty": {"path": str(tmp_path / "empty.csv")}}, "defaults": {"csv": {"delimiter": ";"}}}
    known = catalogue.Catalogue(settings)
    assert known.ingest(spark, "csv_sources", "t").columns == ["a", "b"]
    assert known.list_sources("csv_sources") == {"csv_sources": ["t", "gone", "empty"]}
    for category, name in (("xml_sources", "t"), ("csv_sources", "nope"), ("csv_sources", "")):
        with pytest.raises(catalogue.SourceError):
            known.ingest(spark, category, name)
    with pytest.raises(catalogue.SourceError, match="gone"):
        known.ingest(spark, "csv_sources", "gone")
    with caplog.at_level(logging.WARNING):
        known.ingest(spark, "csv_sources", "empty")
    assert "empty" in caplog.text


def test_landed_pages(spark, tmp_path):
    for page, n in ((1, 2), (2, 2), (3, 1), (4, 2)):
        (tmp_path / f"page-{page}.json").write_text(json.dumps({"results": [{"v": page * 10 + i} for i in range(n)]}))
    known = catalogue.Catalogue({"api_sources": {"s": {"path": str(tmp_path), "paginate": True, "pagination": {"page_size": 2}, "schema": "v int"}}})
    got = known.ingest(spark, "api_sources", "s").orderBy("page", "position")
    assert [r["v"] for r in got.collect()] == [10, 11, 20, 21, 30]


def test_unwrap_shapes(spark):
    rows = [('[{"a":1},{"a":2}]',), ('{"data":[{"a":3}]}',), ('{"results":{"a":9},"a":4}',), ("not json",), ("7",)]
    got = payloads.read_payloads(spark.createDataFrame(rows, "p string"), "p", "a int").collect()
    assert sorted(r["a"] for r in got) == [1, 2, 3, 4]


def test_workbook_files(spark, tmp_path):
    pdf = pd.DataFrame({"a": [1, 2], "b": ["x & y", "z"]})
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes(pdf, [("First", ["a", "b"]), ("Second", ["b"])]))
    first = workbooks.read_workbooks(spark, str(tmp_path), 0, skip_rows=1, dtype_overrides={"a": "int"}).orderBy("row_no").collect()
    assert [(r["a"], r["b"]) for r in first] == [(1, "x & y"), (2, "z")]
    every = workbooks.read_workbooks(spark, str(tmp_path), "all", skip_rows=1)
    assert every.groupBy("sheet").count().count() == 2


def test_text_and_word_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("  héllo \n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "blank.txt").write_text(" \n ")
    got = {r["file_name"]: r for r in documents.read_corpus(spark, str(tmp_path)).collect()}
    assert {k: r["text"] for k, r in got.items()} == {"a.txt": "héllo", "b.txt": "café"}
    assert got["b.txt"]["document_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, got["b.txt"]["file_path"]))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    row = documents.read_word_corpus(spark, str(tmp_path)).collect()[0]
    assert row["text"] == "One two\nThree" and row["paragraph_count"] == 2


def test_transform_job_rejects_bad_input(spark):
    with pytest.raises(TypeError):
        jobs.transform_table(None)
    with pytest.raises(ValueError):
        jobs.transform_table(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError, match="available"):
        jobs.transform_with_profile(spark.createDataFrame([(1,)], "a int"), "nope")


def test_company_profile_matches_pandas(spark):
    rows = [(" Acme  Inc ", "100", "North", "2024-02-29"), (" Acme  Inc ", "100", "North", "2024-02-29"), ("Beta", None, "north ", "2000-01-01"), (None, "bad_value", "South", "2026-12-31"), ("Gamma", "300", "South", "not a date")]
    out = jobs.transform_with_profile(spark.createDataFrame(rows, "`Company Name ` string, Revenue string, Region string, `Report Date` string"), "company_financials")
    got = out.toPandas()
    assert len(got) == 4 and abs(got["revenue"].mean()) < 1e-9 and abs(got["revenue"].std() - 1) < 1e-9
    assert got["region_north"].sum() == 2 and got["region_south"].sum() == 2
    leap = got[got["report_date_month"] == 2].iloc[0]
    assert (leap["report_date_day"], leap["report_date_quarter"], leap["report_date_dow"]) == (29, 1, 3)


def test_rules_first_failure_and_duplicates(spark):
    df = spark.createDataFrame([("A", 5.0), (None, 5.0), ("B", 150.0), ("A", 5.0)], "district string, rate double")
    rules = validate.RuleSet([validate.Rule("district", "string"), validate.Rule("rate", "double", min_value=0, max_value=100)])
    report = {r["measure"]: r["value"] for r in validate.validation_report(df, rules).collect()}
    assert report["valid_rows"] == 2 and report["duplicate_rows"] == 1 and report["is_valid"] == 0
    assert validate.clean(df, rules).count() == 1
    with pytest.raises(validate.SchemaError):
        validate.validation_report(df, validate.RuleSet([validate.Rule("absent")]), strict=True)


def test_impute_rules(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "a")], "x double, t string")
    assert [r["t"] for r in quality.impute(df, "median").collect()] == ["a", "a", "a"]
    assert quality.impute(df, "mean", fallback=False).where("t is null").count() == 1
    assert quality.impute(df.select(F.lit(None).cast("string").alias("t")), "median").collect()[0]["t"] == "unknown"
    with pytest.raises(ValueError):
        quality.impute(df, "guess")
    with pytest.raises(ValueError):
        quality.impute(df, "constant")


def test_names_numbers_lists(spark):
    with pytest.raises(ValueError, match="clash"):
        shape.standardize_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a  b` int"))
    texts = [("1e3 units",), ("N/A",), ("12.5%",), ("-.5",), ("none here",)]
    got = spark.createDataFrame(texts, "t string").select(numeric.number_in_text(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [1000.0, None, 12.5, -0.5, None]
    raw = [("['cs.LG', \"stat.ML\"]",), ("a, b ,,c",), ("solo",), (" ",), (None,), ("[1, 2]",)]
    got = spark.createDataFrame(raw, "t string").select(lists.parse_list(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in got] == [["cs.LG", "stat.ML"], ["a", "b", "c"], ["solo"], [], [], ["1", "2"]]


def test_list_literals_with_mixed_and_escaped_items(spark):
    raw = [("['a', 3, None]",), (r"['a\'b', 'c']",), ("[\"x, y\", 'it']",), ("[]",), ("['open, b]",)]
    got = spark.createDataFrame(raw, "t string").select(lists.parse_list(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in got] == [["a", "3", "None"], ["a'b", "c"], ["x, y", "it"], [], ["open", "b"]]
