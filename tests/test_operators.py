"""DataFrame operators on small fixtures, the data source, streaming and the entry."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchlake import api
from parchlake.functions import strings
from parchlake.functions.batches import BYTES, batched, parts
from parchlake.functions.chunking import chunk_documents
from parchlake.kernel import crypt, edit
from parchlake.operators import graph, pages
from parchlake.sources import pdf
from parchlake.streaming.files import stream_pdf


def test_ranges_agree_with_the_kernel(spark):
    specs = ["", "1-2", "2,1,2", "3", "0", "4", "2-1", "x", " 1 , , 2 ", ",", "1 - 3", "1,"]
    got = pages.parse_ranges(spark.createDataFrame([(s, 3) for s in specs], "s string, n int"), "s", "n").collect()
    for r in got:
        try:
            want, code = edit.ranges(r["s"], 3), None
        except api.PdfError as e:
            want, code = None, e.code
        assert (r["pages"], r["code"]) == (want, code), r["s"]


def test_walk_cuts_cycles_and_repeats(spark):
    edges = spark.createDataFrame([(0, "r", 0, "a", None), (0, "r", 1, "b", 90), (0, "b", 0, "a", None), (0, "b", 1, "r", None), (0, "a", 0, "c", None)], "doc int, parent string, ordinal int, child string, rotate int")
    roots = spark.createDataFrame([(0, "r", 180)], "doc int, node string, rotate int")
    got = {r["node"]: (r["path"], r["rotate"]) for r in graph.walk_tree(spark, edges, roots, ("rotate",)).collect()}
    assert got == {"r": ([], 180), "a": ([0], 180), "b": ([1], 90), "c": ([0, 0], 180)}


def test_reachable_and_resolve(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 9), (0, 5, 6)], "doc int, src int, dst int")
    roots = spark.createDataFrame([(0, 1)], "doc int, node int")
    objects = spark.createDataFrame([(0, n, f"v{n}") for n in (1, 2, 5, 6)], "doc int, node int, value string")
    assert {r["node"] for r in graph.collect_garbage(objects, edges, roots).collect()} == {1, 2}
    assert {r["dst"]: r["value"] for r in graph.resolve(edges, objects).collect()}[9] is None


def test_text_codec_and_ciphers(spark):
    key, iv = bytes(range(32)), bytes(16)
    row = spark.createDataFrame([("é漢😀", "plain", bytearray(range(32)))], "u string, a string, b binary")
    k, v = F.lit(key), F.lit(iv)
    sealed = strings.aes_encrypt_unpadded(F.col("b"), k, v)
    r = row.select(strings.encode_text(F.col("u")).alias("u"), strings.encode_text(F.col("a")).alias("a"), strings.decode_text(strings.encode_text(F.col("u"))).alias("d"), sealed.alias("s"), strings.aes_decrypt_unpadded(sealed, k, v).alias("back"), strings.aes_decrypt_cbc(F.lit(b"short"), k).alias("none")).first()
    assert bytes(r["u"]) == edit.encode_text("é漢😀") and bytes(r["a"]) == b"plain" and r["d"] == "é漢😀"
    assert bytes(r["s"]) == crypt.cbc(key, iv, bytes(range(32)), True) and bytes(r["back"]) == bytes(range(32)) and bytes(r["none"]) == b""


def test_paragraph_units(spark):
    df = spark.createDataFrame([("d", 0, "a\n\n\nb \xa0"), ("d", 1, "\r\n\r\nc"), ("e", 0, None)], "doc string, p int, t string")
    assert [r["text"] for r in chunk_documents(df, "doc", "p", "t").collect()] == ["a\n\nb\n\nc"]


def test_source_sink_and_stream(spark, tmp_path):
    pdf.register(spark)
    made = [("one", edit.text_document(["first page", "second"], "T").to_bytes()), ("bad", b"no pdf")]
    spark.createDataFrame(made, "path string, content binary").write.format("pdf").mode("append").save(str(tmp_path / "in"))
    got = {(r["path"].rsplit("/", 1)[1], r["page_index"]): (r["text"], r["error"] and r["error"]["code"]) for r in spark.read.format("pdf").load(str(tmp_path / "in")).collect()}
    assert got == {("one.pdf", 0): ("first page", None), ("one.pdf", 1): ("second", None), ("bad.pdf", None): (None, "NOT_A_PDF")}
    meta = pdf.read_pdf(spark, (tmp_path / "in").as_uri(), "meta").where("error is null").first()
    assert meta["page_count"] == 2 and meta["metadata"]["title"] == "T"
    assert pdf.read_pdf(spark, (tmp_path / "in").as_uri(), "objects").where("kind = 'stream'").count() == 2
    q = stream_pdf(spark, (tmp_path / "in").as_uri()).writeStream.format("memory").queryName("texts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("texts").where("text = 'second'").count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q) and "h_chunk_documents" in q
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["r_parse_ranges", "t_rotation", "s_json_lines", "x_merge_files"])
def test_queries_against_sql(spark, name):
    import duckdb

    from parchlake.plans.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "part", "documents"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_sink_keeps_folders_and_refuses_clashes(spark, tmp_path):
    pdf.register(spark)
    made = edit.text_document(["x"]).to_bytes()
    rows = [("a/one", made), ("b/one.pdf", made), ("/far/two.pdf", made), ("none", None)]
    write = lambda rows, mode="append": spark.createDataFrame(rows, "path string, content binary").write.format("pdf").mode(mode).save(str(tmp_path / "out"))
    write(rows)
    names = lambda: sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.pdf"))
    assert names() == ["a/one.pdf", "b/one.pdf", "two.pdf"]
    for bad in ([("x", made), ("x.pdf", made)], [("/elsewhere/two", made)]):
        with pytest.raises(Exception, match="files of one name"):
            write(bad)
    assert names() == ["a/one.pdf", "b/one.pdf", "two.pdf"]
    write([("new", made)], "overwrite")
    assert names() == ["new.pdf"]


def test_arguments_of_rows_and_clashing_columns(spark):
    files = pdf.write_texts(spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "n int, t string"), "n", "t").withColumn("angle", F.col("n") * 90 + F.when(F.col("n") == 3, 1).otherwise(0))
    done = pdf.transform_bytes(files.withColumn("path", F.col("n").cast("string")), lambda doc, angle: edit.rotate(doc, [0], angle), args=("angle",))
    assert sorted((r["path"], r["rotate"]) for r in pdf.read_bytes(done, "pages").collect()) == [("1", 90), ("2", 180), ("2", 180)]
    df = spark.createDataFrame([("1-2", 3, "kept")], "s string, n int, ends string")
    got = pages.parse_ranges(df, "s", "n").first()
    assert got["ends"] == "kept" and got["pages"] == [0, 1]


def test_predictors_are_dealt_out(spark):
    from parchlake.plans.queries import QUERIES

    for name in ("f_predictors", "f_stream_filters"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().count() > 1, name


def test_slow_work_is_dealt_out(spark):
    one = spark.range(40).selectExpr("id AS doc_id", "'text' AS text", "'kept' AS more").coalesce(1)
    files = pdf.write_texts(one, "doc_id", "text")
    assert files.rdd.getNumPartitions() > 1 and files.groupBy(F.spark_partition_id()).count().count() > 1


def test_batches_hold_many_files(spark):
    files = pdf.write_texts(spark.range(30).selectExpr("id AS n", "'x' AS t"), "n", "t").coalesce(1).withColumn("path", F.col("n").cast("string"))
    assert pdf.read_bytes(files).count() == 30
    made = list(batched((({"a": k}, 1 << 20) for k in range(5)), pa.schema([("a", pa.int64())])))
    assert [b.num_rows for b in made] == [2, 2, 1]


def test_metadata_of_repeated_ids(spark, tmp_path):
    from parchlake.plans.queries import QUERIES

    rows = [(1, "en", "a"), (2, "de", "b"), (2, "fr", "c")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["title"], r["author"], r["subject"]) for r in QUERIES["m_file_metadata"](spark, str(tmp_path)).collect())
    assert got == [(1, "en", None, None), (2, "de", "b", None), (2, "fr", "c", None)]


def test_parts_end_as_soon_as_they_are_full():
    asked = []

    def sizes():
        for n in (BYTES, 1, BYTES, 1):
            asked.append(n)
            yield n

    assert [(s, len(asked)) for s in parts(sizes())] == [(slice(0, 1), 1), (slice(1, 3), 3), (slice(3, 4), 4)]


def test_merged_groups_share_batches(spark, monkeypatch):
    one = edit.text_document(["x"]).to_bytes()
    files = spark.createDataFrame([(k // 2, k, b"no pdf" if k == 5 else one) for k in range(20)], "g long, k long, content binary").coalesce(1)
    seen, kept = [], pa.RecordBatch.from_arrays

    def apart(df, fn, schema):
        b = kept([pa.array([0, 1, 2]), pa.array([[{"o": 0, "c": one}], [{"o": 0, "c": b"no pdf"}], [{"o": 0, "c": one}] * 2])], ["grp", "parts"])
        seen.extend(fn([b]))
        return real(df, fn, schema)

    real = type(files).mapInArrow
    monkeypatch.setattr(type(files), "mapInArrow", apart)
    got = {r["g"]: (r["content"] is None, r["error"] and r["error"]["code"]) for r in pdf.merge_bytes(files, "g", "k").collect()}
    assert got == {k: (k == 2, "NOT_A_PDF" if k == 2 else None) for k in range(10)}
    assert [b.num_rows for b in seen] == [3] and [x is None for x in seen[0].column(1).to_pylist()] == [False, True, False]
