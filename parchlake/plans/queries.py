"""Queries of the document operators on the driver's tables, each with SQL for the same rows where SQL has it.

A conversation stands for a document whose turns are its pages; a row of `documents` is a document of one page.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.batches import bounded, spread
from ..functions.chunking import chunk_documents, chunk_texts
from ..kernel import crypt, edit, filters
from ..kernel.document import Document
from ..operators import graph, pages
from ..operators.export import export_json, export_lines
from ..sources import pdf
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "text")


#: Hard split of texts (k, t) longer than a window, as rows (k, a0, piece); {size} and {over} are filled in.
_SPLIT = r"""
hs AS (SELECT k, t, 0::BIGINT AS pos, 0::BIGINT AS cut FROM long_units UNION ALL
  SELECT k, t, CASE WHEN e - {over} > pos THEN e - {over} ELSE e END, e FROM (
    SELECT k, t, pos, CASE WHEN pos + {size} >= length(t) THEN length(t)
      ELSE pos + CASE WHEN regexp_matches(substr(t, pos + {size} * 4 // 5 + 1, {size} // 5), '[.!?\n]')
        THEN {size} * 4 // 5 + length(regexp_extract(substr(t, pos + {size} * 4 // 5 + 1, {size} // 5), '(?s)^.*[.!?\n]')) ELSE {size} END END AS e
    FROM hs WHERE cut < length(t)) x),
pieces AS (SELECT k, b.a0, regexp_replace(substr(t, b.a0 + 1, b.e - b.a0), '^\s+|\s+$', '', 'g') AS piece FROM (
  SELECT k, t, pos AS nxt, cut AS e, lag(pos) OVER (PARTITION BY k ORDER BY cut) AS a0 FROM hs) b WHERE b.a0 IS NOT NULL)
"""

_Q1 = r"""
WITH RECURSIVE units AS (SELECT doc_id AS k, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
long_units AS (SELECT k, t FROM units WHERE length(t) > 2000),""" + _SPLIT.format(size=2000, over=200) + r""",
every AS (SELECT k, 0 AS a0, t AS piece FROM units WHERE length(t) <= 2000 AND t <> '' UNION ALL SELECT k, a0, piece FROM pieces WHERE piece <> '')
SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY a0) - 1)::INT AS chunk_id, 0 AS page_start, 0 AS page_end, piece AS text, length(piece)::INT AS char_count FROM every
"""


@query(_Q1)
def h_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")


_FOLD = r"""
WITH RECURSIVE u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn::INT AS page, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE regexp_matches(coalesce(text, ''), '\S')),
long_units AS (SELECT conv_id || '|' || i AS k, t FROM u WHERE length(t) > 600),""" + _SPLIT.format(size=600, over=100) + r""",
fold AS (
  SELECT conv_id, 0::BIGINT AS i, ''::VARCHAR AS held, 0 AS first, 0 AS last, NULL::VARCHAR AS out, 0 AS f, 0 AS l FROM (SELECT DISTINCT conv_id FROM u) c
  UNION ALL
  SELECT fold.conv_id, u.i,
    CASE WHEN length(u.t) > 600 THEN '' WHEN held = '' THEN u.t WHEN length(held) + length(u.t) + 2 > 600 THEN
      CASE WHEN length(held) <= 100 THEN held || chr(10) || chr(10) || u.t
        WHEN regexp_replace(regexp_extract(right(held, 100), '(?s)\s.*$'), '^\s+|\s+$', '', 'g') = '' THEN u.t
        ELSE regexp_replace(regexp_extract(right(held, 100), '(?s)\s.*$'), '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || u.t END
      ELSE held || chr(10) || chr(10) || u.t END,
    CASE WHEN length(u.t) > 600 OR held = '' OR length(held) + length(u.t) + 2 > 600 THEN u.page ELSE first END, u.page,
    CASE WHEN held <> '' AND (length(u.t) > 600 OR length(held) + length(u.t) + 2 > 600) THEN held END, first, last
  FROM fold JOIN u ON u.conv_id = fold.conv_id AND u.i = fold.i + 1),
every AS (
  SELECT conv_id, i, 0::BIGINT AS a0, out AS text, f AS page_start, l AS page_end FROM fold WHERE out IS NOT NULL
  UNION ALL SELECT u.conv_id, u.i, a0 + 1, piece, page, page FROM pieces JOIN u ON k = conv_id || '|' || i WHERE piece <> ''
  UNION ALL SELECT conv_id, i + 1, 0, held, first, last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS r FROM fold) z WHERE r = 1 AND held <> ''),
chunks AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i, a0) - 1)::INT AS chunk_id, page_start::INT AS page_start, page_end::INT AS page_end, text, length(text)::INT AS char_count FROM every)
"""


@query(_FOLD + "SELECT * FROM chunks")
def h_chunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(_turns(spark, sf_dir), "conv_id", "turn", "text", 600, 100)


#: (spec, blank is all): ranges that every conversation is asked for.
SPECS = ("", "1-2", "2,1,2", "1,99", "2-1", "x", " 1 , , 2 ")


@query(r"""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT * FROM (VALUES (0, ''), (1, '1-2'), (2, '2,1,2'), (3, '1,99'), (4, '2-1'), (5, 'x'), (6, ' 1 , , 2 ')) v(spec_no, spec)),
c AS (SELECT conv_id, n, spec_no, CASE spec_no WHEN 0 THEN range(0, n) WHEN 1 THEN [0, 1] WHEN 2 THEN [1, 0, 1] WHEN 6 THEN [0, 1] END AS p,
  CASE WHEN spec_no IN (4, 5) THEN 'ERROR' WHEN spec_no = 3 AND n < 99 OR spec_no IN (1, 2, 6) AND n < 2 THEN 'PAGE_OUT_OF_RANGE' END AS code FROM n, s)
SELECT conv_id, spec_no, code, CASE WHEN code IS NULL THEN array_to_string(list_transform(p, lambda x: x::VARCHAR), ',') END AS pages FROM c
""")
def r_parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    specs = F.explode(F.array(*(F.struct(F.lit(i).alias("spec_no"), F.lit(s).alias("spec")) for i, s in enumerate(SPECS))))
    out = pages.parse_ranges(n.select("conv_id", "n", specs.alias("s")).select("conv_id", "n", "s.*"), "spec", "n")
    return out.select("conv_id", "spec_no", "code", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, unnest([n - 1, 0, n - 1])::INT AS turn, unnest([0, 1, 2])::INT AS new_index FROM n)
SELECT conv_id, turn::INT AS turn, new_index, text FROM w JOIN (SELECT conv_id, turn::INT AS turn, text FROM conversations) USING (conv_id, turn)
""")
def r_select_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    n = t.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    wanted = n.select("conv_id", F.array(F.col("n") - 1, F.lit(0), F.col("n") - 1).alias("pages"))
    return pages.select_pages(t, wanted, "conv_id", "turn").select("conv_id", "turn", "new_index", "text")


@query("SELECT conv_id, turn::INT AS turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS new_index FROM conversations WHERE turn % 3 <> 1")
def r_delete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return pages.delete_pages(t, t.where("turn % 3 = 1"), "conv_id", "turn").select("conv_id", "turn", "new_index")


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, turn::INT AS turn, conv_id % 2 = 0 AS valid, (CASE WHEN conv_id % 2 = 0 THEN n - 1 - turn ELSE turn END)::INT AS new_index FROM conversations JOIN n USING (conv_id)
""")
def r_reorder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversed where the conversation's number is even; elsewhere an order with a page too many, which is invalid."""
    t = _turns(spark, sf_dir)
    n = t.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    order = t.join(n, "conv_id").select("conv_id", (F.col("n") - 1 - F.col("turn")).alias("new_index"), "turn")
    extra = n.where("conv_id % 2 = 1").select("conv_id", F.col("n").alias("new_index"), F.col("n").alias("turn"))
    return pages.reorder_pages(t, order.unionByName(extra), "conv_id", "turn").select("conv_id", "turn", "valid", "new_index")


@query(r"SELECT conv_id || '-' || turn AS doc, 0 AS page_index, regexp_replace(text, '[ \n]+$', '') AS text FROM conversations")
def r_split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are split into files of one page, and these are read."""
    files = pdf.write_text_pdfs(_turns(spark, sf_dir), "conv_id", "turn", "text").withColumn("path", F.col("conv_id").cast("string"))
    parts = pdf.split_bytes(files).withColumn("path", F.concat_ws("-", "path", "part"))
    return pdf.read_bytes(parts, "text").select(F.col("path").alias("doc"), "page_index", "text")


@query(r"""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), t AS (SELECT conv_id, turn, n, regexp_replace(text, '[ \n]+$', '') AS text FROM conversations JOIN n USING (conv_id))
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'PAGE_OUT_OF_RANGE' END AS code, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE (CASE conv_id % 3 WHEN 1 THEN n - 1 - turn ELSE turn END)::INT END AS page_index,
  CASE WHEN conv_id % 3 <> 0 THEN text END AS text FROM t WHERE conv_id % 3 = 1 OR turn = 0
""")
def r_select_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's own page spec: the first page, all pages from the last to the first, or a page that isn't there."""
    files = pdf.write_text_pdfs(_turns(spark, sf_dir), "conv_id", "turn", "text").withColumn("path", F.col("conv_id").cast("string"))
    n = _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    backwards = F.array_join(F.transform(F.sequence(F.col("n"), F.lit(1)), lambda x: x.cast("string")), ",")
    specs = n.withColumn("spec", F.when(F.col("conv_id") % 3 == 0, F.lit("999999")).when(F.col("conv_id") % 3 == 1, backwards).otherwise(F.lit("1")))
    change = lambda doc, spec: edit.extract(doc, edit.ranges(spec, doc.page_count()))
    done = pdf.transform_bytes(files.join(specs, "conv_id"), change, args=("spec",))
    got = pdf.read_bytes(done.where("error is null"), "text").select("path", F.lit(None).cast("string").alias("code"), "page_index", "text")
    failed = done.where("error is not null").select("path", F.col("error.code").alias("code"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("string").alias("text"))
    return got.unionByName(failed).select(F.col("path").cast("long").alias("conv_id"), "code", "page_index", "text")


@query("SELECT conv_id // 10 AS target, conv_id, turn::INT AS turn, (row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) - 1)::INT AS new_index FROM conversations")
def x_merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("target", F.expr("conv_id div 10"))
    return pages.merge_documents(t, "conv_id", "turn", F.col("target")).select("target", "conv_id", "turn", "new_index")


@query("SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def e_joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.joined_text(_turns(spark, sf_dir), "conv_id", "turn", "text")


@query(r"SELECT conv_id, turn::INT AS page_index, length(regexp_replace(text, '[ \n]+$', ''))::INT AS char_count FROM conversations")
def e_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pdf.write_text_pdfs(_turns(spark, sf_dir), "conv_id", "turn", "text").withColumn("path", F.col("conv_id").cast("string"))
    return pdf.read_bytes(files, "text").select(F.col("path").cast("long").alias("conv_id"), "page_index", "char_count")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as a page tree; a turn of 90 is set on every third nation."""
    region, nation, customer = (_table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    own = F.when(F.col("n_nationkey") % 3 == 0, F.lit(90))
    edges = region.select(F.lit(0).alias("doc"), F.lit("root").alias("parent"), F.col("r_regionkey").alias("ordinal"), F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit(None).cast("int").alias("rotate"))
    edges = edges.unionByName(nation.select(F.lit(0).alias("doc"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("n"), "n_nationkey").alias("child"), own.cast("int").alias("rotate")))
    edges = edges.unionByName(customer.select(F.lit(0).alias("doc"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").cast("int").alias("ordinal"), F.concat(F.lit("c"), "c_custkey").alias("child"), F.when(F.col("c_custkey") % 10 == 0, 180).cast("int").alias("rotate")))
    roots = spark.range(1).select(F.lit(0).alias("doc"), F.lit("root").alias("node"), F.lit(270).alias("rotate"))
    return edges, roots


@query("""
SELECT 'c' || c_custkey AS node, n_regionkey || '/' || n_nationkey || '/' || c_custkey AS path, 3 AS depth,
  CASE WHEN c_custkey % 10 = 0 THEN 180 WHEN n_nationkey % 3 = 0 THEN 90 ELSE 270 END AS rotate
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def p_walk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, roots = _tree(spark, sf_dir)
    walked = graph.walk_tree(spark, edges, roots, ("rotate",))
    leaves = walked.join(edges.select("doc", F.col("parent").alias("node")).distinct(), ["doc", "node"], "left_anti")
    return leaves.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "depth", "rotate")


@query("""
SELECT p_partkey, (((p_size * 45 % 360) + 360) % 360)::BIGINT AS rotation,
  CASE WHEN (p_size * 45 - p_partkey % 5 * 90) % 90 = 0 THEN (((p_size * 45 - p_partkey % 5 * 90) % 360 + 360) % 360)::BIGINT END AS turned FROM part
""")
def t_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    rotate = F.col("p_size") * 45
    return p.select("p_partkey", pages.rotation(rotate).alias("rotation"), pages.rotation(rotate, -(F.col("p_partkey") % 5) * 90).alias("turned"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 0.0 END AS x0, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 10 ELSE 612.0 END AS x1,
  CASE WHEN p_size % 2 = 0 THEN p_retailprice / 10 > p_size ELSE true END AS valid FROM part
""")
def t_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    own = F.when(F.col("p_size") % 2 == 0, F.struct(F.col("p_size").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("p_retailprice") / 10).alias("x1"), F.lit(792.0).alias("y1")))
    b = p.select("p_partkey", pages.box(own).alias("b"))
    return b.select("p_partkey", "b.x0", "b.x1", pages.valid_box(F.col("b")).alias("valid"))


def _order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects (orders, lines' parts, parts' suppliers) with edges, and every tenth order as a root."""
    line = _table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = line.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).unionByName(line.where("l_linenumber = 1").select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"))).distinct()
    orders, part, supplier = (_table(spark, sf_dir, n) for n in ("orders", "part", "supplier"))
    objects = orders.select(name("o", "o_orderkey").alias("node")).unionByName(part.select(name("p", "p_partkey").alias("node"))).unionByName(supplier.select(name("s", "s_suppkey").alias("node")))
    roots = orders.where("o_orderkey % 10 = 0").select(name("o", "o_orderkey").alias("node"))
    zero = F.lit(0).alias("doc")
    return objects.select(zero, "*"), edges.select(zero, "*"), roots.select(zero, "*")


_GRAPH = """
WITH RECURSIVE e AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber = 1),
o AS (SELECT 'o' || o_orderkey AS node FROM orders UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier),
r AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 10 = 0 UNION SELECT dst FROM r JOIN e ON src = node)
"""


@query(_GRAPH + "SELECT node FROM o WHERE node IN (SELECT node FROM r)")
def g_collect_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, edges, roots = _order_graph(spark, sf_dir)
    return graph.collect_garbage(objects, edges, roots).select("node")


@query("""
WITH c AS (SELECT c_nationkey AS doc, c_custkey AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS new_node FROM customer)
SELECT o_orderkey, a.new_node AS new_src, b.new_node AS new_dst FROM orders JOIN c a ON a.node = o_custkey LEFT JOIN c b ON b.doc = a.doc AND b.node = o_custkey + o_orderkey % 50
""")
def x_rewrite_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation are a document's objects, in a new order; an order refers from its customer to another,
    who mostly is of another nation: such references become null."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("node"), "c_acctbal")
    numbers = graph.renumbered(c, [F.desc("c_acctbal"), "node"])
    edges = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 50).alias("dst"))
    edges = edges.join(c.select("doc", F.col("node").alias("src")), "src")
    return graph.rewrite_references(edges, numbers).select("o_orderkey", "new_src", "new_dst")


@query("SELECT l_orderkey, l_linenumber, p_name AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + (l_linenumber % 2) * 1000000000")
def g_resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even numbers refer to their part, others to what isn't there."""
    refs = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("doc"), (F.col("l_partkey") + (F.col("l_linenumber") % 2) * 1000000000).alias("dst"))
    parts = _table(spark, sf_dir, "part").select(F.lit(0).alias("doc"), F.col("p_partkey").alias("node"), F.col("p_name").alias("value"))
    return graph.resolve(refs, parts).select("l_orderkey", "l_linenumber", "value")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def s_newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.newest(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("""
SELECT doc_id, CASE WHEN quality IS NULL THEN source WHEN quality = 0 THEN NULL ELSE lang END AS title FROM documents LEFT JOIN labels USING (doc_id)
""")
def m_update_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    new = F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, F.col("lang"))
    return d.select("doc_id", strings.updated(F.col("source"), new).alias("title"))


@query("SELECT doc_id, text AS decoded, (CASE WHEN regexp_full_match(text, '[\\x00-\\x7F]*') THEN length(text) ELSE 2 + 2 * length(text) END)::INT AS n_bytes FROM documents".replace("\\\\", "\\"))
def m_text_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "documents").select("doc_id", strings.encode_text(F.col("text")).alias("raw"))
    return raw.select("doc_id", strings.decode_text(F.col("raw")).alias("decoded"), F.octet_length("raw").alias("n_bytes"))


@query("SELECT item_id, text AS decoded FROM benchmark")
def f_ascii_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "benchmark")
    spaced = F.concat(F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(.{60})", "$1\n"), F.lit(">"))
    return b.select("item_id", F.decode(strings.decode_hex(spaced), "UTF-8").alias("decoded"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, text AS plain FROM documents")
def c_digests_and_aes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    key, iv = F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))
    sealed = d.select("doc_id", "text", key.alias("key"), strings.aes_encrypt_cbc(F.encode("text", "UTF-8"), key, iv).alias("sealed"))
    return sealed.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("md5"), F.sha2("text", 256).alias("sha256"), F.decode(strings.aes_decrypt_cbc(F.col("sealed"), F.col("key")), "UTF-8").alias("plain"))


@query(r"SELECT doc_id, regexp_replace(text, '[ \n]+$', '') AS text, length(regexp_replace(text, '[ \n]+$', ''))::INT AS char_count FROM documents")
def s_write_parse_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents become files and are parsed, and their text is extracted."""
    files = pdf.write_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    got = pdf.read_bytes(files.withColumn("path", F.col("doc_id").cast("string")), "text")
    return got.select(F.col("path").cast("long").alias("doc_id"), "text", "char_count")


@query("SELECT conv_id, '1.4' AS version, false AS encrypted, (3 + 2 * count(*))::INT AS object_count, count(*)::INT AS page_count FROM conversations GROUP BY conv_id")
def g_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog, page tree and font, and a page and its content for each turn."""
    files = pdf.write_text_pdfs(_turns(spark, sf_dir), "conv_id", "turn", "text")
    got = pdf.read_bytes(files.withColumn("path", F.col("conv_id").cast("string")), "meta")
    return got.select(F.col("path").cast("long").alias("conv_id"), "version", "encrypted", "object_count", "page_count")


@query("""
SELECT conv_id, turn::INT AS page_index, ((turn + 1) * 90 % 360)::INT AS rotate, 10.0::DOUBLE AS crop_x0, 612.0::DOUBLE AS media_x1 FROM conversations
""")
def t_rotate_and_crop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are changed page by page, written, and read again."""

    def change(doc: Document) -> Document:
        for k in range(len(doc.page_refs())):
            edit.rotate(doc, [k] * (k + 1), 90)
            edit.set_box(doc, k, 10, 10, 300, 300)
        return doc

    files = pdf.write_text_pdfs(_turns(spark, sf_dir), "conv_id", "turn", "text").withColumn("path", F.col("conv_id").cast("string"))
    got = pdf.read_bytes(pdf.transform_bytes(files, change), "pages")
    return got.select(F.col("path").cast("long").alias("conv_id"), "page_index", "rotate", F.col("crop_box.x0").alias("crop_x0"), F.col("media_box.x1").alias("media_x1"))


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[ \n]+$', '') AS text FROM conversations)
SELECT conv_id // 10 AS target, (row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) - 1)::INT AS page_index, text FROM t
""")
def x_merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pdf.write_text_pdfs(_turns(spark, sf_dir), "conv_id", "turn", "text").withColumn("target", F.expr("conv_id div 10"))
    merged = pdf.merge_bytes(files, "target", "conv_id").withColumn("path", F.col("target").cast("string"))
    return pdf.read_bytes(merged, "text").select(F.col("path").cast("long").alias("target"), "page_index", "text")


@query(r"SELECT item_id, regexp_replace(text, '[ \n]+$', '') AS text, 'ENCRYPTED' AS without_password, 'WRONG_PASSWORD' AS with_wrong FROM benchmark")
def c_encrypt_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted with random keys, then opened with the right password, none, and a wrong one."""
    files = pdf.write_text_pdfs(_table(spark, sf_dir, "benchmark").withColumn("page", F.lit(0)), "item_id", "page", "text").withColumn("path", F.col("item_id").cast("string"))
    locked = pdf.transform_bytes(files, lambda doc: crypt.encrypt(doc, "user", "owner"))
    tries = F.explode(F.array(F.lit("user"), F.lit(""), F.lit("bad")))
    got = pdf.read_bytes(locked.withColumn("password", tries).withColumn("path", F.concat_ws("|", "path", "password")), "text", password_col="password")
    got = got.select(F.split_part("path", F.lit("|"), F.lit(1)).cast("long").alias("item_id"), F.split_part("path", F.lit("|"), F.lit(2)).alias("pw"), "text", F.col("error.code").alias("code"))
    pick = lambda pw, c: F.max(F.when(F.col("pw") == pw, F.col(c)))
    return got.groupBy("item_id").agg(pick("user", "text").alias("text"), pick("", "code").alias("without_password"), pick("bad", "code").alias("with_wrong"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def f_stream_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flate, ASCIIHex and base-85 chains are undone."""
    import base64
    import hashlib

    from ..kernel.model import Name

    def fn(batches):  # noqa: ANN001, ANN202
        d = {"Filter": [Name("ASCII85Decode"), Name("ASCIIHexDecode"), Name("FlateDecode")]}
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                raw = base64.a85encode(filters.deflate((t or "").encode()).hex().encode() + b">") + b"~>"
                out.append(hashlib.md5(filters.decode_stream(d, raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "md5"])

    bounded(spark)
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(fn, "doc_id long, md5 string")


@query(_FOLD + r""", lines AS (SELECT conv_id, chunk_id + 1 AS line_no, 'chunk' AS kind, page_start, text, NULL::INT AS page_count FROM chunks
UNION ALL SELECT conv_id, 0, 'document', NULL, NULL, count(*)::INT FROM conversations GROUP BY conv_id)
SELECT conv_id, line_no::INT AS line_no, kind, page_start::INT AS page_start, text, page_count FROM lines""")
def s_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = export_lines(_turns(spark, sf_dir), "conv_id", "turn", "text", max_chars=600, overlap=100)
    x = F.from_json("line", "kind string, page_start int, text string, page_count int")
    return lines.select("conv_id", "line_no", x.alias("x")).select("conv_id", "line_no", "x.*")


@query(_FOLD + """SELECT conv_id, count(DISTINCT turn)::INT AS page_count, any_value(n)::INT AS chunk_count FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM chunks GROUP BY conv_id) USING (conv_id) GROUP BY conv_id""")
def s_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = export_json(_turns(spark, sf_dir), "conv_id", "turn", "text", max_chars=600, overlap=100)
    x = F.from_json("json", "page_count int, chunks array<struct<id:int>>")
    return out.select("conv_id", x.alias("x")).select("conv_id", "x.page_count", F.size("x.chunks").alias("chunk_count"))


@query(r"SELECT doc_id, regexp_replace(text, '[ \n]+$', '') AS text FROM documents")
def s_compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with object streams and a cross-reference stream behind a predictor are read."""
    files = pdf.write_texts(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("path", F.col("doc_id").cast("string"))
    got = pdf.read_bytes(pdf.transform_bytes(files, fixtures.compact), "text")
    return got.select(F.col("path").cast("long").alias("doc_id"), "text")


@query("SELECT doc_id, kind, md5(text) AS md5 FROM documents, (VALUES ('png'), ('tiff')) k(kind)")
def f_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flate streams behind all five PNG row filters, and behind the TIFF predictor with three colors, are undone."""
    import hashlib

    from ..kernel.model import Name

    png = {"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 15, "Columns": 20, "Colors": 3}}
    tiff = {"Filter": [Name("Fl")], "DP": [{"Predictor": 2, "Columns": 20, "Colors": 3}]}

    def fn(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (t or "").encode()
                for kind, d, held in (("png", png, fixtures.png_encoded(raw, 60, 3)), ("tiff", tiff, fixtures.tiff_encoded(raw, 60, 3))):
                    out.append({"doc_id": i, "kind": kind, "md5": hashlib.md5(filters.decode_stream(d, filters.deflate(held))).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("md5", pa.string())]))

    bounded(spark)
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(fn, "doc_id long, kind string, md5 string")


@query(r"SELECT item_id, version, regexp_replace(text, '[ \n]+$', '') AS by_user, regexp_replace(text, '[ \n]+$', '') AS by_owner, 'WRONG_PASSWORD' AS with_wrong FROM benchmark, (VALUES (1), (2), (4)) v(version)")
def c_legacy_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under RC4 of 40 and 128 bits and under AES-128 are opened by either password, and not by a wrong one."""
    files = pdf.write_texts(_table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    files = files.withColumn("path", F.concat_ws("|", "item_id", "version"))
    locked = pdf.transform_bytes(files, lambda doc, version: fixtures.legacy_encrypted(doc, "user", "owner", version), args=("version",))
    tries = F.explode(F.array(F.lit("user"), F.lit("owner"), F.lit("bad")))
    got = pdf.read_bytes(locked.withColumn("password", tries).withColumn("path", F.concat_ws("|", "path", "password")), "text", password_col="password")
    at = lambda k: F.split_part("path", F.lit("|"), F.lit(k))
    got = got.select(at(1).cast("long").alias("item_id"), at(2).cast("int").alias("version"), at(3).alias("pw"), "text", F.col("error.code").alias("code"))
    pick = lambda pw, c: F.max(F.when(F.col("pw") == pw, F.col(c)))
    return got.groupBy("item_id", "version").agg(pick("user", "text").alias("by_user"), pick("owner", "text").alias("by_owner"), pick("bad", "code").alias("with_wrong"))


@query(r"""
WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(1, 6), lambda i: CASE i WHEN 2 THEN 'AB!' WHEN 4 THEN '漢字😀' ELSE 'x' END || coalesce(w[i], '')), chr(10) || chr(10)) AS text FROM w
""")
def n_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words by five ways of showing text: encodings, differences, Unicode maps, forms, graphics and text state."""
    import re

    def fn(batches):  # noqa: ANN001, ANN202
        for b in batches:
            made = []
            for t in b.column(1).to_pylist():
                w = [*re.findall("[A-Za-z0-9]+", t or ""), *[""] * 5][:5]
                made.append(fixtures.many_fonts(*(x + y for x, y in zip(("x", "AB!", "x", "漢字😀", "x"), w, strict=True))).to_bytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    files = _table(spark, sf_dir, "benchmark").select("item_id", "text").mapInArrow(fn, "path string, content binary")
    return pdf.read_bytes(files, "text").select(F.col("path").cast("long").alias("item_id"), "text")


@query("""
SELECT doc_id, lang AS title, CASE WHEN doc_id % 2 = 0 THEN source END AS author, NULL::VARCHAR AS subject FROM documents
""")
def m_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's own update as JSON: a title, an author or none, and a subject that is set and then deleted."""
    from .. import api

    d = _table(spark, sf_dir, "documents")
    update = F.to_json(F.struct(F.col("lang").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("author"), F.lit("gone é").alias("subject")))
    files = pdf.write_texts(d.select("doc_id", F.lit("").alias("none"), update.alias("update")), "doc_id", "none", keep=("update",)).withColumn("path", F.col("doc_id").cast("string"))
    change = lambda doc, new: api.set_metadata(api.set_metadata(doc.to_bytes(), new), {"subject": ""})
    got = pdf.read_bytes(pdf.transform_bytes(files, change, args=("update",)), "meta")
    return got.select(F.col("path").cast("long").alias("doc_id"), "metadata.title", "metadata.author", "metadata.subject")
