"""Document, retrieval and routing queries over the benchmark tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import questions as Q
from ..operators import retrieval as R
from ..plans.adapters import document_pages, table
from .sql import bare, concat_nonempty, q, split_text, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


_PAGES = """
ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pn AS (SELECT doc_id, l, unnest(range(0, len(l), 20)) AS s FROM ls),
pg AS (SELECT doc_id, s // 20 + 1 AS page, array_to_string(l[s + 1 : s + 20], chr(10)) AS text FROM pn)
"""


@query("document_pages", with_(_PAGES, body="SELECT doc_id, page, text FROM pg"))
def document_pages_q(spark, sf):
    return document_pages(spark, sf)


@query("document_titles", with_(_PAGES, """
tl AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS f FROM pg)""",
    body="SELECT doc_id, substr(array_to_string((arg_min(f, page))[1:3], ' | '), 1, 180) AS title FROM tl WHERE len(f) > 0 GROUP BY 1"))
def document_titles(spark, sf):
    return C.document_titles(document_pages(spark, sf))


def dated_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a period line or a small table put after the text, by page id."""
    p = document_pages(spark, sf)
    k = (F.col("doc_id") + F.col("page")) % 4
    extra = (
        F.when(k == 0, "\nStatement for september 2025 follows")
        .when(k == 1, "\nStatement period: 07/01/25 - 07/31/25.")
        .when(k == 2, "\n  Post Date   Vendor  Total \n\n 07/03 Grainger 12.00\nnotes")
        .otherwise("")
    )
    return p.withColumn("text", F.concat("text", extra))


_DATED = """
dp AS (SELECT doc_id, page, text || CASE (doc_id + page) % 4 WHEN 0 THEN chr(10) || 'Statement for september 2025 follows'
  WHEN 1 THEN chr(10) || 'Statement period: 07/01/25 - 07/31/25.'
  WHEN 2 THEN chr(10) || '  Post Date   Vendor  Total ' || chr(10) || chr(10) || ' 07/03 Grainger 12.00' || chr(10) || 'notes' ELSE '' END AS text FROM pg)
"""
_MY = r"(?i)\b(" + C.MONTHS + r")\s+(\d{4})\b"


@query("period_labels", with_(_PAGES, _DATED, body=f"""
SELECT doc_id, page, CASE WHEN regexp_matches(text, {q(_MY)}) THEN upper(substr(regexp_extract(text, {q(_MY)}, 1), 1, 1)) || lower(substr(regexp_extract(text, {q(_MY)}, 1), 2)) || ' ' || regexp_extract(text, {q(_MY)}, 2)
  ELSE nullif(substr(trim(regexp_extract(text, {q(C.PERIOD)}, 1), ' .;'), 1, 40), '') END AS label FROM dp"""))
def period_labels(spark, sf):
    return dated_pages(spark, sf).select("doc_id", "page", C.period_label(F.col("text")).alias("label"))


@query("column_headers", with_(_PAGES, _DATED, """
cl AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS f FROM dp),
ch AS (SELECT doc_id, page, list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN regexp_matches(coalesce(f[i + 1], ''), '^[\\d$(]')
  AND regexp_matches(f[i], '(?i)(date|description|amount|balance|withdraw|deposit|credit|debit|vendor|payee|qty|total)') AND regexp_matches(f[i], '\\S\\s+\\S') THEN f[i] END), lambda x: x IS NOT NULL) AS h FROM cl)""".replace("\\\\", "\\"),
    body="SELECT doc_id, page, coalesce(substr(h[1], 1, 160), '') AS header FROM ch"))
def column_headers(spark, sf):
    return dated_pages(spark, sf).select("doc_id", "page", C.column_header(F.col("text")).alias("header"))


@query("split_chunks", "WITH RECURSIVE " + _PAGES.strip() + ",\n" + split_text("pg", C.SEPARATORS, C.CHUNK_SIZE, C.OVERLAP).strip() +
       "\nSELECT doc_id, page, chunk_no, text FROM chunks")
def split_chunks(spark, sf):
    return C.split_pages(document_pages(spark, sf), ["doc_id"])


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {bare('x')}), lambda x: x <> '')"
_CONTEXT = f"""
fp AS (SELECT * FROM (SELECT doc_id, page, {bare('text')} AS text FROM dp) WHERE text <> ''),
fl AS (SELECT *, {_LINES} AS f FROM fp),
ti AS (SELECT doc_id, substr(array_to_string((arg_min(f, page))[1:3], ' | '), 1, 180) AS title FROM fl GROUP BY 1),
he AS (SELECT doc_id, page, text, title, substr(coalesce(list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN regexp_matches(coalesce(f[i + 1], ''), '^[\\d$(]')
  AND regexp_matches(f[i], '{C.HEADER_WORDS}') AND regexp_matches(f[i], '\\S\\s+\\S') THEN f[i] END), lambda x: x IS NOT NULL)[1], ''), 1, 160) AS head
  FROM fl LEFT JOIN ti USING (doc_id)),
px AS (SELECT *, {concat_nonempty(' || ', ["nullif(title, '')", "nullif(head, '')"])} AS prefix FROM he),
lp AS (SELECT doc_id, page, text FROM px WHERE length(text) > {C.WHOLE_PAGE}),
{split_text('lp', C.SEPARATORS, C.CHUNK_SIZE, C.OVERLAP).strip()},
ac AS (SELECT doc_id, page, prefix, 1 AS chunk_no, text FROM px WHERE length(text) <= {C.WHOLE_PAGE}
  UNION ALL SELECT doc_id, page, prefix, chunk_no, chunks.text FROM chunks JOIN px USING (doc_id, page))
SELECT doc_id, page, prefix, chunk_no, CASE WHEN prefix <> '' AND NOT contains(substr(text, 1, length(prefix) + 5), prefix)
  THEN '[' || prefix || ']' || chr(10) || text ELSE text END AS text FROM ac"""


@query("context_chunks", "WITH RECURSIVE " + _PAGES.strip() + ",\n" + _DATED.strip() + "," + _CONTEXT)
def context_chunks(spark, sf):
    return C.context_chunks(dated_pages(spark, sf))


# --- retrieval ------------------------------------------------------------------------

_COS = """
qv AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id, label, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) /
  ((sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8) * (sqrt(list_inner_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[]))) + 1e-8)) AS sim FROM embeddings, qv)
"""


def query_vector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id = 0").select("embedding")


@query("cosine_top_k", with_(_COS, body="SELECT vec_id, round(sim, 6) AS similarity FROM cs ORDER BY sim DESC, vec_id LIMIT 6"))
def cosine_top_k(spark, sf):
    top = R.cosine_top_k(table(spark, sf, "embeddings"), query_vector(spark, sf))
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as chunks of document sets of very different size."""
    e = table(spark, sf, "embeddings")
    few = F.col("vec_id") % 5 == 0
    return e.select(
        F.when(few, F.concat(F.lit("small_"), F.floor(F.col("vec_id") / 40).cast("string"))).otherwise(
            F.concat(F.lit("set_"), F.col("label").cast("string"))).alias("doc_set"),
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 9 + 1).cast("int").alias("page"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), "embedding",
    )


_SETS = _COS.strip() + """,
ck AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'small_' || CAST(vec_id // 40 AS VARCHAR) ELSE 'set_' || CAST(label AS VARCHAR) END AS doc_set, vec_id AS chunk_id,
  vec_id % 9 + 1 AS page, 'chunk ' || CAST(vec_id AS VARCHAR) AS text, sim FROM cs),
rk AS (SELECT *, count(*) OVER (PARTITION BY doc_set) AS n, row_number() OVER (PARTITION BY doc_set ORDER BY sim DESC, chunk_id) AS rn,
  row_number() OVER (PARTITION BY doc_set ORDER BY chunk_id) AS pos FROM ck),
rt AS (SELECT *, CASE WHEN n <= 10 THEN pos ELSE rn END AS rank FROM rk WHERE n <= 10 OR rn <= 6)
"""


@query("retrieved_chunks", "WITH " + _SETS + "SELECT doc_set, chunk_id, rank FROM rt")
def retrieved_chunks(spark, sf):
    return R.retrieve(vector_chunks(spark, sf), query_vector(spark, sf)).select("doc_set", "chunk_id", "rank")


_ASKED = {
    "answered": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
    "one row": "SELECT count(*) AS n, max(o_orderpriority) AS top FROM orders",
    "no row": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice < 0",
    "one null row": "SELECT max(o_orderkey) AS k, max(o_orderpriority) AS p FROM orders WHERE o_totalprice < 0",
}


@query("answered_or_retrieved", "WITH " + _SETS.rstrip().rstrip(",") + f""",
a1 AS ({_ASKED["answered"]}), a2 AS ({_ASKED["one row"]})
SELECT 'answered' AS question, 'tables' AS source, CAST(NULL AS INTEGER) AS rank, o_orderpriority || ' | ' || CAST(n AS VARCHAR) AS text FROM a1
UNION ALL SELECT 'one row', 'tables', NULL, CAST(n AS VARCHAR) || ' | ' || top FROM a2
UNION ALL SELECT question, 'documents', rank, text FROM rt, (SELECT unnest(['no row', 'one null row']) AS question)""")
def answered_or_retrieved(spark, sf):
    """Four questions to the tables; two have no answer there and go to the documents."""
    Q.register_tables({"orders": table(spark, sf, "orders")})
    chunks = R.retrieve(vector_chunks(spark, sf), query_vector(spark, sf))
    asked = [Q.answer_or_retrieve(spark.sql(text), chunks).withColumn("question", F.lit(name)) for name, text in _ASKED.items()]
    return reduce(DataFrame.unionByName, asked)


@query("loaded_tables", "SELECT 'upload_customer' AS table_name UNION SELECT 'upload_orders' UNION SELECT source || '.pdf' FROM documents")
def loaded_tables(spark, sf):
    """Two uploaded tables and the files that the documents came from."""
    Q.register_tables({f"upload_{name}": table(spark, sf, name) for name in ("orders", "customer")})
    files = table(spark, sf, "documents").select(F.concat("source", F.lit(".pdf")).alias("file_name"))
    return Q.table_names(spark, "upload_*", files)


@query("context_blocks", "WITH " + _SETS + """SELECT doc_set, string_agg('[' || CAST(rank AS VARCHAR) || '] (p.' || CAST(page AS VARCHAR) || ') ' || text, chr(10) || chr(10) ORDER BY rank) AS context,
  array_to_string(list_transform(list_sort(list(DISTINCT page)), lambda p: CAST(p AS VARCHAR)), ', ') AS source_pages, count(*) AS chunks_used FROM rt GROUP BY 1""")
def context_blocks(spark, sf):
    b = R.context_block(R.retrieve(vector_chunks(spark, sf), query_vector(spark, sf)))
    return b.withColumn("source_pages", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ", "))


# --- routing ---------------------------------------------------------------------------

_CUES = "CASE conv_id % 6 WHEN 0 THEN ' In the PDF?' WHEN 1 THEN ' from the spreadsheet' WHEN 2 THEN ' in the table, on the statement' WHEN 3 THEN ' 문서에서' ELSE '' END"


def _hit(cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(question), {q(c)})" for c in cues) + ")"


@query("question_routes", f"""WITH qs AS (SELECT conv_id, turn, text || {_CUES} AS question, conv_id % 2 = 0 AS t, conv_id % 3 = 0 AS d FROM conversations WHERE role = 'user'),
  h AS (SELECT *, {_hit(Q.DOCUMENT_CUES)} AS rh, {_hit(Q.TABLE_CUES)} AS sh FROM qs)
  SELECT conv_id, turn, CASE WHEN rh AND NOT sh AND d THEN 'rag' WHEN sh AND NOT rh AND t THEN 'sql' WHEN t AND d THEN 'sql_then_rag' WHEN t THEN 'sql' WHEN d THEN 'rag' ELSE 'general' END AS route FROM h""")
def question_routes(spark, sf):
    k = F.col("conv_id") % 6
    cue = F.when(k == 0, " In the PDF?").when(k == 1, " from the spreadsheet").when(k == 2, " in the table, on the statement").when(k == 3, " 문서에서").otherwise("")
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", Q.route(F.concat("text", cue), F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 == 0).alias("route"))
