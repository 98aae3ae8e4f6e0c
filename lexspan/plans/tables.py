"""The given tables, and the corpus tables Spark derives from them.

The corpus views stand the given tables in for a document collection: ``documents`` and
``benchmark`` carry metadata, ``documents`` and ``pages`` carry content, ``lineitem``
carries relationships. Every view covers its whole source tables. ``VIEWS_SQL`` states
the same views for the SQL oracle, one common table expression per view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.sources.readers import read_in_order, read_with_place


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rebalance rows by a unique key when the input has fewer splits than half the cores,
    as with one file of one row group, which Spark reads in one task. The given tables are
    such files. It belongs to reading them; the operators behind it have one plan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


# Values given to the languages and sources of the driver tables.
SCOPE_OF_LANGUAGE = {"en": "Trung ương", "fr": "  TRUNG   ƯƠNG ", "de": "Tuyên Quang", "es": "Toàn quốc"}
ISSUER_OF_SOURCE = {
    "src0": "Bộ Tài chính, UBND tỉnh An Giang", "src1": "Bộ Lao động", "src2": "Chính phủ", "src3": "Chưa xác định",
    "src4": "Quốc hội", "src5": "Sở Tư pháp", "src6": "Bộ  Nội vụ", "src7": "", "src8": "Thủ tướng Chính phủ",
    "src9": "Công ty A", "src10": "Ngân hàng Nhà nước Việt Nam", "src11": "Ngân hàng Nhà nước Việt Nam, Chưa xác định"}
# What the titles of some sources begin with, and the field of the sources' documents.
TITLE_OF_SOURCE = {"src1": "Hợp đồng lao động: ", "src2": "Nghỉ PHÉP và thử việc: ", "src4": "Hợp đồng số: ", "src6": "HỢP ĐỒNG thuê: ", "src8": "Tiền lương: ",
                   "src9": "Làm thêm giờ: ", "src10": "Thời giờ làm việc: "}
FIELD_OF_SOURCE = {"src4": "Lao động - Tiền lương", "src6": "Đất đai"}
RELATION_OF_FLAG = {"R": "Sửa đổi, bổ sung", "A": "Căn cứ", "N": "  "}


def _choose(column: str, values: dict[str, str], default: str | None):
    chain = None
    for key, value in values.items():
        condition = F.col(column) == key
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.lit(default).cast("string"))


def _shared_id(number: str, prefix: str):
    """Odd numbers stand for the id of a document, which so occurs again; even ones for ids of their own."""
    return F.when(F.col(number) % 2 == 1, F.col(number).cast("string")).otherwise(F.concat(F.lit(prefix), F.col(number).cast("string")))


def _rows(spark: SparkSession, folder: str, names: list[str], ordered: bool, read=read_in_order) -> list[DataFrame]:
    if ordered:
        return read(spark, *(f"{folder}/{name}.parquet" for name in names))
    return [table(spark, folder, name).withColumn("row_index", F.lit(None).cast("long")) for name in names]


def metadata(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """One metadata row per document and per benchmark item; every second item repeats the
    id of a document. ``row_index`` is the place in the input if ``ordered``, else NULL."""
    texts, listed = _rows(spark, folder, ["documents", "benchmark"], ordered)
    docs = texts.select(
        "row_index",
        F.col("doc_id").cast("string").alias("id"),
        F.concat(_choose("source", TITLE_OF_SOURCE, ""), F.col("text")).alias("title"), _choose("source", FIELD_OF_SOURCE, None).alias("linh_vuc"),
        F.concat(F.col("n_chars").cast("string"), F.lit("/"), F.upper("lang")).alias("so_ky_hieu"),
        _choose("lang", SCOPE_OF_LANGUAGE, None).alias("pham_vi"),
        _choose("source", ISSUER_OF_SOURCE, "Bộ Tư pháp").alias("co_quan_ban_hanh"),
        F.lit("15/06/2020").alias("ngay_ban_hanh"),
        F.when(F.col("lang") == "fr", " ").when(F.col("lang") == "de", "31/12/2021").alias("ngay_het_hieu_luc"),
        F.when(F.col("lang") == "en", "Còn hiệu lực").otherwise("Hết hiệu lực").alias("tinh_trang_hieu_luc"))
    items = listed.select(
        "row_index", _shared_id("item_id", "b").alias("id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("linh_vuc"),
        F.lit(None).cast("string").alias("so_ky_hieu"), F.lit(None).cast("string").alias("pham_vi"),
        F.lit(None).cast("string").alias("co_quan_ban_hanh"), F.lit(None).cast("string").alias("ngay_ban_hanh"),
        F.lit(None).cast("string").alias("ngay_het_hieu_luc"), F.lit(None).cast("string").alias("tinh_trang_hieu_luc"))
    return docs.unionByName(items)


def content(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """Content rows: every document text, then every page; every second page is a later row
    of a document. ``row_index`` only orders the rows: texts are not joined with a count."""
    texts, pages = _rows(spark, folder, ["documents", "pages"], ordered, read_with_place)
    return texts.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content_html"), "row_index").unionByName(
        pages.select(_shared_id("page_id", "p").alias("id"), F.col("html").alias("content_html"), "row_index"))


def relationships(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between order keys and part keys, read as document ids."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_partkey").cast("string").alias("other_doc_id"),
        _choose("l_returnflag", RELATION_OF_FLAG, None).alias("relationship"))


# Markup for one line of a document, by its number from 0 modulo 12; {k} is the number, {t} the escaped line.
STATUTE_LINES = (
    "<h2>CHƯƠNG {k}</h2><p>{t}</p>", "<p>Điều {k}. {t}</p>", "<p>1. {t}</p>", "<p>a) {t}</p>", "<li>{t} <b>theo</b> điều {k}/2a và Điều {k}</li>", "<p>2. {t}</p>",
    "<td>Đ) {t}</td>", "<p>Mục {k}</p><div>- Điều {k}b {t}</div>", "<!-- {t} --><div>&nbsp;Điều {k} {t}</div>", "{t}<br>", "<p>b) {t}</p><style>p</style>",
    "<div>{t}<p>3. {t}</p></div>")


def statutes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as markup with chapters, sections, articles, clauses and points: a line is a
    block or two. One in twelve stays open, a twelfth line makes mixed content."""
    def block(line, number):
        markup = F.element_at(F.array(*[F.lit(m) for m in STATUTE_LINES]), (number % 12 + 1).cast("int"))
        return F.replace(F.replace(markup, F.lit("{k}"), (number + 1).cast("string")), F.lit("{t}"), line)

    text = F.coalesce("text", F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    markup = F.array_join(F.transform(F.split(text, "\n"), block), "\n")
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.when(F.col("doc_id") % 12 == 5, "<div>").otherwise(""), markup).alias("content_html"))


def queries_from_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _sql_case(column: str, values: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


VIEWS_SQL = {
    "metadata": f"""metadata AS (
  SELECT row_number() OVER () - 1 row_index, CAST(doc_id AS VARCHAR) id,
         {_sql_case('source', TITLE_OF_SOURCE, "''")} || text title, {_sql_case('source', FIELD_OF_SOURCE, 'NULL')} linh_vuc, n_chars || '/' || upper(lang) so_ky_hieu,
         {_sql_case('lang', SCOPE_OF_LANGUAGE, 'NULL')} pham_vi,
         {_sql_case('source', ISSUER_OF_SOURCE, "'Bộ Tư pháp'")} co_quan_ban_hanh, '15/06/2020' ngay_ban_hanh,
         CASE lang WHEN 'fr' THEN ' ' WHEN 'de' THEN '31/12/2021' END ngay_het_hieu_luc,
         CASE lang WHEN 'en' THEN 'Còn hiệu lực' ELSE 'Hết hiệu lực' END tinh_trang_hieu_luc
  FROM documents
  UNION ALL SELECT (SELECT count(*) FROM documents) + row_number() OVER () - 1, CASE WHEN item_id % 2 = 1 THEN '' ELSE 'b' END || item_id, text,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM benchmark)""",
    "content": """content AS (
  SELECT CAST(doc_id AS VARCHAR) id, text content_html, row_number() OVER () - 1 row_index FROM documents
  UNION ALL SELECT CASE WHEN page_id % 2 = 1 THEN '' ELSE 'p' END || page_id, html,
         (SELECT count(*) FROM documents) + row_number() OVER () - 1 FROM pages)""",
    "statutes": f"""statutes AS (SELECT CAST(doc_id AS VARCHAR) id, CASE WHEN doc_id % 12 = 5 THEN '<div>' ELSE '' END || array_to_string(list_transform(
  string_split(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda line, i: replace(replace(
    [{', '.join(f"'{m}'" for m in STATUTE_LINES)}][(i - 1) % 12 + 1], '{{k}}', CAST(i AS VARCHAR)), '{{t}}', line)), chr(10)) html FROM documents)""",
    "relationships": f"""relationships AS (
  SELECT CAST(l_orderkey AS VARCHAR) doc_id, CAST(l_partkey AS VARCHAR) other_doc_id,
         {_sql_case('l_returnflag', RELATION_OF_FLAG, 'NULL')} relationship FROM lineitem)""",
}

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


def sql_norm(expr: str) -> str:
    return sql_collapse(f"replace(lower(nfc_normalize(coalesce({expr}, ''))), 'ß', 'ss')")


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all(replace(lower({expr}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_\\x{{C0}}-\\x{{1EF9}}]+')"


def sql_with(*views: str) -> str:
    return "WITH " + ",\n".join(VIEWS_SQL[v] for v in views)
