"""Markup, structure and window queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.functions import spans
from lexspan.operators import chunks, parse
from lexspan.plans import parse_sql
from lexspan.plans.registry import query
from lexspan.plans.tables import spread, sql_collapse, table

# Patterns that occur in the given pages, in place of the legal headings.
PATTERNS = parse.Patterns(heading=r"(?u)^(\p{Lu}\p{L}*) ", chapter=r"(?u)(?<!\p{L})(?:The|Und|Les|Las)(?!\p{L})", section=r"(?u)(?<!\p{L})(?:Of|Die|Des|De)(?!\p{L})",
                          clause=r"^\s*(\d+)\.\s+", point=r"(?iu)^\s*([a-z])\)\s+")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("content_html")), "id")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    word = F.regexp_extract("line", r"^([A-Z][a-z]+)", 1)
    return docs.withColumns({"chapter": F.when(F.startswith(word, F.lit("Th")), word), "section": F.when(F.startswith(word, F.lit("An")), word),
                             "heading": F.when(word != "", word)})


_LINES_SQL = """l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) line_no, unnest(string_split(text, chr(10))) line FROM documents),
w AS (SELECT *, regexp_extract(line, '^([A-Z][a-z]+)', 1) word FROM l),
m AS (SELECT doc_id, line_no, line, CASE WHEN word LIKE 'Th%' THEN word END chapter, CASE WHEN word LIKE 'An%' THEN word END section,
      CASE WHEN word <> '' THEN word END heading FROM w)"""


@query(f"""WITH {_LINES_SQL}, r AS (SELECT *, count(chapter) OVER (PARTITION BY doc_id ORDER BY line_no) chapter_run,
last_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) current_chapter FROM m)
SELECT doc_id, line_no, current_chapter, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id, chapter_run ORDER BY line_no) current_section FROM r""")
def forward_fill_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lines(spark, folder).select("doc_id", "line_no", "chapter", "section")
    return parse.fill_forward(rows, "doc_id", "line_no", "chapter", "section").select("doc_id", "line_no", "current_chapter", "current_section")


@query(f"""WITH {_LINES_SQL}, n AS (SELECT doc_id, count(*) total FROM m GROUP BY doc_id)
SELECT doc_id, heading, line_no, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), total) line_end
FROM m JOIN n USING (doc_id) WHERE heading IS NOT NULL""")
def article_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    rows = docs.select("doc_id", F.size("lines").alias("total"), F.posexplode("lines").alias("line_no", "line")).withColumn(
        "heading", F.regexp_extract("line", r"^([A-Z][a-z]+)", 1)).where("heading <> ''")
    return parse.next_start(rows, "doc_id", "line_no", F.col("total")).select("doc_id", "heading", "line_no", F.col("source_end").alias("line_end"))


@query(f"""WITH w AS (SELECT doc_id, {sql_collapse('text')} clean FROM documents),
t AS (SELECT doc_id, clean, CASE WHEN clean = '' THEN [] ELSE string_split(clean, ' ') END words FROM w),
p AS (SELECT doc_id, words, unnest(range(0, len(words), 392)) pos FROM t)
SELECT doc_id, pos AS word_start, least(pos + 440, len(words)) word_end,
CASE WHEN pos = 0 THEN 0 ELSE length(array_to_string(words[1:pos], ' ')) + 1 END char_start,
array_to_string(words[pos + 1:pos + 440], ' ') AS text FROM p WHERE pos = 0 OR pos + 48 < len(words)""")
def token_windows_440_48(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return chunks.word_windows(docs, ["doc_id"], "text").select("doc_id", "word_start", "word_end", "char_start", "text")


# A stand-in for an encoder's tokenizer: runs of word characters, and every other visible character by itself.
_PIECES = re.compile(r"[a-zA-Z0-9]+|[^a-zA-Z0-9 ]")


def _pieces(texts: list[str]) -> list[list[tuple[int, int]]]:
    return [[piece.span() for piece in _PIECES.finditer(text)] for text in texts]


@query(f"""WITH w AS (SELECT doc_id, {sql_collapse("nfc_normalize(text)")} clean FROM documents),
u AS (SELECT doc_id, unnest(ps) p, unnest(range(len(ps))) n FROM (SELECT doc_id, regexp_extract_all(clean, '[a-zA-Z0-9]+|[^a-zA-Z0-9 ]| +') ps FROM w)),
o AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM u),
t AS (SELECT doc_id, b, b + length(p) e, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 k, count(*) OVER (PARTITION BY doc_id) m FROM o WHERE p NOT LIKE ' %'),
s AS (SELECT DISTINCT doc_id, m, unnest(range(0, m, 392)) first FROM t),
b AS (SELECT s.doc_id, CAST(first AS INT) first, CAST(least(first + 440, s.m) AS INT) last, CAST(x.b AS INT) char_start, CAST(y.e AS INT) char_end
  FROM s JOIN t x ON x.doc_id = s.doc_id AND x.k = first JOIN t y ON y.doc_id = s.doc_id AND y.k = least(first + 440, s.m) - 1 WHERE first = 0 OR first + 48 < s.m)
SELECT doc_id, first, last, char_start, char_end, last - first + 2 tokens, substr(clean, char_start + 1, char_end - char_start) AS text FROM b JOIN w USING (doc_id)""")
def encoder_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 440 tokens with 48 in common, and what the encoder gets with its prefix (two tokens)."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    rows = chunks.token_windows(docs, ["doc_id"], "text", _pieces, prefix=chunks.DOCUMENT_PREFIX)
    return rows.select("doc_id", "first", "last", "char_start", "char_end", "tokens", "text")


_SRC = "src AS (SELECT CAST(page_id AS VARCHAR) id, html FROM pages)"
_LAYOUT = f"WITH RECURSIVE {_SRC}, {parse_sql.LAYOUT}"
_ARTICLES = _LAYOUT + ", " + parse_sql.articles(r"^(\p{Lu}\p{L}*) ", r"(?:^|\P{L})(The|Und|Les|Las)(?:\P{L}|$)", r"(?:^|\P{L})(Of|Die|Des|De)(?:\P{L}|$)",
                                               r"(?i)^\s*([a-z])\)\s+")
_CHUNKS = f"{_ARTICLES}, {parse_sql.CHARACTERS}, {parse_sql.chunks(600)}"


@query(f'{_LAYOUT} SELECT id, "start", "end", text FROM blocks')
def html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return parse.html_blocks(_pages(spark, folder))


@query(f"{_LAYOUT} SELECT id, reason, source_start, source_end FROM anomalies")
def layout_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return parse.layout_anomalies(_pages(spark, folder))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse.parse_documents(_pages(spark, folder), patterns=PATTERNS, max_chars=600)


@query(f"""{_CHUNKS} SELECT id document_id, article_id, label, chapter, section, source_start, source_end, canonical_text,
(SELECT count(*) FROM pieces p WHERE p.article_id = s.article_id) children,
(SELECT count(*) FROM nodes n WHERE n.id = s.id AND n.article = s.article) nodes FROM shown s""")
def parse_articles(spark: SparkSession, folder: str) -> DataFrame:
    return parse.articles(_parsed(spark, folder)).select("document_id", "article_id", "label", "chapter", "section", "source_start", "source_end",
                                                         "canonical_text", F.size("chunks").alias("children"), F.size("hierarchy").alias("nodes"))


@query(f"""{_CHUNKS} SELECT {parse_sql.sql_uuid5("'lexspan:' || article_id || ':' || child_index")} child_id, article_id parent_article_id, id document_id, child_index,
CASE WHEN len(path) > 1 THEN path[len(path)] END AS label, source_start, source_end, {parse_sql.sql_shown("substr(html, source_start + 1, source_end - source_start)")} canonical_text
FROM pieces""")
def char_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return parse.children(parse.articles(_parsed(spark, folder))).select(
        "child_id", "parent_article_id", "document_id", "child_index", "label", "source_start", "source_end", "canonical_text")


@query(f"{_ARTICLES}, {parse_sql.LEDGER} SELECT document_id, article_count, status, array_to_string(reasons, '|') reasons FROM ledger")
def parse_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = parse.parse_ledger(_parsed(spark, folder))
    return rows.select("document_id", "article_count", "status", F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH {_SRC}, {parse_sql.CHARACTERS},
q AS (SELECT id, text, bs, es, trim(substr(text, length(text) // 3 + 1, 60)) quote FROM page),
f AS (SELECT *, strpos(text, quote) ix FROM q)
SELECT id, quote, CAST(ix - 1 AS INT) text_start, bs[ix] source_start, es[ix + length(quote) - 1] source_end FROM f""")
def quote_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where sixty characters from the middle of each page's visible text stand in its markup."""
    shown = _pages(spark, folder).withColumn("text", parse.visible_text("content_html"))
    quoted = shown.select("id", "content_html", F.trim(F.substring("text", (F.length("text") / 3).cast("int") + 1, F.lit(60))).alias("quote"))
    return spans.quote_spans(quoted, "content_html", "quote")


@query(f"SELECT CAST(page_id AS VARCHAR) id, {parse_sql.sql_shown('html')} canonical_text FROM pages")
def visible_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("id", parse.visible_text("content_html").alias("canonical_text"))
