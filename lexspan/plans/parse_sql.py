"""SQL of the parse queries: markup to blocks, anomalies, articles and chunks on DuckDB.

Everything starts from a CTE ``src(id, html)``. The stack of open tags and the regions of
an article are recursive, a tag or a block at a time.
"""

from __future__ import annotations

from lexspan.functions.text import BLOCK_TAGS, SEPARATOR_TAGS
from lexspan.plans.audit import _NO_MARKUP, sql_entities
from lexspan.plans.tables import WS, sql_collapse

_HIDDEN = ("<!--.*?-->|<head\\b[^>]*>.*?</head\\s*>|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|"
           "<title\\b[^>]*>.*?</title\\s*>")


def sql_shown(markup: str) -> str:
    """Visible text: separators break words, other tags vanish."""
    hidden = _NO_MARKUP.format(markup).replace("' ', 'g'", "'', 'g'")
    separators = f"'(?i)</?\\s*(?:{'|'.join(SEPARATOR_TAGS)})(?:[^\\w:>-][^>]*)?>'"
    return sql_collapse(sql_entities(f"regexp_replace(regexp_replace({hidden}, {separators}, ' ', 'g'), '<[^>]*>', '', 'g')"))


def sql_uuid5(name: str) -> str:
    digest = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return (f"(SELECT substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab89ab89ab89ab', "
            f"CAST('0x' || substr(s, 17, 1) AS INT) + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) FROM (SELECT {digest} s))")


_BLOCK_LIST = ", ".join(f"'{t}'" for t in BLOCK_TAGS)

LAYOUT = f"""units AS (SELECT id, n, u, coalesce(sum(length(u)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT id, unnest(us) u, unnest(range(len(us))) n FROM (SELECT id, regexp_extract_all(html, '(?is){_HIDDEN}|<[^>]*>|[^<]+|<') us FROM src))),
sorts AS (SELECT *, a + length(u) z, regexp_matches(u, '(?is)^(?:{_HIDDEN})$') hidden, lower(regexp_extract(u, '^</?([a-zA-Z][^\\s/>]*)', 1)) name FROM units),
parts AS (SELECT *, CASE WHEN hidden THEN ' ' WHEN u LIKE '<%>' THEN '' ELSE u END shown FROM sorts),
tags AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) k, count(*) OVER (PARTITION BY id) m FROM parts
  WHERE NOT hidden AND name IN ({_BLOCK_LIST}) AND u NOT LIKE '%/>'),
stack AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT) k, CAST([] AS VARCHAR[]) names, CAST([] AS HUGEINT[]) starts, CAST([] AS HUGEINT[]) opens,
    CAST(NULL AS HUGEINT) a, CAST(NULL AS HUGEINT) o, CAST(NULL AS HUGEINT) c, CAST(NULL AS HUGEINT) z, CAST(NULL AS HUGEINT) parent FROM src
  UNION ALL SELECT s.id, t.k,
    CASE WHEN u NOT LIKE '</%' THEN list_append(names, name) WHEN closes THEN names[1:len(names) - 1] ELSE names END,
    CASE WHEN u NOT LIKE '</%' THEN list_append(starts, t.a) WHEN closes THEN starts[1:len(starts) - 1] ELSE starts END,
    CASE WHEN u NOT LIKE '</%' THEN list_append(opens, t.z) WHEN closes THEN opens[1:len(opens) - 1] ELSE opens END,
    CASE WHEN closes THEN starts[len(starts)] END, CASE WHEN closes THEN opens[len(opens)] END, CASE WHEN closes THEN t.a END,
    CASE WHEN closes THEN t.z END, CASE WHEN closes THEN starts[len(starts) - 1] END
  FROM (SELECT stack.*, coalesce(tags.u LIKE '</%' AND names[len(names)] = tags.name, false) closes FROM stack JOIN tags ON tags.id = stack.id AND tags.k = stack.k + 1) s
  JOIN tags t ON t.id = s.id AND t.k = s.k + 1),
closed AS (SELECT id, a, o, c, z, parent FROM stack WHERE a IS NOT NULL),
families AS (SELECT c.*, EXISTS (SELECT 1 FROM closed k WHERE k.id = c.id AND k.parent = c.a) mixed FROM closed c),
direct AS (SELECT f.id, f.a, f.z, f.mixed, {sql_collapse(sql_entities("coalesce(string_agg(p.shown, '' ORDER BY p.n), '')"))} words
  FROM families f LEFT JOIN parts p ON p.id = f.id AND p.a >= f.o AND p.a < f.c AND NOT (f.mixed AND EXISTS (
    SELECT 1 FROM closed k WHERE k.id = f.id AND k.parent = f.a AND p.a >= k.a AND p.a < k.z)) GROUP BY f.id, f.a, f.z, f.mixed),
blocks AS (SELECT id, CAST(a AS INT) AS "start", CAST(z AS INT) AS "end", words AS text FROM direct WHERE NOT mixed AND words <> ''),
anomalies AS (SELECT id, 'mixed_block_content' reason, CAST(a AS INT) source_start, CAST(z AS INT) source_end FROM direct WHERE mixed AND words <> ''
  UNION ALL SELECT id, 'unclosed_block', CAST(starts[len(starts)] AS INT), CAST(length(html) AS INT) FROM stack JOIN src USING (id)
    LEFT JOIN (SELECT DISTINCT id, m FROM tags) l USING (id) WHERE k = coalesce(m, 0) AND len(starts) > 0)"""


def articles(heading: str, chapter: str, section: str, point: str) -> str:
    return f"""marks AS (SELECT *, nullif(regexp_extract(text, '{chapter}', 1), '') chapter, nullif(regexp_extract(text, '{section}', 1), '') section,
  nullif(regexp_extract(text, '{heading}', 1), '') label, nullif(regexp_extract(text, '^\\s*(\\d+)\\.\\s+', 1), '') clause,
  lower(nullif(regexp_extract(text, '{point}', 1), '')) point FROM blocks),
runs AS (SELECT *, count(chapter) OVER w chapter_run, last_value(chapter IGNORE NULLS) OVER w in_chapter, count(label) OVER w article FROM marks
  WINDOW w AS (PARTITION BY id ORDER BY "start")),
carried AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY id, chapter_run ORDER BY "start") in_section,
  last_value(clause IGNORE NULLS) OVER (PARTITION BY id, article ORDER BY "start") in_clause FROM runs),
heads AS (SELECT id, article, label, in_chapter chapter, in_section section, "start" source_start,
  coalesce(lead("start") OVER (PARTITION BY id ORDER BY "start"), CAST(length(html) AS INT)) source_end, html FROM carried JOIN src USING (id) WHERE label IS NOT NULL),
paths AS (SELECT c.id, c.article, c."start", least(c."end", h.source_end) AS "end", clause IS NOT NULL OR point IS NOT NULL node,
  list_filter([h.label, 'khoản ' || in_clause, CASE WHEN clause IS NULL THEN 'điểm ' || point || ')' END], lambda x: x IS NOT NULL) path
  FROM carried c JOIN heads h ON h.id = c.id AND h.article = c.article),
nodes AS (SELECT id, article, label AS path, source_start AS "start", source_end AS "end" FROM heads
  UNION ALL SELECT id, article, array_to_string(path, ' > '), "start", "end" FROM paths WHERE node),
named AS (SELECT *, substr(html, source_start + 1, source_end - source_start) source_html,
  {sql_uuid5("'lexspan:' || " + sql_uuid5("'lexspan:' || id || ':' || sha256(html)") + " || ':' || label || ':' || source_start")} article_id FROM heads),
shown AS (SELECT *, {sql_shown('source_html')} canonical_text FROM named)"""


# Visible characters with their places in the markup; of a run of white space the first character, else the last separator.
CHARACTERS = f"""cut AS (SELECT id, n, u, coalesce(sum(length(u)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT id, unnest(us) u, unnest(range(len(us))) n FROM (SELECT id, regexp_extract_all(html, '(?is){_HIDDEN}|<[^>]*>|&[^;]*;|[^<&]+|<|&') us FROM src))),
units_shown AS (SELECT *, CASE WHEN regexp_matches(u, '(?is)^(?:{_HIDDEN})$') THEN ''
  WHEN u LIKE '<%>' THEN CASE WHEN regexp_matches(u, '(?i)^</?\\s*(?:{'|'.join(SEPARATOR_TAGS)})(?:[^\\w:>-][^>]*)?>$') THEN ' ' ELSE '' END
  WHEN u LIKE '&%;' THEN {sql_entities('u')} ELSE u END s, u LIKE '<%>' OR u LIKE '&%;' AS solid FROM cut),
letters AS (SELECT id, n, i, s[i] ch, CASE WHEN solid THEN a ELSE a + i - 1 END b, CASE WHEN solid THEN a + length(u) ELSE a + i END e
  FROM (SELECT *, unnest(range(1, length(s) + 1)) i FROM units_shown)),
spaced AS (SELECT *, regexp_matches(ch, '^{WS}$') gap FROM letters),
kept AS (SELECT *, coalesce(lag(gap) OVER (PARTITION BY id ORDER BY n, i), true) after_gap, sum(CAST(NOT gap AS INT)) OVER (PARTITION BY id ORDER BY n DESC, i DESC) ahead FROM spaced),
placed AS (SELECT id, CASE WHEN gap THEN ' ' ELSE ch END ch, gap, CAST(b AS INT) b, CAST(e AS INT) e, row_number() OVER (PARTITION BY id ORDER BY n, i) ix
  FROM kept WHERE NOT gap OR NOT after_gap AND ahead > 0),
page AS (SELECT id, string_agg(ch, '' ORDER BY ix) text, list(b ORDER BY ix) bs, list(e ORDER BY ix) es FROM placed GROUP BY id)"""


def chunks(limit: int) -> str:
    """Regions of the blocks of long articles, then their parts."""
    common = ("(SELECT lo[1:coalesce(list_min(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(len(lo), len(hi)))] "
              "FROM (SELECT list_min(covered) lo, list_max(covered) hi))")

    def first(raw: str) -> str:
        return f"(SELECT min(ix) FROM placed p WHERE p.id = x.id AND NOT gap AND b >= {raw})"

    return f"""large AS (SELECT * FROM shown WHERE length(canonical_text) > {limit}),
own AS (SELECT x.*, row_number() OVER (PARTITION BY x.id, x.article ORDER BY x."start") k, count(*) OVER (PARTITION BY x.id, x.article) m, {first('x."start"')} fs,
  {first('x."end"')} fe, (SELECT max(ix) FROM placed p WHERE p.id = x.id AND NOT gap AND e <= x."end") le FROM paths x JOIN large USING (id, article)),
regions AS (
  SELECT x.id, x.article, CAST(0 AS BIGINT) k, x.source_start pos, {first('x.source_start')} f, [[x.label]] covered,
    CAST([] AS STRUCT(a INT, z INT, f BIGINT, covered VARCHAR[][])[]) done FROM large x
  UNION ALL SELECT id, article, k, CASE WHEN big THEN "end" ELSE begin END, CASE WHEN big THEN fe ELSE bf END,
    CASE WHEN big OR begin = "start" THEN [path] WHEN list_contains(covered, path) THEN covered ELSE list_append(covered, path) END,
    CASE WHEN big THEN list_append(flushed, {{'a': "start", 'z': "end", 'f': fs, 'covered': [path]}}) ELSE flushed END
  FROM (SELECT *, le - fs + 1 > {limit} big FROM (
    SELECT r.id, r.article, o.k, o."start", o."end", o.path, o.fs, o.fe, o.le, r.covered, flush, CASE WHEN flush THEN o."start" ELSE r.pos END begin,
      CASE WHEN flush THEN o.fs ELSE r.f END bf, CASE WHEN flush THEN list_append(r.done, {{'a': r.pos, 'z': o."start", 'f': r.f, 'covered': r.covered}}) ELSE r.done END flushed
    FROM (SELECT regions.*, regions.pos < own."start" AND own.le - regions.f + 1 > {limit} flush FROM regions JOIN own ON own.id = regions.id AND own.article = regions.article AND own.k = regions.k + 1) r
    JOIN own o ON o.id = r.id AND o.article = r.article AND o.k = r.k + 1))),
whole AS (SELECT l.id, l.article, unnest(CASE WHEN r.pos < l.source_end THEN list_append(r.done, {{'a': r.pos, 'z': l.source_end, 'f': r.f, 'covered': r.covered}}) ELSE r.done END) r
  FROM regions r JOIN large l USING (id, article) LEFT JOIN (SELECT DISTINCT id, article, m FROM own) c USING (id, article) WHERE r.k = coalesce(c.m, 0)),
areas AS (SELECT id, article, r.a a, r.z z, r.f f, r.covered covered, (SELECT max(ix) FROM placed p WHERE p.id = whole.id AND NOT gap AND e <= r.z) l FROM whole),
slices AS (
  SELECT id, article, covered, a, z, f, l, CAST(NULL AS INT) x, CAST(NULL AS INT) y FROM areas
  UNION ALL SELECT id, article, covered, CASE WHEN more THEN es[c] ELSE z END, z, CASE WHEN text[c + 1] = ' ' THEN c + 2 ELSE c + 1 END, l, a, CASE WHEN more THEN es[c] ELSE z END
  FROM (SELECT s.*, page.text, page.es, coalesce(l - f + 1 > {limit}, false) more, CASE WHEN contains(part, ' ') THEN f + length(part) - strpos(reverse(part), ' ') - 1 ELSE f + {limit} - 1 END c
    FROM (SELECT slices.*, substr(p.text, CAST(f AS BIGINT), {limit} + 1) part FROM slices JOIN page p USING (id) WHERE a < z) s JOIN page USING (id))),
pieces AS (SELECT id, article, x source_start, y source_end, CASE WHEN len({common}) = 0 THEN [label] ELSE {common} END path, covered, html, article_id,
  row_number() OVER (PARTITION BY id, article ORDER BY x) - 1 child_index FROM slices JOIN named USING (id, article) WHERE x IS NOT NULL)"""


# The fixed patterns of legal texts without look-ahead, which RE2 lacks.
REFERENCE = "(?i)Điều\\s+\\d+[A-Za-zÀ-ỹ0-9/-]*"
LEGAL_ARTICLES = articles("^\\s*(?:[-–—]\\s*)?((?i:Điều)\\s+\\d+[A-Za-zÀ-ỹ0-9/-]*)(?:\\s*(?:[.:–—-]|$)|\\s+[A-ZĐ])", "(?i)\\b(Chương\\s+[IVXLCDM0-9]+)\\b",
                          "(?i)\\b(Mục\\s+[IVXLCDM0-9]+)\\b", "(?i)^\\s*([a-zđ])\\)\\s+")

LEDGER = """found AS (SELECT id, reason FROM anomalies UNION ALL SELECT id, 'zero_article' FROM src WHERE id NOT IN (SELECT id FROM heads)
UNION ALL SELECT id, 'invalid_source_span' FROM heads WHERE source_start >= source_end),
listed AS (SELECT id, list_sort(list_distinct(list(reason))) reasons FROM found GROUP BY id),
ledger AS (SELECT id document_id, (SELECT count(*) FROM heads h WHERE h.id = src.id) article_count,
CASE WHEN len(list_filter(coalesce(reasons, []), lambda r: r <> 'zero_article')) > 0 THEN 'quarantined_layout' WHEN reasons IS NOT NULL THEN 'zero_article'
ELSE 'segmented' END status, coalesce(reasons, []) reasons FROM src LEFT JOIN listed USING (id))"""
