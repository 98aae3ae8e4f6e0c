"""Line dedup by content-defined chunks of lines (operator 9), DataFrame functions only.

A rolling hash over the hashes of ``WINDOW`` lines ends a chunk behind a line where it is
divisible by ``DIVISOR``, unless a chunk ended right before that line: of a run of such
lines every second one ends a chunk, so the boundaries within a repeated passage do not
depend on what stands before the first line of it that ends none. A boundary that would
leave the last line alone is dropped as well: every chunk has two lines or more, but for
texts of one line. Chunks are grouped by digest over all documents, the bytes of a group's
chunks are compared, and all but the earliest occurrence (by id, then position) are
removed. A text of one line is never removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions.columns import let

WINDOW, DIVISOR, FACTOR = 2, 2, 31
MIN_LINES = 2


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """Array of (start, size, body) in order: first line, number of lines, their text."""

    def ends(hashes: Column) -> Column:
        def rolled(at: Column) -> Column:
            total = F.get(hashes, at)
            for back in range(1, WINDOW):
                total = total + F.coalesce(F.get(hashes, F.when(at >= back, at - back)), F.lit(0)) * FACTOR ** back
            return total % DIVISOR

        last = F.size(hashes) - 1
        flags = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda at: F.when(rolled(at) == 0, "1").otherwise("0")), "")
        # A mark in front of the text, then of each pair of neighbours the second goes.
        spread = F.substr(F.replace(F.concat(F.lit("1"), flags), F.lit("11"), F.lit("10")), F.lit(2))
        closed = F.when(last == 0, "1").otherwise(F.concat(F.left(spread, last - 1), F.lit("01")))
        return let(F.split(closed, ""), lambda marks: F.filter(F.sequence(F.lit(0), last), lambda at: F.get(marks, at) == "1"))

    def cut(lines: Column) -> Column:
        return let(ends_of(lines), lambda found: F.transform(found, lambda end, k: let(
            F.when(k == 0, 0).otherwise(F.get(found, k - 1) + 1), lambda start: F.struct(
                start.alias("start"), (end - start + 1).alias("size"),
                F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("body")))))

    def ends_of(lines: Column) -> Column:
        return let(F.transform(lines, _line_hash), ends)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with the text that is left, and ``n_lines``,
    ``n_removed_lines``.

    A null text stays null and has no lines; an empty text is one empty line. A null id
    comes before all others. Of rows that repeat an id, those with the same text are one
    occurrence and keep the same lines; those with other texts are ordered by a hash of
    their text. Columns of the input named like an internal or added one are replaced only
    if they are ``n_lines`` or ``n_removed_lines``. An empty table gives no rows.
    """
    text = F.col(text_col)
    marked = docs.withColumns({"__id": F.col(id_col), "__tie": F.xxhash64(text)})
    occurrences = (marked.where(text.isNotNull()).select("__id", "__tie", F.posexplode(chunks(text)).alias("at", "chunk"))
                   .where(F.col("chunk.size") >= MIN_LINES)
                   .select("__id", "__tie", "at", F.md5("chunk.body").alias("digest"), F.col("chunk.body").alias("body")))
    place = F.struct("__id", "__tie", "at")
    groups = (occurrences.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"),
                                                F.min("body").alias("low"), F.max("body").alias("high"))
              .where((F.col("n") > 1) & (F.col("low") == F.col("high"))).select("digest", "first"))
    gone = (occurrences.select("__id", "__tie", "at", "digest").join(groups, "digest").where(~place.eqNullSafe(F.col("first")))
            .groupBy(F.col("__id").alias("__gone_id"), F.col("__tie").alias("__gone_tie")).agg(F.collect_set("at").alias("__gone")))
    joined = marked.join(gone, F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__tie") == F.col("__gone_tie")), "left")

    def rest(parts: Column) -> Column:
        # Positions that are left, in order; linear however many there are.
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce("__gone", F.array().cast("array<int>")))
        return let(left, lambda kept: F.struct(
            F.array_join(F.transform(kept, lambda k: F.get(parts, k)["body"]), "\n").alias("text"),
            F.aggregate(parts, F.lit(0), lambda n, p: n + p["size"]).cast("long").alias("lines"),
            F.aggregate(kept, F.lit(0), lambda n, k: n + F.get(parts, k)["size"]).cast("long").alias("left")))

    done = joined.withColumn("__rest", F.when(text.isNotNull(), let(chunks(text), rest)))
    columns = {text_col: F.col("__rest.text"), "n_lines": F.coalesce("__rest.lines", F.lit(0).cast("long")),
               "n_removed_lines": F.coalesce(F.col("__rest.lines") - F.col("__rest.left"), F.lit(0).cast("long"))}
    return done.withColumns(columns).drop("__id", "__tie", "__gone_id", "__gone_tie", "__gone", "__rest")


SQL = f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 i FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) h FROM lines),
rolled AS (SELECT *, (h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {FACTOR}) % {DIVISOR} = 0 ends FROM hashed),
spread AS (SELECT doc_id, count(*) n, substr(replace('1' || string_agg(CASE WHEN ends THEN '1' ELSE '0' END, '' ORDER BY i), '11', '10'), 2) m FROM rolled GROUP BY doc_id),
closed AS (SELECT doc_id, string_split(CASE WHEN n = 1 THEN '1' ELSE left(m, n - 2) || '01' END, '') marks FROM spread),
numbered AS (SELECT *, coalesce(sum(CASE WHEN marks[i + 1] = '1' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) c
             FROM rolled JOIN closed USING (doc_id)),
chunk AS (SELECT doc_id, c, count(*) n, string_agg(line, chr(10) ORDER BY i) body FROM numbered GROUP BY ALL),
kept AS (SELECT *, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY body, n >= {MIN_LINES} ORDER BY doc_id, c) > 1 gone FROM chunk)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT gone), '') AS "text", CAST(sum(n) AS BIGINT) n_lines,
       CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) n_removed_lines FROM kept GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL"""
