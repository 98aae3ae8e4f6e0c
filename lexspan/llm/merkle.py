"""Merkle manifest of a dataset by time-forward processing (operator 12).

Every source is a tree over its rows in the order of their ids, and the sources' roots are
the leaves of one more tree. A node's label is (level, tree, number); its parent's label is
later: (level + 1, tree, number div ``FAN``). Time-forward processing walks the labels in
order. A node's digest is a message put into a priority queue under the label of its
parent; a node is worked on when all messages for it are the least ones of the queue. Here
the queue is external and distributed: messages for one level of all trees are dealt out by
label and sorted there by Spark's shuffle, so a step takes a whole level out of the queue,
and a parent's messages meet in one group of ``FAN``. Each step leaves a sixteenth of the
messages; trees that are done leave the queue.

The reversed sweep walks the labels backwards. A node gets from its parent the suffix of
its proof (the siblings on the way to the root, level by level) and sends each child the
child's siblings followed by that suffix. The last step sends a suffix to a run of leaves,
not to each leaf.

Row numbers within a tree come from ranges of (tree, id) with counts of the ranges before,
so a source of any size is spread over all tasks. Messages carry digests, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspan.llm.common import cut_lineage

FAN = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """Every row's tree, digest and, where the audit tampers with it, the digest of the tampered row."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    head = F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")))
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return docs.select(
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), _digest(F.concat(head, _field(text))).alias("digest"),
        F.when(tampered, _digest(F.concat(head, _field(F.translate(text, _UPPER, _LOWER))))).alias("tampered"))


def number_rows(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``number`` (from 0, in order, within ``tree``) and ``n`` (rows of the tree)."""
    # Written, so that a row's place in its range is settled.
    ranges = cut_lineage(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                         .withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", 33)))
    sums = ranges.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("tree", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("rows").over(tree).alias("n"))
    return ranges.join(bases, ["tree", "range"]).withColumn("number", F.col("place") + F.col("base")).drop("place", "range", "base")


def sweep_up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Parents by level, each with its children in order, and the trees' roots with their level."""
    level, tables = 0, []
    width = nodes.agg(F.max("n")).first()[0] or 0
    roots = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("level"))
    payload = [c for c in nodes.columns if c not in ("tree", "n", "number")]
    while width > 1:
        level, width = level + 1, -(-width // FAN)
        child = F.struct("number", *payload)
        parents = nodes.where("n > 1").groupBy("tree", F.expr(f"number div {FAN}").alias("parent"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("above")).agg(
            F.sort_array(F.collect_list(child)).alias("children"))
        parents = cut_lineage(parents.select("tree", F.col("parent").alias("number"), F.col("above").alias("n"), "children",
                                             _digest(F.array_join("children.digest", "")).alias("digest")))
        tables.append(parents)
        roots = roots.unionAll(parents.where("n = 1").select("tree", "digest", F.lit(level)))
        nodes, payload = parents.select("tree", "number", "n", "digest"), ["digest"]
    return tables, roots


def sweep_down(tables: list[DataFrame], nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every leaf's proof: the siblings left and right of the path, upwards.

    ``roots`` has of each tree its level, the ``suffix`` that goes on above it, and ``note``,
    which every leaf of the tree receives too.
    """
    suffix_type = roots.schema["suffix"].dataType
    payload = [f.name for f in (tables[0].schema["children"].dataType.elementType if tables else nodes.schema) if f.name not in ("tree", "n")]
    found = nodes.where("n = 1").select("tree", *payload).join(roots.where("level = 0").drop("level"), "tree").select("tree", *payload, "suffix", "note")
    messages = None
    for level in range(len(tables), 0, -1):
        start = roots.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("number"), "suffix", "note")
        messages = start if messages is None else messages.unionAll(start)
        met = tables[level - 1].select("tree", "number", "children").join(messages, ["tree", "number"])
        each = met.select("tree", "suffix", "note", F.col("children.digest").alias("run"), F.posexplode("children").alias("at", "child"))
        siblings = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("at")), "").alias("left"),
                            F.array_join(F.slice("run", F.col("at") + 2, F.lit(FAN)), "").alias("right"))
        suffix = F.concat(F.array(siblings), F.col("suffix")).cast(suffix_type).alias("suffix")
        if level > 1:
            messages = each.select("tree", F.col("child.number").alias("number"), suffix, "note")
        else:
            found = found.unionAll(each.select("tree", *(F.col(f"child.{c}").alias(c) for c in payload), suffix, "note"))
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """Every row with its leaf, its source's root, the dataset's root, and its proof, folded and checked.

    Nulls are values of their own: a null source is the first tree, a null field is ``-``, a
    row with a null id comes first in its tree and is not tampered with. Rows with equal ids
    stand in the order of their digests. Columns other than doc_id, source, lang, n_chars and
    text are not read. An empty table gives no rows.
    """
    numbered = cut_lineage(number_rows(cut_lineage(leaves(docs)), "doc_id", "digest"))
    tables, subroots = sweep_up(numbered)
    sources = cut_lineage(number_rows(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", "level"), "source"))
    upper, top = sweep_up(sources)
    root = (top.first() or {"digest": None})["digest"]
    none = F.array().cast("array<struct<left:string,right:string>>")
    ways = sweep_down(upper, sources, top.select("tree", "level", none.alias("suffix"), F.lit(None).cast("string").alias("note")))
    ways = cut_lineage(ways.select(F.col("source").alias("tree"), "level", "suffix", F.col("digest").alias("note")))
    proofs = sweep_down(tables, numbered, ways)
    folded = F.aggregate("suffix", F.coalesce("tampered", "digest"), lambda below, at: _digest(F.concat(at["left"], below, at["right"])))
    proof = _digest(F.array_join(F.transform("suffix", lambda at: F.concat(at["left"], at["right"])), ""))
    out = proofs.select("doc_id", F.col("digest").alias("leaf"), F.col("note").alias("subroot"), F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"),
                        folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of the trees over ``{name}0`` (tree, i, d, n), upwards; and of each level's siblings."""
    parts = []
    for level in range(levels):
        run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
        parts.append(f"""{name}{level}s AS (SELECT tree, i, n,
    coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{level})""")
        parts.append(f"""{name}{level + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d,
    (any_value(n) + 15) // 16 AS n FROM {name}{level} GROUP BY tree, i // 16)""")
    return ",\n".join(parts)


def _sql(levels: int = 6) -> str:
    """Trees of at most 16 to the power of ``levels`` leaves."""
    def field(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"

    steps = [f"{tree}{level}s" for tree in "lu" for level in range(levels)]
    joins = " ".join(f"JOIN l{k}s ON l{k}s.tree = a.tree AND l{k}s.i = a.i // {16 ** k}" for k in range(levels))
    joins += " " + " ".join(f"JOIN u{k}s ON u{k}s.i = b.i // {16 ** k}" for k in range(levels))
    folds, last = [], "g"
    for k, step in enumerate(steps):
        folds.append(f"f{k} AS (SELECT *, CASE WHEN n{k} = 1 THEN {'x' if k == 0 else f'x{k - 1}'} ELSE sha256(l{k} || {'x' if k == 0 else f'x{k - 1}'} || r{k}) END AS x{k} FROM {last})")
        last = f"f{k}"
    columns = ", ".join(f"{step}.n AS n{k}, {step}.l AS l{k}, {step}.r AS r{k}" for k, step in enumerate(steps))
    proof = " || ".join(f"l{k} || r{k}" for k in range(len(steps)))
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH docs AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({head} || {field('text')}) AS d,
        CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS t FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM docs),
l0 AS (SELECT tree, i, d, n FROM a),
{_tree_sql('l', levels)},
b AS (SELECT tree AS source, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n FROM l{levels}),
u0 AS (SELECT tree, i, d, n FROM b),
{_tree_sql('u', levels)},
g AS (SELECT a.doc_id, a.d AS leaf, coalesce(a.t, a.d) AS x, b.d AS subroot, top.d AS root, {columns}
    FROM a JOIN b ON b.source = a.tree CROSS JOIN u{levels} AS top {joins}),
{', '.join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, x{len(steps) - 1} AS folded_root, x{len(steps) - 1} = root AS verified FROM {last}"""


SQL = _sql()
