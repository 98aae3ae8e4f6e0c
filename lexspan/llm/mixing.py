"""Mixing sources to target weights (operator 4), DataFrame functions only.

A tree of domain, language and source. Every node's weight, relative to its siblings,
passes its parent's token budget on; no node gets more than it can give, which is its
tokens times ``max_epochs``. What a node cannot give is dealt to its siblings by their
weights, and only what they cannot give either leaves their parent for its own siblings.

A leaf gives whole epochs, each a seeded order of its documents, and of the last epoch the
documents up to the one that reaches the budget. Where that is, is found from token sums
over hash ranges, so a leaf with a third of all rows is never ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspan.llm.common import cut_lineage

LEVELS = ("domain", "lang", "source")
RANGES = 4096


def count_tokens(text: Column) -> Column:
    """Words of ASCII white space separation; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(budget: float, children: dict, weights: dict) -> dict:
    """Budget of each child by weight, no more than what it can give; shortages go to siblings."""
    given, open_ = {}, dict(children)
    while open_:
        total = sum(weights[c] for c in open_)
        if total <= 0:
            # Siblings without a weight come last, by what they have.
            weights = {c: float(open_[c]) for c in open_}
            total = sum(weights.values())
            if total <= 0:
                return given | dict.fromkeys(open_, 0.0)
        full = [c for c in open_ if open_[c] * total <= budget * weights[c]]
        if not full:
            return given | {c: budget * weights[c] / total for c in open_}
        for c in full:
            given[c] = float(open_.pop(c))
        budget -= sum(given[c] for c in full)
    return given


def budgets(leaves: dict[tuple, int], weights: list[dict], budget: float, max_epochs: int) -> dict[tuple, int]:
    """Whole-token budget of every leaf (a path) from its tokens and the weights by level;
    a name without a weight has weight 1."""

    def deal(prefix: tuple, amount: float) -> dict[tuple, int]:
        level = len(prefix)
        if level == len(weights):
            return {prefix: int(amount + 1e-6)}
        below: dict = {}
        for path, tokens in leaves.items():
            if path[:level] == prefix:
                below[path[level]] = below.get(path[level], 0) + tokens * max_epochs
        below = dict(sorted(below.items()))
        given = fill(min(amount, sum(below.values())), below, {c: float(weights[level].get(c, 1.0)) for c in below})
        result = {}
        for child, share in sorted(given.items()):
            result |= deal((*prefix, child), share)
        return result

    return deal((), float(budget))


def select(docs: DataFrame, weights: list[dict], budget: int | None = None, share: float = 1.0, max_epochs: int = 1, seed: int = 7,
           levels: tuple[str, ...] = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, __tie, levels, tokens, epoch), a row for each time a document is taken.

    ``budget`` is in tokens, by default ``share`` of all. A null level is the name ''. A
    document without words has no tokens: it is taken with every whole epoch and where it
    falls before the end of a prefix. Ties in the order go by id, then text hash; repeated
    rows are taken each for itself. An empty table gives no rows; other columns are not
    read. One row per leaf of the tree passes the driver.
    """
    spark = docs.sparkSession
    path = [F.coalesce(F.col(level).cast("string"), F.lit("")).alias(level) for level in levels]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("__tie"), *path, count_tokens(F.col(text_col)).alias("tokens"))
    rows = cut_lineage(rows)
    sums = rows.groupBy(*levels).agg(F.sum("tokens").alias("n")).collect()
    leaves = {tuple(r[level] for level in levels): r["n"] for r in sums}
    total = sum(leaves.values())
    found = budgets(leaves, weights, total * share if budget is None else budget, max_epochs)
    plan = [(*leaf, found[leaf] // tokens if tokens else 0, found[leaf] % tokens if tokens else 0) for leaf, tokens in leaves.items()]
    schema = ", ".join(f"`{level}` string" for level in levels) + ", __whole long, __rest long"
    # A row per leaf.
    placed = rows.join(F.broadcast(spark.createDataFrame(plan, schema)), list(levels))
    order = F.xxhash64(F.lit(seed), F.col("__whole"), F.col("doc_id").cast("string"), F.col("__tie"))
    placed = placed.withColumn("__order", order).withColumn("__range", F.floor((F.col("__order") / 2.0 ** 63 + 1) * (RANGES / 2)).cast("int"))
    ranges = placed.where("__rest > 0").groupBy(*levels, "__range").agg(F.sum("tokens").alias("__sum"))
    before = Window.partitionBy(*levels).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    last = placed.where("__rest > 0").join(ranges, [*levels, "__range"])
    names = ["doc_id", "__tie", *levels, "tokens"]
    inside = last.where(F.col("__before") + F.col("__sum") < F.col("__rest"))
    across = last.where((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__sum") >= F.col("__rest")))
    running = Window.partitionBy(*levels, "__range").orderBy("__order", "doc_id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    across = across.withColumn("__own", F.col("__before") + F.coalesce(F.sum("tokens").over(running), F.lit(0))).where("__own < __rest")
    whole = placed.where("__whole > 0").select(*names, F.explode(F.sequence(F.lit(0), (F.col("__whole") - 1).cast("int"))).alias("epoch"))
    parts = [part.select(*names, F.col("__whole").cast("int").alias("epoch")) for part in (inside, across)]
    return whole.unionByName(parts[0]).unionByName(parts[1])


def mix(docs: DataFrame, weights: list[dict], id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = LEVELS, **settings) -> DataFrame:
    """The selected rows of ``docs`` with their columns, once for each time they are taken.

    Null ids, texts and levels are values like others. Rows that repeat id, text and levels
    count each for itself; where an epoch takes fewer than there are, one of them stands for
    those taken. An empty table gives no rows.
    """
    keys = ["__id", "__taken", *(f"__{level}" for level in levels)]
    taken = select(docs, weights, levels=levels, id_col=id_col, text_col=text_col, **settings)
    times = taken.select(F.col("doc_id").alias("__id"), F.col("__tie").alias("__taken"), *[F.col(level).alias(f"__{level}") for level in levels], "epoch")
    times = times.groupBy(*keys, "epoch").agg(F.count(F.lit(1)).alias("__times"))
    path = [F.coalesce(F.col(level).cast("string"), F.lit("")) for level in levels]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__taken"),
                       *[column.alias(f"__{level}") for column, level in zip(path, levels, strict=True)])
    # Only keys that occur again need their number of rows.
    have = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have")).where("__have > 1")

    def same(a: DataFrame, b: DataFrame) -> Column:
        condition = F.lit(True)
        for key in keys:
            condition = condition & a[key].eqNullSafe(b[key])
        return condition

    plan = times.join(have, same(times, have), "left").select(*[times[k] for k in keys], "epoch", "__times", F.coalesce("__have", F.lit(1)).alias("__have"))
    plan = cut_lineage(plan)
    found = rows.join(plan, same(rows, plan)).select("__row", *[plan[k] for k in keys], "epoch", "__times", "__have")
    whole = found.where("__times = __have").select("__row.*")
    part = (found.where("__times < __have").groupBy(*keys, "epoch").agg(F.any_value("__row").alias("__row"), F.min("__times").alias("__times"))
            .select("__row", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select("__row.*"))
    return whole.unionByName(part)
