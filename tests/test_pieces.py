import html

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from lexspan.functions import pieces, text
from lexspan.operators import bm25, chunks, parse

PAGE = "<p>Điều 1. " + "x &hellip; y " * 2000 + "</p>"


def _results(udf, *columns: pa.Array) -> list[pa.Array]:
    """What a task gets from one Arrow batch of these columns."""
    return list(udf.func(iter([columns if len(columns) > 1 else columns[0]])))


def test_pieces_are_bounded_and_keep_all_rows_in_order():
    numbers, texts = pa.array(range(1000), pa.int32()), pa.array(["é" * n if n % 3 else None for n in range(1000)])
    found = list(pieces.pieces((numbers, texts), 10_000))
    assert pa.concat_arrays([n for n, _ in found]).equals(numbers) and pa.concat_arrays([t for _, t in found]).equals(texts)
    assert all(len(n) and n.nbytes + t.nbytes <= 10_000 for n, t in found)
    assert [len(c[0]) for c in pieces.pieces((pa.array(["x" * 100_000] * 3),), 10)] == [1, 1, 1]  # a row is not cut
    assert list(pieces.pieces((pa.array([], pa.string()),))) == []


def test_a_batch_of_long_rows_gives_results_piece_by_piece():
    pages = pa.array([PAGE] * 300)
    for udf in (parse._layout, chunks._windower(chunks.words, 440, 48, None)):
        found = _results(udf, pages)
        assert sum(map(len, found)) == 300 and len(found) > 4 and max(map(len, found)) * len(PAGE) <= 2 * pieces.PIECE_BYTES
    laid = parse._scan_layout(PAGE)
    bounds = parse._fold_structure([{"chapter": None, "section": None, "label": "Điều 1", "clause": None, "point": None, "start": 0, "end": len(PAGE)}], [0], len(PAGE))
    spans = pa.array([[{"start": s, "end": e} for s, e, _ in laid["blocks"]]] * 300)
    found = _results(parse._chunks, pages, pa.array([bounds] * 300), spans, pa.array([600] * 300, pa.int32()))
    assert sum(map(len, found)) == 300 and len(found) > 4 and len(found[0][0][0]) > 15
    assert all(r.as_py() == found[0][0].as_py() for a in found for r in a)


def test_row_functions_see_every_row_once_in_any_partitioning(spark):
    cases = [None, "", "R&D", "&eacute;&hellip;" * 300_000, "&copy 2020", *(f"&#{n};" for n in range(200, 260))]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").repartition(7, "i")
    found = {r.i: r.x for r in rows.select("i", text.decode_entities("t").alias("x")).collect()}
    assert found == {i: c if c is None else html.unescape(c) for i, c in enumerate(cases)}
    lengths = pieces.row_function(T.ArrayType(T.IntegerType()), lambda a, b: None if a is None else [len(a), b])
    assert {r.i: r.x for r in rows.select("i", lengths(F.col("t"), F.col("i")).alias("x")).collect()} == {
        i: c if c is None else [len(c), i] for i, c in enumerate(cases)}
    assert rows.where("false").select(lengths(F.col("t"), F.col("i"))).collect() == []


def test_bm25_scores_are_the_same_in_small_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 60))) for i in range(400)], "id int, text string").coalesce(1)
    queries = spark.createDataFrame([(n, f"w{n} w{n + 3} w{n + 3} none") for n in range(12)], "query_id int, query string")

    def hits():
        return sorted(map(tuple, bm25.search(docs, queries, 7, id_cols=["id"], decimals=6).collect()))

    whole = hits()
    monkeypatch.setattr(bm25, "GROUP_BYTES", 3000)
    assert hits() == whole and len(whole) == 84
