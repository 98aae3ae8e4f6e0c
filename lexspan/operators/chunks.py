"""Sliding token windows for encoders, and the records that carry them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexspan.functions.classify import CENTRAL_SCOPE
from lexspan.functions.columns import as_col, equals, first_reason, is_false, is_true
from lexspan.functions.ids import point_id
from lexspan.functions.pieces import row_function
from lexspan.functions.text import prepare_text

WINDOW, OVERLAP = 440, 48
MAX_TOKENS = 512
DOCUMENT_PREFIX, QUERY_PREFIX = "passage: ", "query: "


# What a tokenizer gives for a list of texts: per text its tokens as (start, end) places in it.
Offsets = list[list[tuple[int, int]]]
_WORD = re.compile(r"\S+")


def words(texts: list[str]) -> Offsets:
    """White-space words as tokens."""
    return [[(w.start(), w.end()) for w in _WORD.finditer(text)] for text in texts]


WINDOW_FIELDS = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("first", "last", "char_start", "char_end")), T.StructField("text", T.StringType()),
                              T.StructField("tokens", T.IntegerType())])


def _windower(tokenizer: Callable[[list[str]], Offsets], window: int, overlap: int, prefix: str | None):
    def cut(text: str | None) -> list[tuple]:
        text = text or ""
        kept = [(start, end) for start, end in tokenizer([text])[0] if end > start]
        found, at = [], 0
        while at < len(kept):
            stop = min(at + window, len(kept))
            low, high = kept[at][0], kept[stop - 1][1]
            found.append((at, stop, low, high, text[low:high]))
            at = len(kept) if stop == len(kept) else stop - overlap
        counts = [None] * len(found) if prefix is None else map(len, tokenizer([prefix + w[4] for w in found]))
        return [(*w, n) for w, n in zip(found, counts, strict=True)]

    return row_function(T.ArrayType(WINDOW_FIELDS), cut).asNondeterministic()


def token_windows(docs: DataFrame, id_cols: list[str], text: str | Column, tokenizer: Callable[[list[str]], Offsets] = words, window: int = WINDOW,
                  overlap: int = OVERLAP, prefix: str | None = None) -> DataFrame:
    """Windows of tokens with their characters in the prepared text: ids, first, last (token
    places, last excluded), char_start, char_end, text, tokens.

    The tokenizer's offsets are two numbers per token and every window is a slice between
    two of them, so the cost is linear in the tokens of a text. ``tokens`` counts what the
    encoder gets for the window behind ``prefix``, special tokens included. A text without
    tokens has no window.
    """
    cut = docs.select(*id_cols, F.explode_outer(_windower(tokenizer, window, overlap, prefix)(prepare_text(text))).alias("w"))
    return cut.where("w IS NOT NULL").select(*id_cols, "w.*")


def word_windows(docs: DataFrame, id_cols: list[str], text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of white-space words with their character span in the prepared text."""
    return token_windows(docs, id_cols, text, window=window, overlap=overlap).select(
        *id_cols, F.col("first").alias("word_start"), F.col("last").alias("word_end"), "char_start", "text", "char_end")


def document_text(text) -> Column:
    return F.concat(F.lit(DOCUMENT_PREFIX), prepare_text(text))


def query_text(text) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), prepare_text(text))


def check_token_limit(text, tokens, limit: int = MAX_TOKENS) -> Column:
    """The text, or a failed job when it has more tokens than the encoder takes."""
    return F.when(as_col(tokens) <= limit, as_col(text)).otherwise(
        F.raise_error(F.lit("input exceeds the encoder's token limit; split before encoding")).cast("string"))


def record_violation() -> Column:
    """Why a retrieval candidate must not be encoded; NULL when it may be."""
    return first_reason(
        (~equals("validity", "unverified") | ~equals("current_validity", "unverified"), "unexpected validity promotion"),
        (~equals("pham_vi", CENTRAL_SCOPE), "noncentral record"),
        (~is_false("answer_evidence_enabled"), "unreviewed record enables answer evidence"),
        (prepare_text("canonical_text") == "", "empty article text"), default=F.lit(None).cast("string"))


# The fields of a record's payload that an article or its document's metadata gives, with their types.
ARTICLE_FIELDS = {"article_id": "string", "article_version_id": "string", "document_id": "string", "document_version_id": "string", "content_sha256": "string"}
METADATA_FIELDS = {
    "pham_vi": "string", "title": "string", "so_ky_hieu": "string", "issuer": "string", "issue_date": "string", "effective_date": "string",
    "reported_expiry_date": "string", "reported_status": "string", "expiry_state": "string", "amendment_state": "string", "corpus_disposition": "string",
    "source_dataset_revision": "string", "source_dataset_url": "string"}
LIST_FIELDS = ("topic_candidates", "quarantined_related_document_ids")


def embedding_records(articles: DataFrame, tokenizer: Callable[[list[str]], Offsets] = words, max_tokens: int = MAX_TOKENS,
                      prefix: str = "lexspan") -> DataFrame:
    """Encoder records of the retrieval candidates, one per window: id, text, payload. A
    candidate that breaks the evidence policy, or a window that the encoder could not take
    whole, fails the job. Fields that the articles lack are NULL, lists empty."""
    rows = articles.where(is_true("retrieval_index_candidate")).withColumn("__why", record_violation())
    guarded = F.when(F.col("__why").isNull(), F.col("canonical_text")).otherwise(F.raise_error(F.col("__why")).cast("string"))

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in articles.columns else F.lit(None)).cast(kind).alias(name)

    carried = F.struct(*[given(n, k) for n, k in {**ARTICLE_FIELDS, **METADATA_FIELDS}.items()], given("label", "string"),
                       *[F.coalesce(given(n, "array<string>"), F.array().cast("array<string>")).alias(n) for n in LIST_FIELDS],
                       F.coalesce(given("reported_status_conflict", "boolean"), F.lit(False)).alias("reported_status_conflict"))
    cut = token_windows(rows.select(carried.alias("c"), guarded.alias("guarded")), ["c"], "guarded", tokenizer, prefix=DOCUMENT_PREFIX)
    child = F.concat_ws(":", "c.article_version_id", F.col("char_start").cast("string"), F.col("char_end").cast("string"))
    payload = F.struct(
        *[F.col(f"c.{n}").alias(n) for n in (*ARTICLE_FIELDS, *METADATA_FIELDS, *LIST_FIELDS, "reported_status_conflict")], child.alias("child_id"),
        F.col("c.label").alias("article_label"), F.col("char_start").alias("canonical_char_start"), F.col("char_end").alias("canonical_char_end"),
        F.col("text").alias("canonical_text"), F.lit("unverified").alias("current_validity"), F.lit(True).alias("retrieval_index_candidate"),
        F.lit(False).alias("answer_evidence_enabled"))
    text = check_token_limit(F.concat(F.lit(DOCUMENT_PREFIX), "text"), "tokens", max_tokens)
    return cut.select(point_id("c.article_id", "c.document_version_id", child, prefix).alias("id"), text.alias("text"), payload.alias("payload"))
