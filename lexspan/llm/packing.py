"""Mixture-controlled packing (operator 6): deficit round-robin over source queues.

Every source is a queue of its documents' tokens, cut freely. A window adds its target
share to each queue's deficit and takes the whole tokens of the deficit; what rounding
leaves goes to the largest deficits, and every deficit is carried to the next window. So
each window holds the target proportions to within a token per source, and all windows but
the last are full. Shares are whole tokens per cycle of ``CYCLE`` windows, after which all
deficits are zero again: the round-robin of one cycle, run once, therefore gives the state
of any later window, and any task can go on from any window with the right deficits. When a
queue runs dry the others share its part, and a new cycle is made for those that are left.

The tokens of a window from one source stand together, sources in order of their names. The
last window is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexspan.llm.common import cut_lineage

WINDOW, CYCLE = 1024, 1024
# Fixed value: how byte-level vocabularies split a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

TOKENS = "doc_id long, source string, block int, before long, doc_tokens long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for
    themselves, the others in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def _byte_pairs(path: str):
    """The tokenizer file as byte-pair ranks, or None if it has more than these: another
    split or normaliser, tokens taken out of the text, or ids that are not in merge order."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, split = content["model"], content.get("pre_tokenizer") or {}
    vocabulary, merges = model.get("vocab", {}), model.get("merges", [])
    special = {t["content"] for t in content.get("added_tokens", []) if t.get("special")}
    letters = _bytes_of_letters()
    plain = (model.get("type") == "BPE" and content.get("normalizer") is None and len(special) == len(content.get("added_tokens", []))
             and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    if not plain or not all(c in vocabulary for c in letters):
        return None
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    words = {token: rank for token, rank in vocabulary.items() if token not in special}
    if (any(x >= y for x, y in zip(made, made[1:])) or (made and made[0] <= max(vocabulary[c] for c in letters))
            or len(words) != len(letters) + len(made) or not all(c in letters for token in words for c in token)):
        return None
    import tiktoken
    return tiktoken.Encoding("byte-pairs", pat_str=SPLIT, special_tokens={},
                             mergeable_ranks={bytes(letters[c] for c in token): rank for token, rank in words.items()})


class Encoder:
    """Token ids of texts by a tokenizer file, whole texts at a time.

    A file that is nothing but byte-level pairs is run by the byte-pair coder of tiktoken,
    which gives the same ids in about half the time; any other file, a text with the
    string of an added token (one id of its own), and a text whose white space is too
    much for that coder's splitter, by tokenizers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.pairs = _byte_pairs(path)

    def ids(self, text: str) -> np.ndarray:
        if self.pairs is not None and not any(token in text for token in self.special):
            try:
                return self.pairs.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # a run of white space too long for its splitter
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.ids(text).astype(self.kind).tobytes() for text in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _deal(shares: np.ndarray, total: int) -> np.ndarray:
    """Whole parts of ``total`` in proportion to the shares, one at least for each."""
    exact = shares / shares.sum() * (total - len(shares))
    parts = np.floor(exact).astype(np.int64)
    order = np.argsort(-(exact - parts), kind="stable")
    parts[order[:total - len(shares) - parts.sum()]] += 1
    return parts + 1


def round_robin(quota: np.ndarray, window: int = WINDOW, cycle: int = CYCLE) -> np.ndarray:
    """Tokens that each window of a cycle takes from each queue; ``quota`` sums to window * cycle."""
    take = np.zeros((cycle, len(quota)), dtype=np.int64)
    deficit = np.zeros(len(quota), dtype=np.int64)  # in parts of a token, ``cycle`` to one
    for row in take:
        deficit += quota
        np.maximum(deficit // cycle, 0, out=row)
        spare = window - int(row.sum())
        rest = deficit - row * cycle
        if spare > 0:
            row[np.argsort(-rest, kind="stable")[:spare]] += 1
        while spare < 0:
            full = np.flatnonzero(row > 0)
            back = full[np.argsort(rest[full], kind="stable")[:-spare]]
            row[back] -= 1
            spare += len(back)
            rest[back] += cycle
        deficit -= row * cycle
    return take


@dataclass
class Phase:
    """Windows during which the same queues have tokens. ``quota`` per cycle, or one window's ``take``."""

    first: int
    windows: int
    base: np.ndarray
    quota: np.ndarray | None
    take: np.ndarray | None


@dataclass
class Plan:
    sources: list[str]
    total: int
    window: int
    phases: list[Phase] = field(default_factory=list)


def make_plan(totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW, cycle: int = CYCLE) -> Plan:
    """Phases for queues of the given lengths. Without targets the shares are those of the
    queues themselves; a source without a target has none until all others are dry."""
    sources = sorted(s for s, n in totals.items() if n > 0)
    left = np.array([totals[s] for s in sources], dtype=np.int64)
    weight = left.astype(float) if targets is None else np.array([max(0.0, targets.get(s, 0.0)) for s in sources])
    plan = Plan(sources, int(left.sum()), window)
    base, at = np.zeros(len(sources), dtype=np.int64), 0
    while left.any():
        live = np.flatnonzero((left > 0) & (weight > 0))
        if not len(live):
            live = np.flatnonzero(left > 0)
            weight = np.where(left > 0, left.astype(float), 0.0)
        live = live[np.argsort(-weight[live], kind="stable")[:window * cycle // 2]]
        quota = np.zeros(len(sources), dtype=np.int64)
        quota[live] = _deal(weight[live], window * cycle)
        take = round_robin(quota[live], window, cycle)
        done = np.zeros((cycle + 1, len(live)), dtype=np.int64)
        np.cumsum(take, axis=0, out=done[1:])
        cycles = int((left[live] // quota[live]).min())
        rest = left[live] - cycles * quota[live]
        extra = int((done <= rest).all(axis=1).sum()) - 1
        windows = cycles * cycle + extra
        if windows:
            plan.phases.append(Phase(at, windows, base.copy(), quota, None))
            used = np.zeros_like(base)
            used[live] = cycles * quota[live] + done[extra]
            base, left, at = base + used, left - used, at + windows
        if left.any():
            # One window in which a queue runs dry: the others fill its place in turn.
            now = np.zeros_like(base)
            now[live] = np.minimum(take[extra % cycle], left[live])
            order = np.argsort(-weight, kind="stable")
            short = min(window, int(left.sum())) - int(now.sum())
            while short > 0:
                open_ = [s for s in order if left[s] > now[s]]
                each = max(1, short // len(open_))
                for s in open_:
                    more = min(each, int(left[s] - now[s]), short)
                    now[s] += more
                    short -= more
            plan.phases.append(Phase(at, 1, base.copy(), None, now))
            base, left, at = base + now, left - now, at + 1
    return plan


class Layout:
    """Where the tokens of a queue stand; made in a task from the plan."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.place = {s: k for k, s in enumerate(plan.sources)}
        self.cycles: dict[int, tuple] = {}
        rest = plan.total % plan.window
        sizes = [1 << b for b in range(plan.window.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.last = plan.total // plan.window if rest else None
        self.cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _cycle(self, number: int):
        if number not in self.cycles:
            phase = self.plan.phases[number]
            if phase.take is not None:
                take = phase.take[None, :]
            else:
                live = np.flatnonzero(phase.quota)
                take = np.zeros((CYCLE, len(phase.quota)), dtype=np.int64)
                take[:, live] = round_robin(phase.quota[live], self.plan.window)
            before = np.zeros((len(take) + 1, take.shape[1]), dtype=np.int64)
            np.cumsum(take, axis=0, out=before[1:])
            self.cycles[number] = take, before, np.cumsum(take, axis=1) - take
        return self.cycles[number]

    def pieces(self, source: str, first: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the queue, length, sequence, offset) of the queue's tokens ``first`` to ``first + length``."""
        s, end = self.place[source], first + length
        for number, phase in enumerate(self.plan.phases):
            take, before, aside = self._cycle(number)
            per_cycle = int(before[-1, s])
            base = int(phase.base[s])
            if not per_cycle or end <= base:
                continue
            full, extra = divmod(phase.windows, len(take))
            low, high = max(first, base) - base, min(end - base, full * per_cycle + int(before[extra, s]))
            if low >= high:
                continue
            used = np.flatnonzero(take[:, s])
            starts = before[used, s]
            ends_at = [(j // per_cycle) * len(used) + int(np.searchsorted(starts, j % per_cycle, side="right")) - 1 for j in (low, high - 1)]
            index = np.arange(ends_at[0], ends_at[1] + 1)
            cycle, k = index // len(used), used[index % len(used)]
            at = cycle * per_cycle + before[k, s]
            begin, stop = np.maximum(at, low), np.minimum(at + take[k, s], high)
            window = phase.first + cycle * len(take) + k
            offset = aside[k, s] + begin - at
            for row in zip((begin + base).tolist(), (stop - begin).tolist(), window.tolist(), offset.tolist(), strict=True):
                yield from self._cut(*row) if row[2] == self.last else (row,)

    def _cut(self, start: int, length: int, window: int, offset: int) -> Iterator[tuple[int, int, int, int]]:
        while length:
            part = int(np.searchsorted(self.cuts, offset, side="right")) - 1
            now = min(length, int(self.cuts[part + 1]) - offset)
            yield start, now, window + part, offset - int(self.cuts[part])
            start, length, offset = start + now, length - now, offset + now


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Token ids of every row, with its place in its task's part of its source's queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, sums, encode = TaskContext.get().partitionId(), {}, encoder(tokenizer)
        zero = np.zeros(1, encode.kind).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sources, ids = batch.column("source").to_pylist(), encode.encode(batch.column("text").to_pylist())
                ids = [own + zero for own in ids]
                counts = [len(own) // encode.kind.itemsize for own in ids]
                before = []
                for source, count in zip(sources, counts, strict=True):
                    before.append(sums.get(source, 0))
                    sums[source] = before[-1] + count
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("source"), pa.array([block] * len(ids), pa.int32()), pa.array(before, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], [f.split()[0] for f in TOKENS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """One row per piece: which tokens of which document stand where in which sequence.

    A document is its ids and the id 0. A null text is empty (its one token is the 0), a
    null source shares the queue of the empty name, null and repeated ids are documents of
    their own, and an empty table gives no rows. ``targets`` are token shares by source,
    the corpus's own by default; ``with_ids`` adds the ids of each piece. Other columns are
    not read. One row per source passes the driver.
    """
    spark = docs.sparkSession
    # Written once: the second pass must see the same blocks as the sums.
    tokens = cut_lineage(tokenize(docs, tokenizer, id_col, text_col, source_col))
    sums = tokens.groupBy("source", "block").agg(F.sum("doc_tokens").alias("n"))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    totals = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("doc_tokens").alias("n")).collect()}
    held = spark.sparkContext.broadcast(make_plan(totals, targets))
    kind = encoder(tokenizer).kind
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = None
        types = [pa.int64()] * 7 + [pa.string()] + ([pa.list_(pa.int32())] if with_ids else [])
        for batch in batches:
            layout = layout or Layout(held.value)
            out: list[list] = [[] for _ in types]
            for doc_id, source, base, before, count, ids in zip(
                    *(batch.column(c).to_pylist() for c in ("doc_id", "source", "base", "before", "doc_tokens", "ids")), strict=True):
                values = np.frombuffer(ids, kind).astype("<u4")
                view = memoryview(values.tobytes())
                for start, length, sequence, offset in layout.pieces(source, base + before, count):
                    own = start - base - before
                    row = (doc_id, own, length, zlib.crc32(view[4 * own:4 * (own + length)]), count, sequence, offset, source)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    if with_ids:
                        out[-1].append(values[own:own + length].astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [f.split()[0] for f in schema.split(", ")])

    placed = tokens.join(bases, ["source", "block"])
    return placed.select("doc_id", "source", "base", "before", "doc_tokens", "ids").mapInArrow(run, schema)
