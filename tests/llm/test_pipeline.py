"""The pipeline's stages against brute force, each on all that its predecessor kept."""

import collections
import os

import numpy as np
import pytest

import corpus_pipeline
from lexspan.llm import line_chunks, mixing, quality
from lexspan.llm.queries import MIX, tokenizer_path
from tests.llm.test_operators import LOWER, WORD, _chunks, _text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, passage = _text(1, 300), "\n".join(f"line {k} that several documents share" for k in range(30))
    texts = [base, base, base.replace("w3", "w9", 1), None, "", "too short", "again " * 90, _text(2) + "\n" + passage, _text(3) + "\n" + passage]
    texts += [_text(k, 120) for k in range(20, 45)] + [_text(5, 3000)]
    rows = [(k, t, ["en", "de", None][k % 3], [None, "src1", "src2", "src5"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _rules(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen, marked = collections.Counter(windows), set()
    for k, window in enumerate(windows):
        if seen[window] > 1:
            marked |= {k, k + 1, k + 2}
    return len(words) >= 50 and 100 * len(marked) <= 50 * len(words)


def _without_repeats(texts):
    seen, left = set(), {}
    for i in sorted(texts):
        kept, gone = [], False
        for chunk in _chunks(texts[i]):
            again = len(chunk) >= line_chunks.MIN_LINES and tuple(chunk) in seen
            seen.add(tuple(chunk))
            gone |= again
            kept += [] if again else chunk
        text = "\n".join(kept)
        if not gone or text.strip(" "):
            left[i] = text
    return left


def _one_of_each(texts):
    sets = {}
    for i, text in texts.items():
        w = WORD.findall(text.translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: t for i, t in texts.items() if label[i] == i}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages, written = dict(corpus_pipeline.STAGES), iter(range(9))

    def after(name):
        nonlocal docs
        path = f"{folder}/stage{next(written)}"
        stages[name](spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        return docs.collect()

    good = {i: r.text for i, r in rows.items() if _rules(r.text)}
    assert {r.doc_id: r.text for r in after("quality_rules")} == good and docs.columns == columns
    lines = _without_repeats(good)
    assert {r.doc_id: r.text for r in after("line_dedup")} == lines and docs.columns == columns
    alone = _one_of_each(lines)
    assert {r.doc_id: r.text for r in after("ngram_jaccard")} == alone and docs.columns == columns and len(alone) < len(good)

    def leaf(i):
        source = rows[i].source or ""
        return str(int(source[3:] or 0) % 3), rows[i].lang or "", source

    tokens, sizes, most = {i: len(WORD.findall(t)) for i, t in alone.items()}, collections.Counter(), collections.Counter()
    for i, n in tokens.items():
        sizes[leaf(i)] += n
        most[leaf(i)] = max(most[leaf(i)], n)
    wanted = mixing.budgets(dict(sizes), MIX, sum(sizes.values()) * 0.8, 2)
    mixed, taken = after("mixing"), collections.Counter()
    assert docs.columns == columns and all(alone[r.doc_id] == r.text for r in mixed)
    assert max(collections.Counter(r.doc_id for r in mixed).values()) <= 2
    for r in mixed:
        taken[leaf(r.doc_id)] += tokens[r.doc_id]
    assert all(budget <= taken[k] <= budget + most[k] for k, budget in wanted.items())

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    total = collections.Counter()
    for r in mixed:
        total[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    packed, sequences = collections.Counter(), collections.Counter()
    for p in after("packing"):
        packed[p.doc_id] += p.length
        sequences[p.sequence_id] += p.length
    assert packed == total
    assert all(n == 1024 or n & (n - 1) == 0 for n in sequences.values()) and np.ptp(list(sequences)) == len(sequences) - 1


def test_quality_is_fitted_away_from_the_driver(spark, monkeypatch):
    texts = [(k, _text(k, 80) if k % 2 else "buy now " + "cheap pills " * (20 + k), k % 2) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, quality int").repartition(3)
    labels = docs.select("doc_id", "quality")
    driver, fit = os.getpid(), quality._fit_weights

    def elsewhere(rows):
        assert os.getpid() != driver
        return fit(rows)

    monkeypatch.setattr(quality, "_fit_weights", elsewhere)
    model = quality.fit(docs, labels)
    assert model is not None and model.weights.any()
    assert quality.fit(docs, labels.where("quality = 1")) is None


def test_pieces_of_the_fit_change_no_bit(monkeypatch):
    random = np.random.default_rng(3)
    rows = [(k % 2, np.sort(random.choice(1 << quality.HASH_BITS, 50 + k, replace=False)).astype(np.int32) // (1 + k % 3), random.random(50 + k, np.float32))
            for k in range(30)]
    whole = quality._fit_weights(rows, steps=5)
    monkeypatch.setattr(quality._cuts, "__defaults__", (40,))
    cut = quality._fit_weights(rows, steps=5)
    assert np.array_equal(whole[0], cut[0]) and whole[1] == cut[1]
