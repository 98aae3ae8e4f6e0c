"""The corpus operators against brute force, on small tables with nulls, ties and long texts."""

import collections
import hashlib
import itertools
import json
import pathlib
import re
import zlib

import numpy as np
import pytest

from lexspan.llm import (language_id, licenses, line_chunks, mixing, ngram_jaccard, packing, prefix_hash, quality, suffix_tree, unit_dedup)
from lexspan.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text(seed, words=80):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(k)}" + (".\n" if k % 17 == 0 else "") for k in rng.zipf(1.3, words) % 400)


@pytest.fixture(scope="module")
def rows():
    base = _text(1, 200)
    near = base.replace("w3", "w9", 1)
    rows = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \t\n"), (6, "One two"), (7, "one TWO"), (8, "É ß ½ 東京 " + _text(8)),
            (9, _text(9, 4000)), (10, "a  b   c\n\n\n d \n"), (11, base + " " + _text(11, 10))]
    return rows + [(k, _text(k)) for k in range(12, 30)] + [(29, _text(29))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # A clashing extra column must not matter.
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i == 6 else f"s{i % 3}", i) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, start int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_jaccard_components(docs, rows, empty):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    ids = [i for i, _ in rows]
    label = list(ids)
    for _ in ids:
        for a in range(len(ids)):
            for b in range(len(ids)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.join(docs).collect())
    assert got == sorted((i, len(s), c) for i, s, c in zip(ids, sets, label, strict=True))
    assert ngram_jaccard.join(empty).count() == 0


def test_jaccard_repeated_rows_and_null_ids(spark, empty):
    base, other, alone = _text(50, 120), _text(51, 120), _text(52, 120)
    near, third = base + " added words here", _text(53, 90)
    rows = [(5, base, "x"), (5, base, "x"), (5, other, "y"), (7, near, "z"), (None, alone, "n"), (None, alone + " more", "m"), (9, other, "w"), (None, base, "q"),
            (3, None, "e"), (3, "", "e"), (None, " \n", "b"), (8, third, "t"), (8, third, "u")]
    table = spark.createDataFrame(rows, "doc_id long, text string, tie string").repartition(3)
    label = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_jaccard.join(table).collect() if r.n_shingles}
    assert {c for (i, _), c in label.items() if i == 7} == {5} and {c for (i, _), c in label.items() if i == 9} == {5}
    kept = sorted(((r.doc_id, r.text, r.tie) for r in ngram_jaccard.keep_one(table).collect()), key=str)
    assert [(i, t) for i, t, _ in kept if t == alone or t == alone + " more"] in ([(None, alone)], [(None, alone + " more")])
    assert sorted((i, t) for i, t, _ in kept if i and (t or "").strip()) == sorted([(5, base), (5, other), (8, third)])
    assert sum(not (t or "").strip() for _, t, _ in kept) == 3 and len(kept) == 7
    assert ngram_jaccard.keep_one(empty).count() == 0 and ngram_jaccard.keep_one(empty).columns == empty.columns


def test_near_misses_of_one_group(spark):
    """Sets that share a long part and miss the threshold stay apart; the ones at it link."""
    shared = [f"s{k}" for k in range(70)]
    texts = [" ".join(shared + ([] if d % 10 else [f"g{k}" for k in range(10)]) + [f"d{d}w{k}" for k in range(12 if d % 10 else 3)]) for d in range(80)]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    expected = list(range(80))
    for _ in range(3):
        for a in range(80):
            for b in range(80):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    expected[a] = expected[b] = min(expected[a], expected[b])
    got = {r.doc_id: r.component_id for r in ngram_jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[k] for k in range(80)] == expected and 1 < len(set(expected)) < 80


def test_near_misses_are_not_paired(spark, monkeypatch):
    # 60 copies with two changed words each, at one common place at most: any two just miss the threshold.
    base, texts = _text(11, 90).split(), []
    for one, other in list(itertools.combinations(range(2, 90, 7), 2))[:60]:
        words = list(base)
        words[one], words[other] = f"own{one}x{other}", f"other{one}x{other}"
        texts.append(" ".join(words))
    texts += [texts[0] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sent, linked = [], ngram_jaccard._linked

    def counted(pairs, sets):
        sent.append(pairs.count())
        return linked(pairs, sets)

    monkeypatch.setattr(ngram_jaccard, "_linked", counted)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.join(docs).collect()}
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))
    pairs = [(a, b) for a in label for b in label if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label)) and len(set(label)) > 40
    assert sent[-1] <= 60, sent


def test_parities_differ_no_more_than_sets():
    random = np.random.default_rng(5)
    for size in (0, 1, 300, 5000):
        both, one = (random.integers(0, 1 << 64, n, dtype=np.uint64) for n in (size, 40))
        a, b = np.concatenate([both, one[:25]]), np.concatenate([both, one[25:]])
        bits = sum(int(x).bit_count() for x in (ngram_jaccard.parities(a) ^ ngram_jaccard.parities(b)).view(np.uint64))
        assert bits <= 40 and (40 - bits) % 2 == 0


def test_language(docs, spark, empty):
    learning = spark.createDataFrame([("the house and the garden", "en"), ("das haus und der garten", "de"), ("x", None)], "text string, lang string")
    asked = spark.createDataFrame([(1, "The GARDEN house"), (2, "gartenhaus und"), (3, None), (4, "12 ½ !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, learning).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert 0.5 < got[1][1] <= 1 and got[3][1] == 0
    assert {r.lang_pred for r in language_id.identify(asked, learning.where("lang is null")).collect()} == {"und"}
    assert language_id.identify(asked.where("doc_id < 0"), learning).count() == 0


def test_language_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcde", "bb": "cdefgh", "cc": "xyzabé"}

    def say(lang, words):
        return " ".join("".join(rng.choice(list(letters[lang]), rng.integers(1, 7))) for _ in range(words))

    learned = [(say(lang, 60), lang) for lang in letters for _ in range(8)] + [("onlyonce", "bb"), (None, "aa"), ("", "cc"), ("zz yy", None)]
    texts = [say(lang, n) for lang in letters for n in (1, 5, 40)] + ["onlyonce", "ONLYONCE ½", "日本", None, "", " 12 ", say("aa", 9000) + say("bb", 5), "onlyonce"]
    counts = {lang: {size: collections.Counter() for size in (0, 1, 2, 3, 4)} for lang in letters}
    for text, lang in learned:
        for word in language_id.words_of(text) if lang else []:
            counts[lang][0][word] += 1
            for size in language_id.ORDERS:
                counts[lang][size].update(f" {word} "[k:k + size] for k in range(len(word) + 3 - size))

    def scores(size, gram):
        totals = [counts[lang][size].total() for lang in sorted(counts)]
        return [round(1e6 * (np.log10(counts[lang][size][gram] / t) if gram in counts[lang][size] else min(-7, np.log10(0.5 / t))))
                for lang, t in zip(sorted(counts), totals, strict=True)]

    def known(size, gram):
        return any(gram in c[size] for c in counts.values())

    def expect(text):
        words = language_id.words_of(text)
        if not language_id.has_letter(words):
            return "und", 0
        total = np.zeros(3)
        for word in words:
            if known(0, word):
                total += scores(0, word)
                continue
            for size in language_id.ORDERS:
                found = [scores(size, g) for k in range(len(word) + 3 - size) if known(size, g := f" {word} "[k:k + size])]
                if found:
                    total += np.floor(np.mean(found, axis=0) + 0.5)
                    break
        best = int(np.argmax(total))
        return sorted(counts)[best], 1 / (10 ** ((total - total[best]) / 1e6)).sum()

    asked = spark.createDataFrame([(None if k == 3 else k, t, "w", k) for k, t in enumerate(texts)], "doc_id long, text string, word string, row int").repartition(3)
    model = spark.createDataFrame(learned, "text string, lang string")
    for sent in (250_000, 40, 1):  # what tasks are sent changes no result
        monkeypatch.setattr(language_id, "SENT_WORDS", sent)
        got = {r.doc_id: r for r in language_id.identify(asked, model).collect()}
        assert len(got) == len(texts)
        for k, text in enumerate(texts):
            row, (lang, score) = got[None if k == 3 else k], expect(text)
            assert row.lang_pred == lang and abs(row.score - score) < 1e-4, (text, row, lang, score)
        once = texts.index("onlyonce")
        assert got[once].lang_pred == "bb" and got[len(texts) - 1].score == got[once].score


def test_prefix_hashes_answer_spans():
    a, b = prefix_hash.PrefixHashes("xxabcdefg"), prefix_hash.PrefixHashes("abcdeXfg")
    assert a.equal(2, b, 0, 5) and not a.equal(2, b, 0, 6) and a.common_extension(2, b, 0) == 5
    assert prefix_hash.likeness(prefix_hash.PrefixHashes("").fingerprint(), a.fingerprint()) == 0


def test_fingerprints(spark, rows, empty):
    unique = rows[:-1]
    table = spark.createDataFrame(unique, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in prefix_hash.fingerprints(table).collect()}
    assert len(got) == len(unique)
    for k, (i, text) in enumerate(unique):
        text, after = text or "", unique[(k + 1) % len(unique)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited >= 0.69 or len(text) < 32
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == text)
    assert got[0].near_next == 1
    assert prefix_hash.fingerprints(empty).count() == 0


def test_mix_takes_repeated_rows_as_often_as_they_are_selected(spark, empty):
    rows = [(1, "one two three", "en", "a", 1), (1, "one two three", "en", "a", 2), (2, "four five", "en", "a", 3), (None, None, None, None, 4), (3, "six", "de", None, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __row int").repartition(2)
    weights = [{}, {}]
    for seed in range(4):
        for share, epochs in ((0.5, 1), (1.0, 1), (1.6, 3)):
            settings = {"share": share, "max_epochs": epochs, "seed": seed, "levels": ("lang", "source")}
            chosen = collections.Counter((r.doc_id, r.lang) for r in mixing.select(table, weights, **settings).collect())
            mixed = mixing.mix(table, weights, **settings)
            assert mixed.columns == table.columns
            assert collections.Counter((r.doc_id, r.lang or "") for r in mixed.collect()) == chosen
    assert mixing.mix(empty, weights, levels=("lang", "source")).count() == 0


def test_packing_is_a_partition_of_all_tokens(docs, rows, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows[:-2]}
    pieces = packing.pack(docs.where("doc_id < 29"), tokenizer_path()).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start:p.start + p.length].tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
    assert by_doc.keys() == ids.keys() and {i: sum(n for _, n in p) for i, p in by_doc.items()} == {i: len(v) for i, v in ids.items()}
    sizes = [sum(n for _, n in p) for p in by_sequence.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_round_robin_carries_deficits():
    quota = np.array([700_000, 300_000, 48_575, 1])
    take = packing.round_robin(quota)
    assert (take.sum(axis=1) == 1024).all() and (take.sum(axis=0) == quota).all() and (take >= 0).all()
    assert np.abs(np.cumsum(take, axis=0) - np.outer(np.arange(1, 1025), quota / 1024)).max() < 2


def test_quality_counts(docs, rows, spark, empty):
    labels = spark.createDataFrame([(0, 1), (9, None)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in quality.assess(docs, labels).collect())
    expected = []
    for i, text in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        seen, marked = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k:k + 3])] > 1:
                marked |= {k, k + 1, k + 2}
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked),
                         len(w) >= 50 and 100 * len(marked) <= 50 * len(w)))
    assert got == sorted(expected)
    assert quality.assess(empty, labels).count() == 0


def test_quality_model_separates(spark):
    good, bad = [(k, _text(k)) for k in range(60)], [(100 + k, _text(k).replace(" ", "### ")) for k in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad if i % 4], "doc_id long, quality int")
    found = quality.assess(docs, labels).collect()
    assert sum((r.probability > 0.5) == (r.doc_id < 100) for r in found) >= 118


def test_base_and_tree_scores(docs, rows, empty):
    from pyspark.sql import functions as F
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), "\0"]) for i, t in rows]
    counts = collections.Counter(w for i, t in tokens if i % 5 for w in t)
    n, v = sum(counts.values()), len(counts)
    got = sorted(suffix_tree.score(docs, F.col("doc_id") % 5 != 0).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    for row, (i, t) in zip(got, sorted(tokens, key=lambda x: (x[0], len(x[1]))), strict=True):
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert row.doc_id == i and row.n_tokens == len(t) and row.train_tokens == n and row.n_known == sum(counts[w] > 0 for w in t)
        assert abs(row.base_score - base) < 1e-6 * max(1, -base) and row.score <= 0
    assert suffix_tree.score(empty, F.col("doc_id") % 5 != 0).count() == 0


def _chunks(text):
    """Chunks as the module defines them, in plain Python."""
    lines = text.split("\n")
    hashes = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) for line in lines]
    ends, last = [-1], len(lines) - 1
    for k, own in enumerate(hashes):
        if (own + line_chunks.FACTOR * (hashes[k - 1] if k else 0)) % line_chunks.DIVISOR == 0 and k > ends[-1] + 1:
            ends.append(k)
    ends = [k for k in ends if k < last - 1 or k == -1] + [last]
    return [lines[a + 1:b + 1] for a, b in zip(ends, ends[1:], strict=False)]


def test_line_chunks(docs, spark, empty):
    passage = "\n".join(f"shared line {k} of a passage" for k in range(40))
    rows = [(1, "own one\n" + passage), (2, "x\ny\n" + passage + "\nend"), (3, None), (4, ""), (5, "alone"), (6, "own one\n" + passage)]
    got = {r.doc_id: r for r in line_chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    seen = set()
    for i, text in rows:
        if text is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        left, gone = [], 0
        for chunk in _chunks(text):
            if len(chunk) >= 2 and tuple(chunk) in seen:
                gone += len(chunk)
            else:
                left += chunk
            if len(chunk) >= 2:
                seen.add(tuple(chunk))
        assert (got[i].text, got[i].n_removed_lines, got[i].n_lines) == ("\n".join(left), gone, len(text.split("\n")))
    assert got[2].n_removed_lines > 0 and got[6].n_removed_lines > got[2].n_removed_lines
    assert line_chunks.dedup(empty).count() == 0
    rng = np.random.default_rng(4)
    originals = ["\n".join(f"line {rng.integers(1 << 30)}" for _ in range(n)) for n in range(2, 60)]
    copies = spark.createDataFrame([(k, t) for k, t in enumerate(originals + originals)], "doc_id long, text string").repartition(3)
    left = {r.doc_id: r for r in line_chunks.dedup(copies).collect()}
    assert all(left[k].text == t and left[k + len(originals)].text == "" for k, t in enumerate(originals))


def test_unit_removals(docs, rows, empty):
    first, expected = {}, set()
    tie = {i: t for i, t in rows}
    for i in sorted(tie):
        for start, length, _, digest in unit_dedup.units_of(tie[i] or "", 6):
            if digest in first:
                expected.add((i, start, length, *first[digest]))
            first.setdefault(digest, (i, start))
    got = {(r.doc_id, r.start, r.length, r.first_doc_id, r.first_start) for r in unit_dedup.removals(docs).collect()}
    assert got == expected
    for row in unit_dedup.remove(docs).where("removed_spans is not null").collect():
        text, at, left = tie[row.doc_id], 0, ""
        for span in row.removed_spans:
            left, at = left + text[at:span.start], span.start + span.length
        assert row.text == left + text[at:]
    assert unit_dedup.removals(empty).count() == 0


def test_budgets_fill_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100}
    found = mixing.budgets(leaves, [{"a": 1, "b": 1}, {}], 100, 1)
    assert found == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    assert mixing.budgets(leaves, [{"a": 9, "b": 1}, {}], 200, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 90}
    assert sum(mixing.budgets(leaves, [{}, {}], 1000, 2).values()) == 420


def test_mixing_reaches_budgets(docs, empty):
    weights = [{}, {"s0": 3.0}]
    found = mixing.select(docs, weights, share=0.5, max_epochs=2, levels=("lang", "source")).collect()
    sizes, most = collections.Counter(), collections.Counter()
    for r in found:
        sizes[r.lang, r.source] += r.tokens
        most[r.lang, r.source] = max(most[r.lang, r.source], r.tokens)
    leaves = collections.Counter()
    for r in docs.select("lang", "source", mixing.count_tokens(docs.text).alias("n")).collect():
        leaves[r.lang or "", r.source or ""] += r.n
    wanted = mixing.budgets(dict(leaves), weights, sum(leaves.values()) * 0.5, 2)
    for leaf, budget in wanted.items():
        assert budget <= sizes[leaf] <= budget + most[leaf]
    again = mixing.select(docs, weights, share=0.5, max_epochs=2, levels=("lang", "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.select(empty, weights, levels=("lang", "source")).count() == 0


def test_encoder_gives_the_tokenizers_ids(tmp_path):
    path = tokenizer_path()
    encoder = packing.Encoder(path)
    assert encoder.pairs is not None
    texts = ["", " ", "a" * 5000, " " * 2_000_000 + "b", " \n" * 3000, "<|endoftext|> it's 12³ ½€", "東京 é  x \x00", _text(3, 500)]
    rng = np.random.default_rng(4)
    letters = list(" \n\t\ra Zé1²'sdt.,#$€你𝒜")
    texts += ["".join(rng.choice(letters, 30)) for _ in range(500)]
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == wanted
    # A file that does more than byte pairs goes to the other library.
    content = json.loads(open(path, encoding="utf-8").read())
    content["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(content), encoding="utf-8")
    lower = packing.Encoder(str(other))
    assert lower.pairs is None
    assert np.frombuffer(lower.encode(["ABC Def"])[0], lower.kind).tolist() == lower.tokenizer.encode("abc def", add_special_tokens=False).ids


def _pairs(text):
    words = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
    return {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)


def test_licence_paragraphs(spark, docs, empty):
    notices = [(1000 + k, f"{_text(k, 30)}\n{notice}\n\n{_text(k + 50, 30)}", notice) for k, (_, notice) in enumerate(licenses.NOTICES)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([n[:2] for n in notices] + [notices[0][:2], (None, notices[1][1])], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in table.collect()}
    found = licenses.scan(table).collect()
    at = {i: t.split("\n").index(notice) for i, t, notice in notices}
    hits = collections.Counter((r.doc_id, r.paragraph) for r in found if r.doc_id is not None and r.confirmed)
    assert hits == collections.Counter({(i, k): 2 if i == notices[0][0] else 1 for i, k in at.items()})
    assert any(r.doc_id is None for r in found)
    family = {i: licenses.NOTICES[i - 1000][0] for i, _, _ in notices}
    for r in found:
        body = (text[r.doc_id] or "").split("\n")[r.paragraph]
        own = _pairs(body)
        best = max(len(own & _pairs(n)) / len(own | _pairs(n)) for f, n in licenses.NOTICES if f == r.family)
        assert abs(r.similarity - best) < 1e-9 and r.confirmed == (best >= licenses.MIN_SIMILARITY) and 0.5 <= r.probability <= 1
        if r.confirmed and r.doc_id is not None:
            assert r.family == family[r.doc_id]
    assert licenses.scan(empty).count() == 0


def _tree_score(train, texts):
    """Suffix tree scores by the module's definition, in plain Python."""
    count = collections.Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    root = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    entries, rests = [], []

    def predict(context, word, depth):
        if depth == 0:
            return root(word)
        context = context[len(context) - depth:]
        if (context, word) in entries[depth - 1]:
            return entries[depth - 1][context, word]
        return rests[depth - 1].get(context, 1.0) * predict(context, word, depth - 1)

    while len(rests) < 2 or rests[-1]:
        depth, follow = len(rests) + 1, collections.defaultdict(collections.Counter)
        for t in train:
            for k in range(depth, len(t)):
                follow[tuple(t[k - depth:k])][t[k]] += 1
        new, factors = {}, {}
        for context, nexts in follow.items():
            if depth > 2 and context[1:] not in rests[-1]:
                continue
            total = nexts.total()
            rows = [(w, c, (c - suffix_tree.DISCOUNT) / total, predict(context, w, depth - 1)) for w, c in nexts.items() if c >= suffix_tree.MIN_COUNT]
            rows = [r for r in rows if r[1] * abs(np.log(r[2] / r[3])) >= suffix_tree.ENTRY_GAIN]
            factor = max(1e-9, 1 - sum(r[2] for r in rows)) / max(1e-9, 1 - sum(r[3] for r in rows))
            if rows and sum(c * np.log(p / q) for _, c, p, q in rows) + (total - sum(r[1] for r in rows)) * np.log(factor) >= suffix_tree.STATE_GAIN:
                factors[context] = factor
                new |= {(context, w): p for w, _, p, _ in rows}
        entries.append(new)
        rests.append(factors)
    return len([r for r in rests if r]), [sum(np.log10(predict(tuple(t[:k]), w, min(k, len(rests)))) for k, w in enumerate(t)) for t in texts]


@pytest.mark.parametrize("share", [None, 0.02])
def test_tree_is_whole(spark, monkeypatch, share):
    from pyspark.sql import functions as F
    if share:  # most words and runs take the join
        monkeypatch.setattr(suffix_tree, "KNOWN_SHARE", share)
        monkeypatch.setattr(suffix_tree, "RUN_SHARE", share)
    rng = np.random.default_rng(3)
    # What follows "x y z" depends on the word before it, and words are rare.
    parts = [[f"{a} x y z {b}" for a, b in zip("pqrs", "efgh")] + ["x y z k", "y z m", "z o"], [f"r{k} s{k} t{k}" for k in range(30)]]
    texts = [" ".join(parts[int(rng.random() < 0.3)][int(rng.integers(0, 7))] for _ in range(60)) + f" u{k}" for k in range(24)] + [None, ""]
    tokens = [[*WORD.findall(t or ""), "\0"] for t in texts]
    depth, expected = _tree_score([t for k, t in enumerate(tokens) if k % 5], tokens)
    assert depth >= 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in suffix_tree.score(table, F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == len(texts) and all(abs(got[k] - e) < 1e-6 * max(1, -e) for k, e in enumerate(expected))


def test_tree_leaves_one_table(spark):
    from pyspark.sql import functions as F
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    table = spark.createDataFrame([(k, _text(k)) for k in range(20)], "doc_id long, text string")
    scored = suffix_tree.score(table, F.col("doc_id") % 5 != 0)
    made = [path for path in folder.iterdir() if path not in before]
    assert sum(spark.read.parquet(str(path)).count() > 0 for path in made) == 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert scored.count() == scored.count() == 20


def test_runs_once_are_sent_in_few_bytes(spark):
    import pyarrow as pa
    texts = pa.RecordBatch.from_arrays([pa.array([_text(k, 2000) + f" r{k}" for k in range(50)])], ["text"])
    sent = pa.Table.from_batches(suffix_tree._count_runs(1, 4, None, None)(iter([texts])))
    context, word, n = (np.concatenate([suffix_tree._unpacked(value, name == "context") for value in sent.column(name)]) for name in ("context", "word", "n"))
    pairs = collections.Counter()
    for text in texts.column("text").to_pylist():
        words = [*WORD.findall(text), "\0"]
        pairs.update(zip(words, words[1:]))
    assert sorted(n.tolist()) == sorted(pairs.values()) and len(set(zip(context.tolist(), word.tolist()))) == len(pairs)
    # A row of three hashes and a count has 32 bytes, of which compression takes few.
    assert sum(len(zlib.compress(value.as_py(), 1)) for name in sent.column_names[1:] for value in sent.column(name)) < 14 * len(pairs)


def test_only_repeated_runs_are_sent_whole():
    import types
    import pyarrow as pa
    texts = pa.RecordBatch.from_arrays([pa.array([_text(k, 2000) + f" r{k} s{k} t{k}" for k in range(50)])], ["text"])
    # Words are cut once and read again packed.
    packed = pa.Table.from_batches(suffix_tree._pack_words(iter([texts]))).combine_chunks().to_batches()
    for (words, owners), (again, same) in zip(suffix_tree._tokens(texts), (x for b in packed for x in suffix_tree._tokens(b)), strict=True):
        assert (words == again).all() and (owners == same).all()
    groups = collections.defaultdict(list)
    for batch in suffix_tree._sketch(suffix_tree._repeated_runs(1, None), 4, 2)(iter(packed)):
        for part, places in zip(batch.column("part").to_pylist(), batch.column("places"), strict=True):
            groups[part].append(places)
    bits = np.zeros((4, 4096), dtype=np.uint8)
    for part, places in groups.items():
        merged = suffix_tree._merge_sketch(4096, 2)(pa.table({"part": pa.array([part] * len(places), pa.int32()), "places": pa.array([x.as_py() for x in places])}))
        bits[part] = np.frombuffer(merged.column("bits")[0].as_py(), dtype=np.uint8)
    often = types.SimpleNamespace(value=suffix_tree.Sketch(bits.ravel(), 4))
    counts = [np.concatenate([suffix_tree._unpacked(value) for batch in suffix_tree._count_runs(1, 4, None, None, given)(iter(packed)) for value in batch.column("n")])
              for given in (None, often)]
    assert sorted(counts[1][counts[1] > 1]) == sorted(counts[0][counts[0] > 1])
    assert (counts[1] == 1).sum() < 0.2 * (counts[0] == 1).sum()


def test_levels_share_a_pass_and_stay_packed():
    import types
    import pyarrow as pa
    texts = pa.RecordBatch.from_arrays([pa.array([_text(k % 20, 500) + f" r{k}" for k in range(50)])], ["text"])
    full = types.SimpleNamespace(value=[suffix_tree.Sketch(np.full(8, 255, dtype=np.uint8), 4)] * 3)
    counted = lambda depth, levels: pa.Table.from_batches(suffix_tree._count_runs(depth, 4, None, full, None, levels)(iter([texts])))
    shared, runs = counted(5, 3), lambda table, name: np.sort(np.concatenate([suffix_tree._unpacked(value, name == "word") for value in table.column(name)]))
    for k in range(3):
        own = shared.filter(pa.compute.equal(pa.compute.divide(shared.column("part"), 4), k))
        assert all((runs(own, name) == runs(counted(5 + k, 1), name)).all() for name in ("context", "word", "n"))
    # Runs that repeat leave their bucket packed, in a string for each bucket of the next step, and not as a row each.
    pairs = collections.Counter()
    for text in texts.column("text").to_pylist():
        words = [*WORD.findall(text.translate(LOWER)), "\0"]
        pairs.update(zip(words, words[1:]))
    sent = counted(1, 1)
    merged = [suffix_tree._merge_runs(1, 4)(sent.filter(pa.compute.equal(sent.column("part"), part))) for part in range(4)]
    assert sum(map(len, merged)) <= 4 * 4
    assert sorted(n for table in merged for value in table.column("n") for n in suffix_tree._unpacked(value).tolist()) == sorted(n for n in pairs.values() if n > 1)


def test_order_of_hashes():
    rng = np.random.default_rng(6)
    for size in (0, 1, 2, 3000):
        values = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for found in (np.concatenate([values, values]), values >> np.uint64(60), np.concatenate([values, values[:5] ^ np.uint64(1), values[:5]])):  # some share all but a bit
            assert (suffix_tree._order(found) == np.argsort(found, kind="stable")).all()
            assert sorted(suffix_tree._grouped(found).tolist()) == list(range(len(found)))


def test_lookup_answers_by_string():
    import pyarrow as pa
    texts, known = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([False] * 300), pa.array([_text(k) for k in range(300)])],
                                              ["doc_id", "held_out", "text"]), np.zeros(0)
    sketch = suffix_tree.Sketch(np.zeros(8, dtype=np.uint8), 8)
    held = suffix_tree.Frequent(known.astype(np.uint64), known, known, known.astype(np.uint64), known, sketch, 1)

    class Task:
        def partitionId(self):
            return 0

    import pyspark
    before, pyspark.TaskContext.get = pyspark.TaskContext.get, staticmethod(Task)
    try:
        sent = pa.Table.from_batches(suffix_tree._score_known(type("Held", (), {"value": held}), 8)(iter([texts])))
    finally:
        pyspark.TaskContext.get = before
    none = pa.table({name: pa.array([], pa.binary()) for name in ("words", "counts", "values")})
    replies = pa.concat_tables([suffix_tree._look_up(10, 5)(sent.filter(pa.compute.equal(sent.column("part"), part)), none) for part in range(8)])
    assert len(replies) == 300 + 8  # and not a row of each text for each bucket
    total = suffix_tree._add_up(replies)
    expected = [(k, (len(WORD.findall(_text(k))) + 1) * np.log10(0.5 / 13)) for k in range(300)]
    assert total.column("doc_id").to_pylist() == [k for k, _ in expected] and np.allclose(total.column("base").to_numpy(), [b for _, b in expected])


def test_places_of_hashes():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    for size in (0, 1, 7, 5000):
        table = rng.permutation(np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) & ~np.uint64(0xF)))  # many share a slot
        asked = np.concatenate([table, table + np.uint64(1), rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        there = {int(value): k for k, value in enumerate(table)}
        assert suffix_tree.Places(table).of(asked).tolist() == [there.get(int(value), -1) for value in asked]
        values = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        for gaps in (False, True):
            assert (suffix_tree._unpacked(pa.scalar(suffix_tree._packed(values, gaps), pa.binary()), gaps) == values).all()


def test_lines_of_short_sentences_go(spark):
    short = "En la des et. Tai. Réle eau.\nTwo words\n\nYes."
    wide = "これは長い文の一つである。別の文がここに続いている。"
    rows = [(1, short), (2, "Own line.\n" + short), (3, short), (4, wide + "終わり。"), (5, "始まり。" + wide),
            (6, "One sentence has six whole words. Tail a."), (7, "Head b. One sentence has six whole words.")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text.strip() for r in unit_dedup.remove(table).collect()}
    assert left == {1: short, 2: "Own line.", 3: "", 4: rows[3][1], 5: "始まり。", 6: rows[5][1], 7: "Head b."}
    found = sorted((r.doc_id, r.start, r.length) for r in unit_dedup.removals(table, nested=False).collect())
    assert all(a[0] != b[0] or a[1] + a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_licence_sample_is_of_distinct_lines(spark, monkeypatch):
    for name, bound in (("FAMILY_ROWS", 2), ("CUED_ROWS", 5), ("OTHER_ROWS", 7)):
        monkeypatch.setattr(licenses, name, bound, raising=False)
    hot = ["Released under the MIT License.", "a licence fee of ten", "plain text line"]
    lines = hot * 300 + [notice for _, notice in licenses.NOTICES] + [f"the licence number {k}" for k in range(20)] + [f"other line {k}" for k in range(20)]
    rows = licenses._labelled(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3), "doc_id", "text").collect()
    fixed = collections.Counter((notice, family) for family, notice in licenses.NOTICES for _ in range(5))
    found = collections.Counter((r.body, r.family) for r in rows)
    found.subtract(fixed)
    found = +found
    assert set(found.values()) == {1}
    families = collections.Counter(family for _, family in found)
    assert families[licenses.UNKNOWN] == 12 and all(families[f] in (1, 2) for f in licenses.FAMILIES[1:])
    assert sum(bool(re.search(licenses.CUE, body)) for body, family in found if family == licenses.UNKNOWN) == 5
