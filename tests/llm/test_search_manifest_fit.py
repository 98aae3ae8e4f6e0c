"""Mask search, Merkle manifest and configuration packing against brute force on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from lexspan.llm import configuration_packing, mask_search, merkle, packing
from lexspan.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _words(seed, n, kinds=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(k)}" for k in rng.zipf(1.3, n) % kinds)


@pytest.fixture(scope="module")
def rows():
    special = [(None, "No Id HERE w1 w2", None, None, None), (None, "No Id HERE w1 w2", "en", "s1", 5), (3, None, "en", "s2", 0), (4, "", None, "s2", None),
               (5, " \t\n--", "de", None, 5), (6, "ÉÀ w1 É東京 W1-w1 ½", "fr", "", 9), (7, "the <|endoftext|> end", "en", "s1", 3),
               (8, _words(8, 60_000), "en", "s1", 3), (9, "a  b\n\n", "en", "s1", 3), (9, "a  b\n\n", "en", "s1", 3), (9, "A  b\n\n", "en", "s1", 3)]
    return special + [(k, _words(k % 37, 5 + 29 * k % 400), "en", "hot" if k % 2 else f"s{k % 20}", k) for k in range(10, 330)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns with the names of inner columns must not matter.
    extra = [(*r, "x", 1, 2, "y", None) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, tree string, n long, number long, block string, "
                                 "terms string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    texts = ["w1 w2 w3", "", None, "zzz unseen", "w1 w1 W5 w7", "w1 w2 w3", _words(3, 300), "É東京 no id", "the end of w0"]
    return spark.createDataFrame([(None if k == 8 else k % 7, t, "x") for k, t in enumerate(texts)], "item_id long, text string, doc_id string")


def _best(rows, texts, top):
    found = [collections.Counter(TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    n_docs, n_terms = sum(bool(f) for f in found), sum(f.total() for f in found)
    df = collections.Counter(t for f in found for t in f)
    for text in texts:
        wanted = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for row, f in zip(rows, found):
            m = 25 + 75 * f.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * f[t] // (1000 * f[t] + 8 * m)) * k
                        for t, k in wanted.items() if t in f)
            if score > 0:
                scores.append((-score, row[0] is None, row[0] or 0, row[0]))
        yield [(k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]


def test_mask_search_is_exact(monkeypatch, spark, docs, rows, items):
    texts = [(r.item_id, r.text) for r in items.collect()]
    expected = sorted(((i, *hit) for (i, _), hits in zip(texts, _best(rows, [t for _, t in texts], 10)) for hit in hits), key=repr)
    assert sorted((tuple(r) for r in mask_search.search(docs, items).collect()), key=repr) == expected
    # Small blocks of items, groups of documents and stretches of text change nothing.
    for name, value in (("BLOCK_TERMS", 4), ("LONG_TEXT", 50)):
        monkeypatch.setattr(mask_search, name, value)
    assert sorted((tuple(r) for r in mask_search.search(docs, items).collect()), key=repr) == expected
    assert mask_search.search(docs.where("doc_id < 0"), items).count() == 0
    assert mask_search.search(docs, items.where("item_id < 0")).count() == 0


def test_masks_of_many_terms_and_early_end():
    rng = np.random.default_rng(4)
    terms, rows = 70, 500
    held = rng.random((rows, terms)) < 0.3
    counts = rng.integers(1, 5, (rows, terms))
    owners, numbers = np.nonzero(held)
    wanted = np.arange(terms)
    weights = rng.integers(0, 3000, terms)
    searcher = mask_search.Searcher([(wanted, np.ones(terms, np.int64))], weights, rows, 9000, 10)
    totals = np.full(rows, 18)
    for at in (0, 250):  # two groups; the second starts from the first one's scores
        inside = (owners >= at) & (owners < at + 250)
        searcher.group(np.arange(at, at + 250), np.ones(250, np.int64), totals[:250], owners[inside] - at, numbers[inside],
                       counts[owners[inside], numbers[inside]])
    m = 25 + 75 * 18 * rows // 9000
    scores = (held * weights * (10**9 * counts // (1000 * counts + 8 * m))).sum(axis=1)
    best = sorted((-s, i) for i, s in enumerate(scores.tolist()))[:10]
    assert [(-int(s), int(i)) for s, _, i in zip(*searcher.best[0])] == best


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def _tree(digests):
    """Root and, for each leaf, its levels of (left, right)."""
    paths, level, owner = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for k, path in enumerate(paths):
            at, run = owner[k] % 16, owner[k] // 16 * 16
            path.append(("".join(level[run:run + at]), "".join(level[run + at + 1:run + 16])))
        owner = [o // 16 for o in owner]
        level = [_h(*level[k:k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def _manifest(rows):
    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[3]].append((row[0] is not None, row[0] or 0, _leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([leaf for _, _, leaf, _ in sorted(sources[s], key=lambda x: x[:3])]) for s in names]
    root, above = _tree([subroot for subroot, _ in trees])
    for name, (subroot, paths), rest in zip(names, trees, above):
        for (_, _, leaf, row), path in zip(sorted(sources[name], key=lambda x: x[:3]), paths):
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                folded = _leaf((row[0], row[1] and row[1].translate(LOWER), *row[2:]))
            for left, right in path + rest:
                folded = _h(left, folded, right)
            yield row[0], leaf, subroot, root, _h(*(left + right for left, right in path + rest)), folded, folded == root


def test_merkle_manifest(docs, rows):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = merkle.manifest(docs).select(columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(_manifest(rows), key=repr)
    assert {r.verified for r in got} == {True, False}
    assert merkle.manifest(docs.where("doc_id < 0")).count() == 0
    lone = [r for r in rows if r[0] == 6]
    assert [tuple(r) for r in merkle.manifest(docs.where("doc_id = 6")).select(columns).collect()] == list(_manifest(lone))
    assert all(r[1] == r[2] == r[3] for r in _manifest(lone))


def _needed(rows, size=1024):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(tokenizer_path())
    for doc_id, text, *_ in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def _best_fit_decreasing(lengths, size=1024):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    return len(room)


def test_configuration_packing(docs, rows):
    got = configuration_packing.pack(docs, tokenizer_path()).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(_needed(rows), key=repr)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        content.sort()
        assert [o for o, _ in content] == np.cumsum([0] + [n for _, n in content])[:-1].tolist() and sum(content[-1]) <= 1024
    assert len(sequences) <= _best_fit_decreasing([r.length for r in got]) + 1
    assert configuration_packing.pack(docs.where("doc_id < 0"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("low, high, n", [(1, 1023, 4000), (300, 420, 4000), (1, 40, 3000), (600, 1000, 500), (513, 513, 77)])
def test_configuration_program_is_near_its_bound(low, high, n):
    lengths = np.random.default_rng(n).integers(low, high + 1, n)
    counts = np.bincount(lengths, minlength=1025)
    rows = configuration_packing.plan(counts)
    placed = np.zeros(1025, dtype=np.int64)
    for configuration, times in rows:
        assert sum(k * c for k, c in configuration) <= 1024
        for k, c in configuration:
            placed[k] += c * times
    assert (placed == counts).all()
    used = sum(times for _, times in rows)
    assert used <= 1.007 * max(-(-lengths.sum() // 1024), (lengths > 512).sum()) + 2 or used < 0.96 * _best_fit_decreasing(lengths)
    # Each rank of each length has one place of its own.
    segments = configuration_packing.Segments(rows)
    order = np.argsort(lengths, kind="stable")
    ranks = np.empty(n, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])[lengths[order]]
    ranks[order] = np.arange(n) - first
    sequence, offset = segments.place(lengths, ranks)
    filled = np.zeros((used, 1025), dtype=np.int32)
    for s, o, k in zip(sequence, offset, lengths):
        filled[s, o:o + k] += 1
    assert filled.max() == 1 and filled[:, 1024].sum() == 0


def test_ids_are_those_of_tokenizers():
    coder = packing.encoder(tokenizer_path())
    for text in ("hello <|endoftext|> world", "<|endoftext|>", "plain", " " * 3000 + "x", "é 東京\n\n"):
        assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert 50256 in coder.ids("hello <|endoftext|> world").tolist()
