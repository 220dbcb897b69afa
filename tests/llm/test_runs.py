from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm.common import Words
from tidemark.llm.plans import op13_periodic_runs
from tidemark.llm.runs import CommonExtension, SuffixTree, periodic_runs, runs_of_symbols, stretches, word_codes

from .data import awkward, clashing, docs, prose, words


def plain_runs(found, times=4, shortest=6):
    """For each period, the longest stretches that keep it, if no smaller period does."""
    n, out = len(found), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if found[i] != found[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and found[j] == found[j + p]:
                j += 1
            start, length = i, j + p - i
            if length >= max(shortest, times * p) and not any(
                all(found[k] == found[k + d] for k in range(start, start + length - d)) for d in range(1, p)
            ):
                out.append((start, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    found = words(text)
    runs = plain_runs(found)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return (doc_id, len(found), [tuple(r) for r in runs], " ".join(w for i, w in enumerate(found) if i not in gone))


def rows(df):
    return sorted([(r[0], r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in df.collect()], key=repr)


@pytest.mark.parametrize("symbols", [[], [1], [1, 1, 1, 1], [1, 2, 1, 2, 1], [3, 1, 2, 3, 1, 2, 3, 3], [2, 1, 1, 2, 1, 1, 2, 2, 1, 1]])
def test_suffix_trees_list_all_suffixes_in_order(symbols):
    text = [*symbols, 0]
    tree = SuffixTree(symbols)
    order, parted = tree.tour()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    other = [-x for x in symbols] + [-99]
    assert tree.tour(descending=True)[0].tolist() == sorted(range(len(text)), key=lambda i: other[i:])
    common = CommonExtension(order, parted)
    for i in range(len(text)):
        for j in range(len(text)):
            if i != j:
                k = 0
                while text[i + k] == text[j + k]:
                    k += 1
                assert common(np.array([i]), np.array([j])).tolist() == [k]


@pytest.mark.parametrize(("times", "shortest"), [(2, 2), (3, 3), (4, 6), (4, 40), (5, 1)])
def test_matches_plain_runs(times, shortest):
    rng = random.Random(times * 100 + shortest)
    for _ in range(300):
        symbols = [rng.randrange(1 + rng.randrange(3)) for _ in range(rng.randrange(70))]
        if rng.random() < 0.6 and symbols:
            root = [rng.randrange(5) for _ in range(1 + rng.randrange(6))]
            at = rng.randrange(len(symbols))
            symbols[at:at] = (root * 12)[: rng.randrange(60)]
        got = runs_of_symbols(np.array(symbols, np.int64), times, shortest)
        assert [tuple(r) for r in got.tolist()] == plain_runs(symbols, times, shortest), symbols


@pytest.mark.parametrize(("times", "shortest"), [(2, 2), (4, 6), (3, 50)])
def test_no_run_lies_outside_of_the_stretches(times, shortest):
    """Several texts side by side: each text's runs are those of its stretches, with their full length."""
    rng = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            text = [rng.randrange(1 + rng.randrange(40)) for _ in range(rng.randrange(60))]
            root = [rng.randrange(3) for _ in range(1 + rng.randrange(9))]
            text += (root * 30)[: rng.randrange(80)] + [rng.randrange(40) for _ in range(rng.randrange(20))]
            texts.append(text)
        codes, text_of = np.array([c for t in texts for c in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = []
        for a, b in stretches(codes, text_of, times, shortest).tolist():
            assert text_of[a] == text_of[b - 1]
            got += [(int(s + a - first[text_of[a]]), length, p, int(text_of[a])) for s, length, p in runs_of_symbols(codes[a:b], times, shortest).tolist()]
        assert got == [(*r, i) for i, t in enumerate(texts) for r in plain_runs(t, times, shortest)]


def test_equal_words_have_equal_codes():
    raw = [b"a bb a", b"", b"bb\xc3\xa4 a\tbb", b"A"]
    data = np.frombuffer(b"".join(raw), np.uint8)
    codes = word_codes(Words(data, np.cumsum([0] + [len(r) for r in raw]))).tolist()
    a, bb, other, upper = codes[0], codes[1], codes[3], codes[6]
    assert codes == [a, bb, a, other, a, bb, upper] and len({a, bb, other, upper}) == 4


def test_texts_with_runs(spark):
    texts = [
        "la " * 6, "la " * 5, "a b " * 4, "a b " * 3 + "a", "x a b a b a b a b a y", "na na na na na na batman na na na na na na na",
        ("one two three " * 5 + "one two four ") * 4, "é è " * 9, f"{prose(3, 200)} " + "w1 w2 w3 w4 w5 " * 7 + prose(4, 100),
        "\t a \n a\x0ba a a a  a ", "A a " * 3, "a" * 50, ("p " * 6 + "q ") * 5, " ".join(f"u{i % 97}" for i in range(97 * 4)),
    ]
    table = [(i, t, None, None, None) for i, t in enumerate(texts)]
    assert rows(periodic_runs(docs(spark, table))) == sorted([plain_row(i, t) for i, t in enumerate(texts)], key=repr)


def test_awkward_table(spark):
    table = clashing(docs(spark), "runs", "kept", "n_words", "collapsed_text")
    want = [plain_row(r[0], r[1]) if len(r[1] or "") < 50_000 else None for r in awkward()]
    long = {r[0] for r, w in zip(awkward(), want, strict=True) if w is None}
    assert len(long) == 2
    got = rows(periodic_runs(table))
    assert [g for g in got if g[0] not in long] == sorted([w for w in want if w], key=repr)
    assert all(g[2] == [] and g[1] >= 30_000 for g in got if g[0] in long)


def test_a_long_periodic_text(spark):
    """One run over 40,000 words, and the same words many texts long."""
    text = " ".join(f"t{i % 9_000}" for i in range(40_000))
    table = [(1, text, None, None, None), (2, "x " * 30_000, None, None, None)]
    got = {r[0]: r for r in rows(periodic_runs(docs(spark, table)))}
    assert got[1][1:3] == (40_000, [(0, 40_000, 9_000)]) and got[1][3] == " ".join(f"t{i}" for i in range(9_000))
    assert got[2][1:] == (30_000, [(0, 30_000, 1)], "x")


def test_empty_table_and_bounds(spark):
    assert periodic_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="times"):
        periodic_runs(docs(spark), times=1)


def plain_query(doc_id, text):
    found = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(found)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [w if i < a else found[a + (i - a) % p] for i, w in enumerate(found)]
    _, _, runs, kept = plain_row(doc_id, " ".join(found))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digests)


def test_query_matches_plain_version(spark, tmp_path):
    table = [r for r in awkward() if len(r[1] or "") < 50_000]
    rng = random.Random(3)
    table += [(i, prose(i, rng.randrange(90), rng.choice([2, 40])) + rng.choice(["", " x" * 8]), "en", "s", 1) for i in range(10_000, 10_400)]
    docs(spark, table).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted([plain_query(r[0], r[1]) for r in table], key=repr)
    assert sum(r.n_runs > 0 for r in got.collect()) > 20
