from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.collocation import Entries, Phrases, _combined, _merge_stripes, collocations, marked, top_per_group
from tidemark.llm.common import Scratch

from .data import awkward, clashing, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=4, least=30, kept=2000, percent=80):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            f = counts.setdefault(lang, Counter())
            for size in range(1, longest + 1):
                f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        most[p[i:j]] = max(most[p[i:j]], a)
        found = []
        for p, a in candidates.items():
            if 100 * most[p] >= percent * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:kept], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def texts(seed, n, langs=("en", "fr", None, "und")):
    rng = random.Random(seed)
    phrases = ["New York City", "new york", "of the", "Größe ist", "a b c d", "b c d e", "x\ty  z", "la la la la la", "Ünd so"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(phrases) if rng.random() < 0.5 else f"w{rng.randrange(12)}")
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "? ", " - ", ""]))
        rows.append((i, "".join(parts), rng.choice(langs), "s", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("longest", "least", "percent", "bits"), [(4, 30, 80, None), (4, 5, 50, 8), (3, 8, 100, 12), (2, 30, 80, 16)])
def test_matches_plain_version(spark, seed, longest, least, percent, bits):
    rows = texts(seed, 150) + awkward()
    table = clashing(docs(spark, rows), "part", "words", "prefix", "n").repartition(7)
    got = collocations(table, longest=longest, least=least, subsumed_percent=percent, class_bits=bits, segments=3, hot=40)
    want = plain(rows, longest, least, percent=percent)
    assert rows_of(got) == want and len(want) > 10


def test_few_kept_in_rounds_and_ties(spark):
    """Phrases of one score are in the order of their bytes, also where a language's candidates are cut down in rounds."""
    rows = [(i, f"{a}1 {a}2. {a}1 {a}2", "en", "s", 1) for i in range(20) for a in ("p", "é", "z", "A", "\U0001f600", "￮")]
    rows += texts(3, 60, ["en"])
    assert rows_of(collocations(docs(spark, rows), kept=7, group_rows=3)) == plain(rows, kept=7)


def test_groups_are_cut_down_exactly(spark):
    rows = [(g, (i * 7919) % 1000) for g in "ab" for i in range(1000 if g == "a" else 5)]
    scratch = Scratch(spark, "test")
    got = top_per_group(scratch, spark.createDataFrame(rows, "g string, x long"), "g", [F.col("x").desc()], 4, "t", 50)
    assert sorted((r.g, r.x, r.rank) for r in got.collect()) == sorted(
        (g, x, i) for g in "ab" for i, x in enumerate(sorted((x for h, x in rows if h == g), reverse=True)[:4], 1)
    )


def test_pieces_and_words():
    raw = "A b.c  D\te,f g".encode()
    both = Phrases(np.frombuffer(raw + b"a b", np.uint8), np.array([0, len(raw), len(raw), len(raw) + 3]), pa.array(["x", "x", "y"]))
    names = [both.dictionary[int(both.word_of[w])].as_py() for w in both.words]
    assert names == ["a", "b", "c", "d", "e", "f", "g", "a", "b"]
    assert both.joined.tolist() == [True, False, True, True, False, True, False, True, False]
    assert both.words[0] != both.words[7]
    found = [[" ".join(names[int(f) + i] for i in range(size)) for f in first] for size, (_, _, first) in enumerate(both.grown([], 3), 1)]
    assert sorted(found[1]) == ["a b", "a b", "c d", "d e", "f g"] and found[2] == ["c d e"]


def test_counts_of_classes_stop_at_the_least():
    classes, counts = _combined(np.array([5, 3, 5, 5]), np.array([20, 1, 9, 7], np.uint32), 30)
    assert classes.tolist() == [3, 5] and counts.tolist() == [1, 30]
    bitmap = np.zeros(2, np.uint8)
    bitmap[1] = 0b100
    assert marked(bitmap, np.array([10 << 60, 9 << 60, 10 << 60 | 5], np.uint64)).tolist() == [True, False, True]


def test_stripes_merge_elementwise_across_batches():
    """Stripes of one key that lie in several batches, or fill more than one."""
    raw = b"a x. a x. a x. a y. a y. a z. a. a. a. b x"
    entries = Entries(2)
    for _ in range(2):
        entries.add(Phrases(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), pa.array(["en gb"])), [])
        entries.combine()
    made = pa.Table.from_batches(list(entries.stripes(np.zeros(8, np.uint8), 4)))

    def shown(row):
        listed = {} if row["words"] is None else dict(zip(row["words"].split("\n"), map(int, row["counts"].split("\n")), strict=True))
        return (row["lang"], row["prefix"], row["total"], listed)

    want = {"a": (18, {"x": 6, "y": 4, "z": 2}), "b": (2, {"x": 2}), "x": (8, {}), "y": (4, {}), "z": (2, {})}
    assert sorted(map(shown, made.to_pylist()), key=repr) == sorted((("en gb", k, *v) for k, v in want.items()), key=repr)
    split = pa.Table.from_batches(list(entries.stripes(np.full(8, 255, np.uint8), 64))).to_pylist()
    assert len([r for r in split if r["prefix"] == "a"]) > 1 and sum(r["total"] for r in split) == 34
    made = made.sort_by("prefix").slice(0, 2)
    made = made.append_column("part", pa.array([0] * made.num_rows, pa.int32()))
    a, b = made.slice(0, 1).to_batches()[0], made.slice(1).to_batches()[0]
    for order in ([a, a, a, b, b], [a, b], [pa.Table.from_batches([a, a, b]).combine_chunks().to_batches()[0], b]):
        got = pa.Table.from_batches(list(_merge_stripes(iter(order)))).to_pylist()
        times = [sum(x.column("prefix").to_pylist().count(name) for x in order) for name in "ab"]
        assert [shown(r) for r in got] == [
            ("en gb", name, want[name][0] * n, {w: c * n for w, c in want[name][1].items()}) for name, n in zip("ab", times, strict=True)
        ]


def test_empty_tables(spark):
    assert rows_of(collocations(docs(spark, []))) == []
    assert rows_of(collocations(docs(spark, [(1, None, None, None, None), (2, "", "en", None, None)]))) == []
