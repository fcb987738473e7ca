"""NN-descent, wavelet-matrix fill-in-middle and phrase collocations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_spark.llm import nn_descent, phrases, wavelet_infill

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = [None, "", " ", " \n\t ", "a", "one two", "ONE  two ", "a\n\nb\n", "x" * 70_000, "é😀 " * 3000, "keep <P> me", "<S>", "\x0bq\x0c"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 7))) for _ in range(words))


def test_wavelet_matrix_ranks():
    r = np.random.default_rng(1)
    values = r.integers(0, 7, 1000).astype(np.uint8)
    matrix = wavelet_infill.WaveletMatrix(values, 3)
    places = np.array([0, 1, 63, 64, 65, 500, 999, 1000])
    for v in range(7):
        assert matrix.rank(v, places).tolist() == [int((values[:p] == v).sum()) for p in places]
    found = matrix.locate((1, 4), np.array([0, 1, 10]), np.zeros(3, np.int64), np.full(3, 1000))
    ends = np.flatnonzero((values == 1) | (values == 4)) + 1
    assert found.tolist() == [0, ends[0], ends[9]]


def test_fill_in_middle_against_the_units_of_a_regex(spark):
    texts = [*ODD, *(prose(n, n) + (" \n" if n % 3 else "") for n in range(40))]
    data = [(i, t, "mine", 1) for i, t in enumerate(texts)] + [(None, "no id here", "mine", 2), (3, texts[3], "mine", 3)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, fim_text string, draw int")
    out = wavelet_infill.fill_in_middle(frame, rate=80, spm=50).withColumn("back", wavelet_infill.restored(F.col("fim_form"), F.col("fim_text")))
    assert out.columns[:3] == ["doc_id", "text", "draw"]
    rows = out.collect()
    assert len(rows) == len(data) and {r.fim_form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = r.text or ""
        units = UNIT.findall(text)
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 80
        form = "plain" if plain else "spm" if h4 % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.fim_units, r.fim_form, r.fim_text, r.back) == (n, form, want, text)
        assert (r.fim_prefix_chars, r.fim_middle_chars) == ((None, None) if plain else (len(p), len(m)))
    assert wavelet_infill.fill_in_middle(frame.limit(0)).count() == 0


def test_other_units():
    text = "a b\nc d\n\ne"
    lines, zero = wavelet_infill.cuts([text], np.array([2]), np.array([4]), "line"), np.array([0])
    assert lines.iloc[0].tolist() == [4, len("a b\nc d\n"), len(text)]
    assert wavelet_infill.cuts([text], np.array([3]), zero, "character").iloc[0].tolist() == [len(text), 0, 3]


def brute_phrases(docs, least, top, inside=50):
    counts: Counter = Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                counts.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    found = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    rows = {}
    for (lang, w), a in found.items():
        cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [f for (other, x), f in found.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if not any(100 * f >= inside * a for f in longer):
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    total = Counter()
    for (lang, w), f in counts.items():
        total[lang] += f * (len(w) == 1)
    return {
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, ranked in rows.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1)
    }


@pytest.mark.parametrize(("trigger", "longest"), [(16, 512), (3, 4), (1, 512), (10**9, 5)])
def test_phrases_against_counting_everything(spark, monkeypatch, trigger, longest):
    monkeypatch.setattr(phrases, "TRIGGER", trigger)
    monkeypatch.setattr(phrases, "LONGEST", longest)
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 16)
    r = random.Random(2)
    words = ["the", "of", "and", "New", "YORK", "city", "é😀", "x\x1fy", "was", "a", "it's", "-", "to"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ".\n", " ; "]) for _ in range(r.randint(0, 120))) for _ in range(60)]
    docs = [(r.choice(["en", "fr", None]), t) for t in texts] + [("en", texts[0])] * 30 + [("de", "w " * 3000), (None, None), ("fr", ""), ("fr", ".,;")]
    frame = spark.createDataFrame([(lang, t, 1, "mine") for lang, t in docs], "lang string, text string, n int, phrase string")
    got = {tuple(row) for row in phrases.collocations(frame, least=6, top=25).collect()}
    assert got == brute_phrases(docs, 6, 25)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def nearest(ids, x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]]
    return [(ids[i], d[i]) for i in order[:k]]


def vectors_frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame([*rows, *extra], "vec_id bigint, embedding array<double>, node int")


def test_neighbours_of_clusters_and_copies(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 24))
    x = np.concatenate([centre[i % 12] + 0.3 * r.normal(size=24) for i in range(700)]).reshape(700, 24)
    x[600:660] = x[7]  # one very common vector
    ids = np.arange(700) * 10
    bad = [(10001 * 100, v, 1) for v in (None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24)] + [(None, x[0].tolist(), 1), (99_900, [1.0, 2.0], 1), (0, x[0].tolist(), 1)]
    got: dict = {}
    for row in nn_descent.neighbours(vectors_frame(spark, ids, x, bad), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    hits = 0
    assert set(got) == {int(i) for i in ids if i % 100 == 0}  # the narrow vector has no others of its width
    for q in (i for i in range(700) if ids[i] % 100 == 0):
        mine, want = sorted(got[int(ids[q])]), nearest(ids, x, q, 10)
        assert [rank for rank, _, _ in mine] == list(range(1, 11))
        at = {int(i): d for i, d in nearest(ids, x, q, 700)}
        assert all(score == pytest.approx(at[i], rel=1e-12, abs=1e-12) for _, i, score in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits += len({i for i, _ in want} & {i for _, i, _ in mine})
    assert hits >= 0.98 * 700  # 70 queries of 10


def test_few_vectors_are_all_found(spark):
    x = np.array([[1.0, 0.0], [2.0, 0.0], [4.0, 0.0], [1.0, 0.0], [1e200, 1e200], [1e-200, 0.0]])
    got = nn_descent.neighbours(vectors_frame(spark, [0, 1, 2, 3, 4, 5], x), F.lit(True), k=3).collect()
    told = {}
    for row in got:
        told.setdefault(row.query_id, {})[row.rank] = (row.vec_id, row.score)
    assert [told[0][n] for n in (1, 2, 3)] == [(3, 0.0), (1, 1.0), (5, 1.0)]
    assert all(len(v) == 3 for v in told.values()) and told[4][1][1] == pytest.approx(np.sqrt(2) * 1e200)
    assert nn_descent.neighbours(vectors_frame(spark, [], np.zeros((0, 2))), F.lit(True)).count() == 0
