"""Clashing column names, repeated ids and ties; the pipeline against a plain version of its five stages."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_spark.llm import hidden_markov, minhash_join, mixing, pairwise_quality, piece_suffixes, secret_links, syncmers
from corpus_spark.llm import phrases, wavelet_infill, zstd_language
from corpus_spark.llm.held_out import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = (
    "hash", "passes", "below", "plan_source", "_time", "lang_pred", "lang_score", "lang_rejected", "_lang", "_spans", "_key", "_id",
    "_digest", "spans", "digest", "row", "may", "id", "key", "size", "name", "answer", "chunk", "kept", "quality_score", "range", "tail", "col",
)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PARTS = {"aa": ["tion", "ing", "the", "er"], "bb": ["ung", "keit", "sch", "der"]}


def text(r: random.Random, lang: str, words: int = 60) -> str:
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(words))


def corpus() -> list[tuple]:
    r = random.Random(21)
    data = [(i, text(r, lang), lang, (f"s{i % 3}", None)[i % 7 == 0], 0) for i, lang in enumerate(sorted(PARTS) * 25)]
    near = data[8][1].split()
    near[30] = "other"
    data += [
        (60, " ".join(near), None, "s1", 0),
        (61, data[9][1], "bb", "s2", 0),
        (62, data[9][1], "bb", "s2", 0),
        (62, text(r, "aa"), "aa", "s2", 0),  # an id with two texts, one of them a copy
        (62, data[9][1], "bb", "s2", 0),  # a row that repeats
        (63, text(r, "aa") + " password=abcdefabcdef1234 end", "aa", "s0", 0),
        (64, None, None, None, 0),
        (65, "", "aa", "s0", 0),
        (66, "12 34", "aa", "s0", 0),
        (None, text(r, "bb"), "bb", "s1", 0),
        (None, data[11][1], "bb", "s1", 0),
    ]
    return [(i, t, lang, s, len(t) if t else 0) for i, t, lang, s, _ in data]


def wide(frame):
    """`frame` with a column of every name that an operator might use inside."""
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def bag(frame) -> Counter:
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("stage", ["language_id", "minhash_near_dedup", "secret_scan", "source_mix"])
def test_stages_with_clashing_names(spark, stage):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame(corpus(), SCHEMA)
    run = dict(pipeline.STAGES)[stage]
    got = run(spark, wide(docs), "")
    assert got.columns == wide(docs).columns
    assert bag(got.select(*docs.columns)) == bag(run(spark, docs, ""))
    assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHES)


OPERATORS = {
    "op2": lambda d: zstd_language.identify(d, zstd_language.learn(d)).select("doc_id", "lang_pred", "lang_score"),
    "op3": lambda d: syncmers.fingerprints(d).select("doc_id", "fingerprint", "near_next"),
    "op4": lambda d: minhash_join.near_duplicates(d),
    "op5": lambda d: hidden_markov.score(d, held_out("doc_id", 5, 1)).select("doc_id", "n_tokens", "n_known", "train_tokens"),
    "op6": lambda d: mixing.mix(d),
    "op7": lambda d: secret_links.digest(secret_links.scan(d)),
    "op8": lambda d: piece_suffixes.encode(d, piece_suffixes.Pieces.load()).select("doc_id", "n_tokens", "round_trip"),
    "op9": lambda d: pairwise_quality.score(d, pairwise_quality.learn(d, d.select("doc_id", F.lit(1).alias("quality")))).select(
        "doc_id", "quality_predicted"
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_with_clashing_names(spark, name):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert bag(OPERATORS[name](wide(docs))) == bag(OPERATORS[name](docs))


def test_a_boundary_document_is_taken_where_the_sum_ends_nearer(spark):
    data = [(0, "w " * 7, None, "a", 0), (1, "w " * 1000, None, "b", 0), *[(2 + i, " ", None, "a", 0) for i in range(20)]]
    docs = spark.createDataFrame(data, SCHEMA)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert got[0]["target"] == 14 and got[0]["taken"] == 14
    assert got[1]["target"] == pytest.approx(1496.5) and got[1]["taken"] == 1000  # 496.5 away, and 503.5 if taken twice
    data[1] = (1, "w " * 100, None, "b", 0)
    data += [(30 + i, "w " * 10, None, "c", 0) for i in range(40)]
    docs = spark.createDataFrame(data, SCHEMA)
    by_source: dict = {}
    for r, s in ((r, dict((d[0], d[3]) for d in data)[r["doc_id"]]) for r in mixing.mix(docs).collect()):
        by_source.setdefault(s, [r["target"], 0])[1] += r["taken"]
    assert abs(by_source["c"][1] - by_source["c"][0]) <= 5  # half a document
    # Documents without words come MOST times at most.
    assert max(Counter(r["doc_id"] for r in mixing.mixed(docs).collect()).values()) <= 2


def plain_near_dedup(docs: list[tuple]) -> list[tuple]:
    def shingles(t):
        words = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rows = sorted(dict.fromkeys(docs), key=lambda d: (d[0] is None, d[0] or 0))
    sets, group = [shingles(d[1]) for d in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = sorted((group[i], group[j]))[::-1]
                group = [new if g == old else g for g in group]
    return [d for i, d in enumerate(rows) if i == group[i]]


def plain_mix(docs: list[tuple]) -> list[tuple]:
    import hashlib

    by: dict = {}
    for d in docs:
        by.setdefault(d[3], []).append((int(hashlib.md5(str("null" if d[0] is None else d[0]).encode()).hexdigest()[:13], 16), d))
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {s: sum(size(d[1]) for _, d in rows) for s, rows in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    out = []
    for s, rows in by.items():
        passes, left = (2, 0) if s in full else divmod(level * weight[s], sizes[s])
        out += [d for _, d in rows] * int(passes)
        through, open_ = 0, s not in full
        for h in sorted({h for h, _ in rows}):
            same = [d for g, d in rows if g == h]
            held = sum(size(d[1]) for d in same)
            if open_ and through + held > left:
                open_ = False
                if held < 2 * (left - through):
                    out += same
            elif open_:
                out += same
            through += held
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline as pipeline

    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], tuple(r["token_ids"] or ())) for r in pipeline.run(spark, str(tmp_path)).collect())
    model = zstd_language.learn(spark.createDataFrame(docs, SCHEMA))
    kept = []
    for i, t, lang, source, n in docs:
        pred, _, rejected = model.predict(t)
        if not rejected:
            kept.append((i, t, lang or pred, source, n))
    assert {64, 65, 66}.isdisjoint({d[0] for d in kept}) and len(kept) == len(docs) - 3
    one = plain_near_dedup(kept)
    assert [d[0] for d in one if d[0] is None or d[0] >= 60] == [62, 63, None]
    clean = [(i, re.sub(r"password=[A-Za-z0-9]{12,}", "[assign]", t), lang, source, n) for i, t, lang, source, n in one]
    pieces = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert got == Counter((d[0], tuple(pieces.encode(d[1]))) for d in plain_mix(clean))
