"""Cube-method mixing by its balance, hard negatives against all pairs."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from centavo.llm import cube_mixing, shared_lists


def words(text):
    return len(re.findall(cube_mixing.WORD, text or ""))


def water_filled(size):
    """Targets by resharing the excess until none is above: {source: target}."""
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: cube_mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), cube_mixing.SHARE * sum(size.values()), set(order)
    while left > 1e-9 and free:
        add = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        left = 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] > 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                free.discard(s)
    return target


def corpus():
    draw = random.Random(2)
    rows = [(i, draw.choice(["a", "b", "é", "", None]), " ".join(["w"] * int(draw.lognormvariate(4, 1)))) for i in range(1500)]
    rows += [(2000, "hot", "five words are in here")] * 1500 + [(None, "b", "no id")] * 5
    rows += [(3000, "long", "x " * 300_000), (3001, "long", "y z\n\x0bq"), (3002, "a", None), (3003, "void", ""), (3003, "void", " \t\r\n"), (2000, "a", "five words are in here")]
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, source string, text string, size string, target int")
    return rows, docs, cube_mixing.mix(docs.repartition(5))


def test_sources_meet_their_targets(mixed):
    rows, _, out = mixed
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += words(t)
    target, taken = water_filled(size), collections.Counter()
    got = out.collect()
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((i, s, words(t)) for i, s, t in rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["copies"] >= math.floor(r["target"] / r["source_size"] if r["source_size"] else 0) * (r["size"] > 0)
    assert all(abs(taken[s] - target[s]) <= 6 for s in size if s not in ("long",)) and abs(taken["long"] - target["long"]) <= 300_000


def test_reruns_agree(spark, mixed):
    _, docs, out = mixed
    again = cube_mixing.mix(docs.orderBy(F.desc("text")).repartition(2))
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, out.collect()))


def test_mixture_repeats_documents(mixed):
    _, docs, out = mixed
    got = collections.Counter((r["doc_id"], r["source"]) for r in cube_mixing.mixture(docs, out).collect())
    want = collections.Counter()
    for r in out.collect():
        want[(r["doc_id"], r["source"])] += r["copies"]
    assert got == +want


def test_levels_of_blocks(spark, mixed, monkeypatch):
    """Small blocks: several levels before the landing."""
    rows, docs, _ = mixed
    monkeypatch.setattr(cube_mixing, "BLOCK", 60)
    off = collections.Counter()
    for r in cube_mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        off[r["source"]] = abs(r["taken"] - r["target"])
    assert all(x <= 6 for s, x in off.items() if s != "long")


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(1)
    size, means = np.sort(np.r_[rng.integers(1, 900, 400), [5] * 100]).astype(float), []
    for seed in range(300):
        p = np.full(500, 0.3)
        out = cube_mixing.fly(size, p, np.random.default_rng(seed))
        assert abs(out @ size - p @ size) < 1e-4 and abs(out.sum() - p.sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= cube_mixing.LARGEST + cube_mixing.LADDER + 2
        means.append(out)
    assert np.abs(np.mean(means, axis=0) - 0.3).max() < 0.12  # four deviations of a mean of 300


def test_no_documents(spark):
    assert cube_mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def all_pairs(rows):
    good = [(n, i, lab, np.floor(256 * np.array(x, float)).astype(np.int64)) for n, (i, x, lab) in enumerate(rows) if i is not None and lab is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for n, i, lab, q in good:
        if i % 100 == 0:
            score = [(-int(q @ r), j, m, own == lab) for m, j, own, r in good if m != n and len(r) == len(q)]
            for s, j, _, _ in sorted(x for x in score if x[3])[: shared_lists.POSITIVES]:
                fits = sorted(x for x in score if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s)[: shared_lists.NEGATIVES]
                out += [(i, j, k + 1, y[1], -s, -y[0]) for k, y in enumerate(fits)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rid", F.lit("x")).repartition(3)
    return sorted(tuple(r) for r in shared_lists.mine(df, F.col("id") % 100 == 0).collect())


@pytest.mark.parametrize("segment", [16, shared_lists.SEGMENT])
def test_negatives_of_every_anchor(spark, monkeypatch, segment):
    """Ties, repeated rows and ids, a hot vector, zero and odd vectors; many short segments, several clusters, blocks of few members."""
    for name, value in (("SEGMENT", segment), ("A_CLUSTER", 3), ("MEMBERS", 4), ("AT_ONCE", 3)):
        monkeypatch.setattr(shared_lists, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 6))
    rows = [(50 * i, (base[i % 4] + 0.4 * rng.normal(size=6)).tolist(), i % 3) for i in range(40)]
    rows += [(10_000 + i, base[1].tolist(), 1 + i % 2) for i in range(30)] + [rows[2], rows[3]]
    rows += [(100, [0.0] * 6, 0), (7, [0.0] * 6, 2), (8, None, 1), (9, [1.0, None], 1), (200, [float("nan")] * 6, 1), (300, [1.0] * 6, None), (None, [1.0] * 6, 1), (400, [], 1), (11, [], 0)]
    rows += [(500 + 50 * i, rng.normal(size=3).tolist(), i % 2) for i in range(12)] + [(1, [float("inf")] * 6, 1), (2, [1e30] * 6, 1)]
    want = all_pairs([r for r in rows if r[0] != 2])
    assert len(want) > 500 and mined(spark, rows) == want


def test_nothing_to_mine(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0, 2.0], 1)]) == [] and mined(spark, [(100, [1.0, 2.0], 1), (101, [-1.0, 0.0], 1), (102, [1.0, 0.0], 2)]) == []


def test_walks_end_before_the_list(spark, monkeypatch):
    """With clustered vectors the certificate stops a walk early, and the answer is still that of all pairs."""
    monkeypatch.setattr(shared_lists, "SEGMENT", 64)
    answers = shared_lists._answers
    rng = np.random.default_rng(4)
    base = 2.0 ** -np.arange(8)
    rows = [(10 * i, (base[i % 8] * (np.eye(8)[0] + 0.05 * rng.normal(size=8))).tolist(), i % 2) for i in range(600)]
    met = spark.sparkContext.accumulator(0)

    def counted(list_, members, width, wanted):
        met.add(len(list_) * len(members) * (wanted == "positives"))
        return answers(list_, members, width, wanted)

    monkeypatch.setattr(shared_lists, "_answers", counted)
    rows = [r for r in rows if r[0] % 100 or r[0] // 10 % 8 < 2]
    assert mined(spark, rows) == all_pairs(rows)
    anchors = sum(r[0] % 100 == 0 for r in rows)
    assert 0 < met.value < 0.6 * anchors * len(rows)
