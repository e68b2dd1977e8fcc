"""Models against brute force, edge cases by operator, and the pipeline stage by stage."""

import itertools
import zlib

import corpus_pipeline
import numpy as np
import pytest
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

from centavo.llm import chat_views, chosen_path, hmm_lm, merge_replay, mil_quality, packing, pq_dedup, quality_rules, separator_scan, warc
from centavo.llm.common import new_path

WORDS = [f"{a}{b}" for a in ("stone", "river", "cloud", "paper", "green", "walks", "under", "light") for b in ("", "s", "ed", "er", "ing", "ly")]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


@pytest.fixture
def bags():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 2, 6, 3]
    x = rng.normal(size=(sum(sizes), 5))
    p = {"w": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(0.3)}
    return x, np.cumsum([0, *sizes])[:-1], p, {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 0.1}


def test_gated_attention_is_that_of_each_bag_alone(bags):
    x, starts, p, fixed = bags
    found = mil_quality.forward(p | fixed, x, starts)["score"]
    for i, part in enumerate(np.split(x, starts[1:])):
        h = np.tanh((part - fixed["mean"]) / fixed["scale"] @ p["w"] + p["b"])
        e = np.array([(np.tanh(r @ p["v"]) / (1 + np.exp(-(r @ p["u"])))) @ p["a"] for r in h])
        weights = np.exp(e) / np.exp(e).sum()
        assert abs(found[i] - 1 / (1 + np.exp(-(weights @ h @ p["c"] + p["d"])))) < 1e-12


def test_gradients_are_those_of_the_loss(bags):
    x, starts, p, fixed = bags
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.array([0.2, 0.5, 0.1, 0.4, 0.3])

    def loss(q):
        s = mil_quality.forward(q | fixed, x, starts)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    grads = mil_quality.gradients(p, fixed, x, starts, y, weight)
    for name, value in p.items():
        for at in itertools.product(*map(range, value.shape)):
            step = np.zeros_like(value)
            step[at] = 1e-6
            slope = (loss(p | {name: value + step}) - loss(p | {name: value - step})) / 2e-6
            assert abs(slope - grads[name][at]) < 1e-7, (name, at)


def test_expected_counts_are_sums_over_paths():
    """Baum-Welch's expectation against every path of hidden states."""
    rng = np.random.default_rng(5)
    model = {"emit": rng.dirichlet(np.ones(4), 3).T, "move": rng.dirichlet(np.ones(3), 3), "begin": rng.dirichlet(np.ones(3))}
    seq = hmm_lm.Sequences(["a b a", "b", None, "b a z b"], {b"a": 0, b"b": 1, hmm_lm.END: 2})
    counts, moves, begins = np.zeros((4, 3)), np.zeros((3, 3)), np.zeros(3)
    for ids in ([0, 1, 0, 2], [1, 2], [2], [1, 0, 3, 1, 2]):
        paths = list(itertools.product(range(3), repeat=len(ids)))
        chance = np.array([model["begin"][s[0]] * np.prod([model["emit"][i, k] for i, k in zip(ids, s, strict=True)]) * np.prod([model["move"][a, b] for a, b in itertools.pairwise(s)]) for s in paths])
        for s, w in zip(paths, chance / chance.sum(), strict=True):
            begins[s[0]] += w
            for i, k in zip(ids, s, strict=True):
                counts[i, k] += w
            for a, b in itertools.pairwise(s):
                moves[a, b] += w
    for got, want in zip(hmm_lm.expect(model, seq), (counts, moves, begins), strict=True):
        assert np.allclose(got, want)


def test_training_raises_the_likelihood():
    texts = [prose(60, i) for i in range(20)]
    symbols = {w.encode(): i for i, w in enumerate(sorted({w for t in texts for w in t.split()}))} | {hmm_lm.END: 999}
    symbols = {w: i for i, w in enumerate(symbols)}
    seq = hmm_lm.Sequences(texts, symbols)
    totals = np.bincount(seq.flat, minlength=len(symbols) + 1).astype(float)
    model, before = hmm_lm.first_model(totals), -np.inf
    for _ in range(4):
        now = hmm_lm.forward(model, seq)[0].sum()
        assert now > before
        before, model = now, hmm_lm.maximise(*hmm_lm.expect(model, seq), totals)


def test_vectors_of_several_lengths(spark):
    """Each length by itself, with a group of near misses that balls do not settle, against all pairs."""
    rng = np.random.default_rng(9)
    wide = [rng.normal(size=24) for _ in range(40)]
    wide += [wide[0] + s * rng.normal(size=24) for s in np.linspace(0.25, 0.5, 400)]
    narrow = [rng.normal(size=3) for _ in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate(wide)] + [(1000 + i, v.tolist()) for i, v in enumerate(narrow)] + [(2000, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for first, group in ((0, wide), (1000, narrow)):
        x = np.array(group) / np.linalg.norm(group, axis=1)[:, None]
        links = x @ x.T >= 0.9
        np.fill_diagonal(links, False)
        assert [got[first + i]["n_links"] for i in range(len(x))] == links.sum(axis=1).tolist()
    assert got[2000]["n_links"] == 0 and got[2000]["component_id"] == 2000


def test_operators_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mil_quality.score(docs, mil_quality.fit(docs, labels)).count() == 0
    assert merge_replay.decode(merge_replay.encode(docs)).count() == 0
    folder = new_path(spark, "empty-tokens")
    assert separator_scan.scan(separator_scan.write_token_files(docs, folder), folder).count() == 0
    pages, folder = spark.createDataFrame([], "page_id long, url string, html string"), new_path(spark, "empty-warc")
    lines = warc.write_archives(pages, folder)
    assert warc.read_back(warc.page_keys(pages), warc.write_index(lines, folder), folder, warc.read_parts(lines)).count() == 0


def test_very_long_and_clashing(spark):
    """A text of 60,000 words, a dialogue turn and a page as long, and columns named like those that operators add."""
    long = " ".join(f"{w}{i}" for i, w in enumerate(prose(60_000, 1).split()))
    docs = spark.createDataFrame([(1, long, 7, 8, "x"), (2, None, 7, 8, "y")], "doc_id long, text string, __text int, __score int, __rejected_by string")
    scored = mil_quality.score(docs, None, "s").collect()
    assert [(r["doc_id"], r["__text"], r["__score"], r["s"]) for r in scored] == [(1, 7, 8, 0.5), (2, 7, 8, 0.5)]
    assert mil_quality.keep_good(docs, None).columns == docs.columns and mil_quality.keep_good(docs, None).count() == 2
    assert [r["doc_id"] for r in quality_rules.keep_good(docs).collect()] == [1] and quality_rules.keep_good(docs).columns == docs.columns
    turns = spark.createDataFrame([(1, 0, "ann", long), (1, 1, "bob", "yes")], "conv_id long, turn long, role string, text string")
    seen = {r["perspective"]: r for r in chat_views.perspectives(turns).collect()}
    assert seen["ann"]["rendered"][seen["ann"]["masks"][0]["begin"] : seen["ann"]["masks"][0]["end"]] == long
    folder = new_path(spark, "long-warc")
    pages = spark.createDataFrame([(2, "http://a/", long), (1, "http://a/", long), (1, "http://b/", long)], "page_id long, url string, html string")
    lines = warc.write_archives(pages, folder)
    back = warc.read_back(warc.page_keys(pages), warc.write_index(lines, folder), folder, warc.read_parts(lines)).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in back) == [(1, "response", len(long)), (1, "response", len(long)), (2, "revisit", len(long))]


def test_dialogue_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_views, "BLOCK", 2)
    turns = spark.createDataFrame([(c, t, ("ann", "bob")[t % 2], f"turn {t} " * (t % 3)) for c in (1, None) for t in range(41)], "conv_id long, turn long, role string, text string")
    for key in itertools.product((1, None), ("ann", "bob")):
        parts = sorted((r for r in chat_views.perspectives(turns, part=3).collect() if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["part"])
        at = 0
        for i, r in enumerate(parts):
            assert (r["part"], r["char_offset"]) == (i, at)
            at += len(r["rendered"])
        assert sum(r["n_turns"] for r in parts) == 41


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on what the one before kept, against brute force."""
    good = [(i, prose(80 + i, i)) for i in range(30)]
    words = good[3][1].split()
    near = (100, " ".join(words[:40] + ["changed"] + words[41:]))
    rows = [*good, near, (101, good[4][1]), (102, "too short"), (103, "the same line again\n" * 60), (104, None), (None, prose(90, 99))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shout = [(1000 + i, prose(70, i).upper() + " !!! BUY NOW") for i in range(12)]
    spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + shout], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, at = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "packing"]

    kept = stages["quality rules"](spark, docs, at)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if t and len(t.split()) >= 50 and i != 103}

    judged = stages["quality classifier"](spark, kept, at)
    model = mil_quality.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    scores = {r["doc_id"]: r["__score"] for r in mil_quality.score(kept, model).collect()}
    assert judged.columns == docs.columns and {r["doc_id"] for r in judged.collect()} == {i for i, s in scores.items() if s >= 0.5}

    single = stages["near duplicates"](spark, kept, at)
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [r["text"].lower().split()] for i in range(len(w) - 4)} for r in kept.collect()}
    gone = {b for a in sets for b in sets if a is not None and b is not None and a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert gone == {100, 101} and {r["doc_id"] for r in single.collect()} == set(sets) - gone and single.columns == docs.columns

    packed = stages["packing"](spark, single, at).collect()
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END_ID], "<u4") for r in single.collect()}
    assert sorted(ids, key=str) == sorted((r["doc_id"] for r in packed), key=str)
    assert all(zlib.crc32(ids[r["doc_id"]].tobytes()) == r["ids_crc32"] for r in packed)

    out = corpus_pipeline.run(spark, at).collect()
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in packed} and len(out) >= 25


def test_links_inside_a_group_that_shares_most_of_a_text(spark):
    """Pairs at .80 to .83 inside a group that shares a passage: only the whole sets tell."""
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(150)]
    rows, pairs = [], []
    for i in range(150):
        own = [f"p{i}-{j}" for j in range(250)]
        first = shared + own
        second = list(first)
        for at in rng.choice(np.arange(150, 400), 40, replace=False):
            second[at] = f"q{i}-{at}"
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(second))]
        pairs.append(len(set(first) & set(second)) / len(set(first) | set(second)))
    assert 0.8 <= min(pairs) and max(pairs) < 0.83
    got = {r["id"]: r["component"] for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)}
