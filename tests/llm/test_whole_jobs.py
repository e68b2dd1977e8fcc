"""Cases in which an operator once did less than the whole job."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from centavo.llm import chat_views, chosen_path, hmm_lm, mil_quality, packing, pq_dedup


def test_links_of_a_hot_third_over_many_lists(spark, monkeypatch):
    """A noisy group of a third of the rows over more than 200 lists, against brute force."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=64)
    x = np.concatenate([base + s * rng.normal(size=(500, 64)) for s in (0.2, 0.3)] + [rng.normal(size=(2000, 64))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= pq_dedup.LINK
    np.fill_diagonal(links, False)
    fit, lists = pq_dedup.fit, []

    def many(vectors, n):
        model = fit(vectors, 220**2)
        lists.append(len(model["coarse"]))
        return model

    monkeypatch.setattr(pq_dedup, "fit", many)
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert lists[0] > 200 and links.sum() > 300_000
    assert [got[i] for i in range(len(x))] == links.sum(axis=1).tolist()


def test_packing_encodes_added_tokens(spark, tmp_path):
    """The query and the pipeline's stage give the ids of a default Tokenizer."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n\n<|endoftext|><|endoftext|>  y z", "<|endoftext|", "it's\t<|endoftext|>'s 12", "Été  ", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert ids[0] == [64, 220, 50256, 275, 1]
    for packed in (packing.query(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path))):
        got = {r["doc_id"]: (r["ids_crc32"], r["doc_tokens"]) for r in packed.collect()}
        assert got == {i: (zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for i, x in enumerate(ids)}


def test_pairs_just_over_the_bound_in_a_large_group(spark):
    """Near misses of one text, each with one partner just over 80 %: no such link may be lost in the levels."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(250):
        mine = list(base)
        for at in rng.choice(400, 48, replace=False):
            mine[at] = f"x{i}-{at}"
        other = list(mine)
        for at in rng.choice(400, 43, replace=False):
            other[at] = f"y{i}-{at}"
        rows += [(2 * i, " ".join(mine)), (2 * i + 1, " ".join(other))]
    sets = [set(t.split()) for _, t in rows]
    share = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    assert all(0.8 <= share[2 * i][2 * i + 1] < 0.81 for i in range(250))
    assert sum(x >= 0.8 for line in share for x in line) == 1000  # a text with itself and with its partner
    got = {r["id"]: r["component"] for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert got == {i: i // 2 * 2 for i in range(500)}


def test_many_texts_of_one_labelled_id(spark, monkeypatch):
    """The classifier's sample is bounded by rows: thousands of rows of a labelled id, equal and different, do not reach the driver."""
    seen, train = [], mil_quality.train
    monkeypatch.setattr(mil_quality, "train", lambda bags, labels: seen.append(len(bags)) or train(bags, labels))
    hot = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(hot, f"text number {i % 700} of many") for i in range(3000)] + [(i, f"plain words {i}") for i in range(60) if i != hot]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert mil_quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, 50) is not None
    assert seen == [50]


def test_pieces_of_long_texts(spark, monkeypatch):
    """The first fit draws from pieces that together are the texts; no piece is longer than the bound, whatever characters it holds."""
    monkeypatch.setattr(hmm_lm, "PIECE_CHARS", 7)
    texts = ["aé 𝄞\n b" * 9, "", None, "x" * 14, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm_lm.score(docs, modulus=2, remainder=5).collect()}
    assert [got[i]["n_tokens"] for i in range(5)] == [len((t or "").split()) + 1 for t in texts]
    pieces = hmm_lm.pieces(docs).orderBy("doc_id", "i").collect()
    assert ["".join(p["text"] or "" for p in pieces if p["doc_id"] == i) for i in range(5)] == [t or "" for t in texts]
    assert max(len(p["text"] or "") for p in pieces) == 7 and [sum(p["doc_id"] == i for p in pieces) for i in range(5)] == [9, 1, 1, 2, 1]


def test_a_dialogue_of_repeated_numbers_and_one_without_an_id(spark):
    """A third of all turns in one conversation without an id, of which many share a number or have none."""
    turns = [(None, None if i % 5 == 0 else i // 3, ("user", "helper", "system", None)[i % 4], f"t{i}") for i in range(300)]
    turns += [(c, i, ("user", "helper")[i % 2], f"c{c}-{i}") for c in range(60) for i in range(10)]
    seen = chat_views.perspectives(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    for conv in (None, 0, 59):
        mine = sorted(((-1 if t is None else t, r or "unknown", x) for c, t, r, x in turns if c == conv))
        for who in {r for _, r, _ in mine} - {"system"}:
            label = lambda r, who=who: "assistant" if r == who else "system" if r == "system" else f"user name={r}"
            want = "".join(f"<|im_start|>{label(r)}\n{x}<|im_end|>\n" for _, r, x in mine)
            parts = sorted((p for p in seen if p["conv_id"] == conv and p["perspective"] == who), key=lambda p: p["part"])
            assert "".join(p["rendered"] for p in parts) == want and all(p["n_turns"] <= chat_views.PART for p in parts)
            assert [want[p["char_offset"] + m["begin"] : p["char_offset"] + m["end"]] for p in parts for m in p["masks"]] == [x for _, r, x in mine if r == who]


def test_indexed_blocks_are_copied_for_those_that_ask(spark, monkeypatch):
    """Clusters far apart in small blocks: most pairs of blocks are never formed, and the links stay those of brute force."""
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    x = np.concatenate([c + 0.045 * rng.normal(size=(40, 48)) for c in centres])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= pq_dedup.LINK
    np.fill_diagonal(links, False)
    monkeypatch.setattr(pq_dedup, "SEARCH_ROWS", 32)
    kept = {}
    stage = pq_dedup.stage
    monkeypatch.setattr(pq_dedup, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(len(x))] == links.sum(axis=1).tolist() and 5_000 < links.sum() < 75_000
    pairs = kept["asks"].select("block", "from").distinct().count()
    blocks = kept["asks"].select("block").distinct().count()
    assert blocks > 20 and pairs < blocks * (blocks / pq_dedup.QUERY_BLOCKS + 1) / 4


def test_training_takes_every_document(spark, monkeypatch):
    """All rounds see all training documents, also those beyond what a first fit on some of them would draw."""
    seen, gather = [], hmm_lm.gather

    def counted(coded, size, work):
        found = gather(coded, size, work)
        seen.append((round(float(found[0].sum())), round(float(found[2].sum()))))
        return found

    monkeypatch.setattr(hmm_lm, "gather", counted)
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else f"a word{i % 7} b" * (i % 3)) for i in range(1500)], "doc_id long, text string").repartition(3)
    got = hmm_lm.score(docs).collect()
    learned = [r for r in got if not r["held_out"]]
    assert len(learned) > 1000 and learned[0]["train_tokens"] == sum(r["n_tokens"] for r in learned)
    assert seen == [(learned[0]["train_tokens"], len(learned))] * (hmm_lm.START_ROUNDS + hmm_lm.FULL_ROUNDS)


def test_a_document_of_one_state_is_the_mixtures_posterior():
    rng = np.random.default_rng(5)
    model = {"emit": rng.dirichlet(np.ones(4), 2).T, "move": np.eye(2), "begin": np.array([0.5, 0.5])}
    texts, symbols = ["a b a", "b", None, "a z"], {b"a": 0, b"b": 1, hmm_lm.END: 2}
    counts, begins = np.zeros((4, 2)), np.zeros(2)
    for t in texts:
        ids, rare = hmm_lm.encode(t, symbols)
        assert rare == ([b"z"] if t == "a z" else [])
        share = model["emit"][ids].prod(axis=0)
        share /= share.sum()
        begins += share
        for i in ids:
            counts[i] += share
    got = hmm_lm.belong(model, hmm_lm.Sequences(texts, symbols))
    assert np.allclose(got[0], counts) and np.allclose(got[2], begins) and not got[1].any()


def test_blocks_of_leaders_meet_without_being_shuffled(spark, monkeypatch):
    """Tasks read the blocks that meet; before, leaders and blocks were copied into a shuffle for every meeting, with the square of their number."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    x[100:120] = x[:20] * 2
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= pq_dedup.LINK).sum(axis=1) - 1
    monkeypatch.setattr(pq_dedup, "SEARCH_ROWS", 16)
    plans, stage = {}, pq_dedup.stage
    monkeypatch.setattr(pq_dedup, "stage", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and stage(df, name))
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert got == dict(enumerate(want.tolist()))
    assert "CoGroup" not in plans["found"] and "Join" not in plans["found"]
