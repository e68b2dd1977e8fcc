"""Operators on small fixtures: nulls, empty and long texts, ties and repeats, against brute force."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from centavo.llm import chat_views, chosen_path, hmm_lm, merge_replay, mil_quality, packing, pq_dedup, quality_rules, separator_scan, tokens, warc
from centavo.llm.common import new_path

SF = "/root/testdata/sf0.001"
RNG = random.Random(4)


def text(n):
    return " ".join(RNG.choice(["alpha", "Beta", "gamma,", "Été", "über", "12", "don't", "x"]) + str(RNG.randrange(40)) for _ in range(n))


LONG = text(9000)
TEXTS = [None, "", "   \n\t ", "one", "a b c", LONG, "the end\n" * 30, "<|endoftext|> 日本語 \x00 ok", text(60), *[text(120) for _ in range(6)]]
TEXTS += [TEXTS[-1], TEXTS[-1] + " more", TEXTS[-1].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, text(70), "extra"), (3, "one", "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in TEXTS]
    packed = packing.pack_documents(docs, with_ids=True)
    rows = packed.collect()
    for r in rows:
        if r["doc_id"] is not None:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    placed = collections.defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert all(len(r["ids"]) == packing.CAPACITY for r in packing.sequences(packed).collect())


def test_column_generation_is_near_the_bound():
    sizes, rng = np.arange(1, 257), np.random.default_rng(1)
    demand = rng.poisson(40, 256).astype(float)
    used = packing.solve(sizes, demand, 256)
    assert (sum(p * n for p, n in used) == demand).all() and all((p * sizes).sum() <= 256 for p, _ in used)
    assert sum(n for _, n in used) <= 1.02 * (sizes * demand).sum() / 256
    assert packing.solve(np.array([], int), np.array([]), 256) == []


def test_classifier_held_out(spark):
    from centavo.llm import queries

    found = {r["doc_id"]: r for r in queries.QUERIES["op2_quality_classifier"](spark, SF).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    held = [(found[d]["predicted"], q) for d, q in labels if found[d]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_classifier_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["__score"] for r in mil_quality.score(docs, mil_quality.fit(docs, labels)).collect()} == {0.5}


def test_chat_parts(spark):
    rows = [(1, t, ["ann", "bob", "system", None][t % 4], f"say {t}") for t in range(9)] + [(None, None, "ann", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["perspective"]): r for r in chat_views.perspectives(turns).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    parts = collections.defaultdict(str)
    for r in sorted(chat_views.perspectives(turns, part=2).collect(), key=lambda r: r["part"]):
        key = (r["conv_id"], r["perspective"])
        assert r["char_offset"] == len(parts[key])
        for m in r["masks"]:
            assert r["rendered"][m["begin"] - 10 : m["begin"]] == "assistant\n"
        parts[key] += r["rendered"]
    assert parts == {k: r["rendered"] for k, r in whole.items()}


def test_warc_round_trip(spark):
    body = "x" * 150
    rows = [(5, "http://a.example.com/p?q=1", body), (2, "http://b.example.com/", body), (9, None, body), (1, "http://[bad", "tiny"), (3, "http://a.example.com/\r\nX: y", "tiny"), (4, "", None), (6, "http://é.example/ü", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_path(spark, "warc-test")
    top = warc.write_index(warc.write_archives(pages, folder), folder, block_lines=2)
    out = {r["page_id"]: r for r in warc.read_back(warc.page_keys(pages), top, folder).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in out.items()} == {5: ("revisit", 2), 9: ("revisit", 2), **{k: ("response", None) for k in (1, 2, 3, 4, 6)}}
    assert out[6]["payload_bytes"] == 120 and out[4]["payload_bytes"] == 0 and out[5]["payload_digest"] == out[2]["payload_digest"]


def test_merge_replay(spark, docs):
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(tokens.MULTI_BPE), special_tokens={})
    encoded = merge_replay.encode(docs)
    for r in encoded.where("doc_id is not null").collect():
        assert r["ids"] == known.encode_ordinary(TEXTS[r["doc_id"]] or "")
    assert all(r["text"] == (TEXTS[r["doc_id"]] or "") for r in merge_replay.decode(encoded).where("doc_id is not null").collect())


def test_quality_rules_equal_sql(spark, docs):
    ours = {r["doc_id"]: tuple(r) for r in quality_rules.report(docs.where("doc_id is not null"), list(quality_rules.RULES)).collect()}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t.replace("\x00", "z") if t else t) for i, t in enumerate(TEXTS)])
    theirs = {r[0]: r for r in con.sql(quality_rules.ORACLE).fetchall()}
    assert ours == theirs
    reverse = quality_rules.cascade(docs, list(quality_rules.RULES)[::-1])
    assert reverse.where("__rejected_by is null").count() == quality_rules.keep_good(docs).count()


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_separator_scan(spark, docs, block):
    folder = new_path(spark, "tokens-test")
    order = separator_scan.write_token_files(docs, folder)
    out = separator_scan.scan(order, folder, block_tokens=block).join(order, ["file", "ordinal"]).collect()
    encode = tokens.encoding(tokens.BYTE_BPE).encode_ordinary
    assert len(out) == docs.count() and all(r["n_tokens"] == len(encode(TEXTS[r["doc_id"]] or "")) for r in out if r["doc_id"] is not None)


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [v for v in base] + [base[0] + 0.05 * rng.normal(size=16) for _ in range(40)] + [base[1] + s * rng.normal(size=16) for s in np.linspace(0.02, 0.6, 60)]
    x = np.array(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    data = [(i, v.tolist()) for i, v in enumerate(rows)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (None, rows[5].tolist())]
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()}
    label = np.arange(len(x))
    while True:
        now = np.array([min([label[i], *label[links[i]]]) for i in range(len(x))])
        if (now == label).all():
            break
        label = now
    assert [got[i]["n_links"] - (i == 5 or links[5, i]) for i in range(len(x))] == links.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (900, 901, 902, 903))


def test_hmm(spark, docs):
    out = {r["doc_id"]: r for r in hmm_lm.score(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), vocabulary=40).collect()}
    split = {i: [*(t or "").encode().lower().split(), b" "] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in split}
    counts = collections.Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in split.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0


def test_forward_is_the_likelihood():
    """The scaled recursion against a sum over all state paths."""
    rng = np.random.default_rng(0)
    model = {"emit": rng.dirichlet(np.ones(4), 2).T, "move": rng.dirichlet(np.ones(2), 2), "begin": np.array([0.4, 0.6])}
    seq = hmm_lm.Sequences(["a b a", "b", None], {b"a": 0, b"b": 1, hmm_lm.END: 2})
    logs, _, _ = hmm_lm.forward(model, seq)
    for got, ids in zip(logs, ([0, 1, 0, 2], [1, 2], [2]), strict=True):
        p = model["begin"] * model["emit"][ids[0]]
        for i in ids[1:]:
            p = (p @ model["move"]) * model["emit"][i]
        assert abs(got - math.log(p.sum())) < 1e-9


def test_near_duplicates_equal_brute_force(spark, docs):
    base = text(200).split()
    rows = [(100 + i, " ".join(w if RNG.random() > i / 2500 else "edit" for w in base)) for i in range(80)] + [(500 + i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[-1])]
    got = {r["id"]: r["component"] for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    assert {i: got[i] for i in sets} == label


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0
    assert chosen_path.near_duplicates(docs).count() == 0
    assert hmm_lm.score(docs).count() == 0
    assert quality_rules.keep_good(docs).count() == 0
    assert pq_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat_views.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
