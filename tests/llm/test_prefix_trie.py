"""The prefix trie against a trie built turn by turn."""

import hashlib
import random
import zlib

import pytest

from centavo.llm import prefix_trie
from centavo.llm.common import Stages

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    sign = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    told = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, sign(r)))] for c in {r[0] for r in rows if r[0] is not None}}
    nodes: dict = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = told.get(int(c / 100) * 100, [])[:h] + own[h:]  # the remainder has the sign of c
        for d in range(len(seq) + 1):
            at = nodes.setdefault(tuple(seq[:d]), {"members": [], "ends": [], "children": set()})
            at["members"].append(c)
            if d:
                nodes[tuple(seq[: d - 1])]["children"].add(tuple(seq[:d]))
        at["ends"].append(c)
    out = {}
    for k in sorted(nodes, key=len, reverse=True):
        n = nodes[k]
        n["leaves"] = sum(nodes[c]["leaves"] for c in n["children"]) or 1
        n["saved"] = (len(n["members"]) - 1) * (len(k[-1][1]) if k else 0) + sum(nodes[c]["saved"] for c in n["children"])
        out[(min(n["members"]), len(k))] = (min(nodes[k[:-1]]["members"]) if k else None, len(n["members"]), len(n["children"]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
    return out


def whole(turns, most):
    with Stages(turns.sparkSession) as held:
        nodes = prefix_trie.trie(*prefix_trie.grafted(*prefix_trie.places(turns, held), held), most).select(*COLUMNS).collect()
    return {(r[0], r[1]): tuple(r[2:]) for r in nodes}


def cases():
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice("ab")) for c in range(0, 260, 3) for t in range(draw.randrange(1, 7))]
    rows += [(400, t, "user", "é" * (t % 3)) for t in range(300)]  # one conversation holds a third of all rows
    rows += [(401 + i, t, "user", "é" * (t % 3)) for i in range(3) for t in range(40 + i)]
    rows += [(None, 1, "user", "nobody's"), (7, None, "user", "first"), (7, None, None, None), (7, 1, "user", ""), (8, 1, "", None), (8, 1, "", ""), (-5, 1, "user", "a"), (-100, 0, "user", "a")]
    rows += [(9, 2, "user", "same")] * 6 + [(11, 1, "x", "long " * 20_000)]
    rows += [(500 + i, 1, "user", "hot") for i in range(60)]
    return rows


@pytest.mark.parametrize("most", [40, prefix_trie.COMPONENT])
def test_nodes_of_rebuilt_conversations(spark, most, monkeypatch):
    """Also with components split in the cluster, blocks of few turns, extra columns with clashing names."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = cases()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, k1 int").repartition(3)
    assert whole(turns, most) == brute(rows)


def test_no_conversations(spark):
    assert whole(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), 10) == {}


def test_sums_in_components():
    """Random forests and a chain: sums over subtrees, by centroids alone."""
    draw = random.Random(5)
    for n in (1, 2, 3, 10, 60):
        for reach in (1, 3, n):
            up = [-1 if i == 0 or draw.random() < 0.1 else draw.randrange(max(0, i - reach), i) for i in range(n)]
            own = [draw.randrange(9) for _ in range(n)]
            want = list(own)
            for i in reversed(range(n)):
                if up[i] >= 0:
                    want[up[i]] += want[i]
            got = list(own)
            prefix_trie._sum_in_components(up, [got])
            assert got == want
