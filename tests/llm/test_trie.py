import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from stayrate.llm import trie
from stayrate.llm.trie import conversation_trie

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        # Columns that clash with names used inside or returned.
        T.StructField("c", T.StringType()),
        T.StructField("depth", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("n_convs", T.StringType()),
    ]
)
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]


def _brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = own.get(leader, [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in kids)
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(full[c]) == len(node))
        out.append(
            (
                min(held),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(held),
                len(children.get(node, [])),
                leaves[node],
                saved[node],
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def _found(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "d", "e") for r in rows], TURNS).repartition(6)
    found = conversation_trie(df)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


def _corpus(draw, convs, words=4, most=14):
    rows = []
    for c in draw.sample(range(-20, 4 * convs), convs):
        for turn in range(draw.randrange(1, most)):
            rows.append((c, turn, draw.choice(["user", "bot"]), f"é{draw.randrange(words)}" * 3))
    draw.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = _corpus(random.Random(1), 120)
    rows += _corpus(random.Random(2), 60, words=1)
    assert _found(spark, rows) == _brute(rows)


def test_groups_of_copies_and_long_conversations(spark):
    rows = [(c * 5, t, "user", "same") for c in range(60) for t in range(6)]
    rows += [(1000 + 5 * c, t, "bot", f"{t % 7}") for c in range(3) for t in range(700)]
    rows += [(2000, t, "bot", f"x{t}") for t in range(3000)]
    rows += [(3000 + 5 * c, t, "u", "deep") for c in range(40) for t in range(c + 1)]
    assert _found(spark, rows) == _brute(rows)


def test_odd_turns(spark):
    rows = [(5, None, None, None), (5, 1, "", ""), (5, 1, "", ""), (5, 1, "a", "b"), (5, 1, "ab", "")]
    rows += [(None, 1, "a", "b"), (7, None, "a", "b"), (7, None, "a", None), (9, 3, None, "x")]
    rows += [(5, 1, "", "b"), (8, 1, "u", "long " * 100_000), (-3, 1, "u", "x"), (-5, 1, "u", "x")]
    assert _found(spark, rows) == _brute(rows)


def test_one_conversation_and_none(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(None, 1, "a", "b")]) == []
    for c in (0, 1, 2, 3, 10):
        rows = [(c, t, "a", f"{t}") for t in range(3)]
        assert _found(spark, rows) == _brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_find_close_and_leaf_pairs(seed, monkeypatch):
    monkeypatch.setattr(trie, "FANOUT", 4)
    monkeypatch.setattr(trie, "AT_ONCE", 7)
    draw = random.Random(seed)
    bits, depth = [], 0
    while len(bits) < 700 or depth:
        up = depth == 0 or (len(bits) < 700 and draw.random() < 0.55)
        bits.append(up)
        depth += 1 if up else -1
    stack, close = [], {}
    for at, up in enumerate(bits):
        if up:
            stack.append(at)
        else:
            close[stack.pop()] = at
    opening = np.array(sorted(close))
    found = trie.Parentheses(np.array(bits, bool))
    closing = found.find_close(opening)
    assert closing.tolist() == [close[o] for o in opening]
    pairs = [sum(bits[i] and not bits[i + 1] for i in range(o, close[o])) for o in opening]
    assert found.leaf_pairs(opening, closing).tolist() == pairs


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_shards_of_any_size_add_up(size):
    draw = random.Random(size)
    paths = {""}
    for _ in range(60):
        paths.add(draw.choice(sorted(paths)) + f"{draw.randrange(16):032x}")
    paths = sorted(paths)
    weights = [draw.randrange(50) for _ in paths]
    leaves, saved = {}, {}
    for p in paths:
        below = [q for q in paths if q.startswith(p)]
        leaves[p] = sum(not any(r != q and r.startswith(q) for r in paths) for q in below)
        saved[p] = sum(w for q, w in zip(paths, weights) if q.startswith(p))
    found = {}
    for at in range(0, len(paths), size):
        some = paths[at : at + size]
        more = any(q != some[-1] and q.startswith(some[-1]) for q in paths)
        names, n, s = trie.encode_shard(some, weights[at : at + size], more)
        above = [some[0][:k] for k in range(0, len(some[0]), 32)]
        assert names == [p[-32:] for p in [*above, *some]]
        for p, x, y in zip([*above, *some], n, s):
            one, two = found.get(p, (0, 0))
            found[p] = (one + int(x), two + int(y))
    assert found == {p: (leaves[p], saved[p]) for p in paths}
