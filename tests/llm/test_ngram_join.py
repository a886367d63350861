import random
import re

import numpy as np
import pytest

from stayrate.llm import ngram_join
from stayrate.llm.ngram_join import ngram_components


def _sets(rows, width):
    out = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(width, len(words))
        out.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    return out


def _brute(rows, width=4, percent=85):
    sets = _sets(rows, width)
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * union:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None), len(links[i])))
    return sorted(out, key=str)


def _found(documents, rows, **options):
    found = ngram_components(documents(rows).repartition(5), **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def _corpus(draw, groups=12, most=14):
    words = [f"w{i}" for i in range(400)]
    common = draw.choices(words, k=60)  # a passage that stands in many documents
    rows = []
    for g in range(groups):
        base = draw.choices(words, k=draw.choice([5, 30, 80, 200]))
        if g % 3 == 0:
            base = base + common
        for _ in range(draw.randrange(1, most)):
            text = list(base)
            for _ in range(draw.randrange(0, 1 + len(text) // 40)):
                text[draw.randrange(len(text))] = draw.choice(words)
            if draw.random() < 0.2:
                text = text[: len(text) - draw.randrange(len(text) // 8 + 1)]
            rows.append((len(rows) * 7 % 1000, " ".join(text).title() if g % 2 else "\t".join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    rows = _corpus(random.Random(seed))
    assert _found(documents, rows) == _brute(rows)


def test_blocks_of_any_size_give_the_same_rows(documents, monkeypatch):
    rows = _corpus(random.Random(3), groups=5, most=40)
    expected = _brute(rows)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    assert _found(documents, rows) == expected
    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", 150)
    assert _found(documents, rows) == expected


def test_other_widths_and_thresholds(documents):
    rows = _corpus(random.Random(4), groups=6)
    assert _found(documents, rows, width=2, percent=60) == _brute(rows, 2, 60)
    assert _found(documents, rows, width=5, percent=100) == _brute(rows, 5, 100)


def test_odd_documents(documents):
    long = " ".join(f"x{i % 5000}y{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "one")]
    rows += [(8, long), (9, long + " end"), (10, "Ä b c d e"), (11, "ä b c d e")]
    rows += [(None, "p q r s t u"), (13, "p q r s t u"), (13, "p q r s t u"), (None, None)]
    rows += [(None, "all alone in this world"), (14, "a a a a a a a"), (15, "a a a a")]
    assert _found(documents, rows) == _brute(rows)


def test_nothing(documents):
    assert _found(documents, []) == []
    assert _found(documents, [(1, None)]) == [(1, 0, 1, 0)]


def test_product_of_blocks(monkeypatch):
    monkeypatch.setattr(ngram_join, "STRIP", 7)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    draw = np.random.default_rng(8)
    base = draw.choice(500, 90, replace=False)
    sets = [np.unique(np.r_[base[draw.random(90) < 0.95], draw.integers(0, 500, 4)]) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    linked = 100 * shared >= 85 * (sizes[:, None] + sizes - shared)
    found = np.concatenate([f for _, f in ngram_join.product_links(sizes, sets, None, None, 85)])
    assert (found == np.triu(linked, 1)).all() and found.any() and not found.all()
    strips = ngram_join.product_links(sizes[:20], sets[:20], sizes[20:], sets[20:], 85)
    assert (np.concatenate([f for _, f in strips]) == linked[:20, 20:]).all()


def test_packed_counts_equal_plain_ones():
    draw = np.random.default_rng(9)
    wide = draw.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    columns, owners = wide[draw.integers(0, 3000, 9000)], draw.integers(1, 200, 9000)
    columns[:400], owners[:400] = wide[0], np.arange(1, 401) % 150 + 1  # a column of many
    plain = {}
    for c, o in zip(columns.tolist(), owners.tolist()):
        plain.setdefault(c, set()).add(o)
    expected = {}
    for own in plain.values():
        for o in own if len(own) > 1 else ():
            expected[o] = expected.get(o, 0) + 1
    bits, found, buckets = 4, {}, {}
    for part in np.array_split(np.arange(9000), 3):
        rows, credit = ngram_join.pack(columns[part], owners[part], bits)
        for o, n in zip(*credit):
            found[int(o)] = found.get(int(o), 0) + int(n)
        for bucket, some, own in rows:
            buckets.setdefault(bucket, []).append((some, own))
    for held in buckets.values():
        some = np.frombuffer(b"".join(s for s, _ in held), np.uint32)
        own = np.frombuffer(b"".join(o for _, o in held), np.int64)
        for o, n in zip(*ngram_join.shared(some, own)):
            found[int(o)] = found.get(int(o), 0) + int(n)
    # Never less; more only for columns that several chunks know to be shared.
    assert all(found.get(o, 0) >= n for o, n in expected.items())
    assert sum(found.values()) <= sum(expected.values()) + 3 * 400
