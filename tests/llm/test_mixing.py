import hashlib
import re

import pytest

from stayrate.llm import mixing, near_dedup
from stayrate.llm.mixing import mix_sources, mixed_documents


def _targets(sizes, share=1.5, most=2.0):
    """Round by round: full sources stop, their excess goes to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        total = sum(weights[s] for s in free)
        left = budget - sum(full.values())
        shares = {s: left * weights[s] / total for s in free} if free else {}
        over = [s for s in free if shares[s] >= most * sizes[s]]
        if not over:
            return full | shares
        full |= {s: most * sizes[s] for s in over}


def _corpus():
    rows = []
    for i in range(900):
        source = ("big", "b", "c", "d", None, "é")[0 if i % 3 == 0 else i % 6]
        rows.append((i, "w " * (1 + i * 7 % 40), source))
    rows += [(1000, None, "b"), (1001, "", "c"), (None, "x y", "d"), (1002, None, "none")]
    rows += [(1003, "a " * 30, "big")] * 3
    return rows


def test_targets_and_thresholds(documents):
    rows = _corpus()
    found = mix_sources(documents(rows)).collect()
    assert len(found) == len(rows)
    size = {}
    for doc_id, text, source in rows:
        size.setdefault(source, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    targets = _targets({s: sum(v) for s, v in size.items()})
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    taken = dict.fromkeys(size, 0)
    for doc_id, text, source in rows:
        row = by_id[doc_id][0]
        assert row.size == len((text or "").split())
        assert row.source_size == sum(size[source])
        assert row.target == pytest.approx(targets[source])
        assert row.taken <= 2 * row.size and (row.size == 0 or row.taken % row.size == 0)
        taken[source] += row.taken
    for source, sizes in size.items():
        assert abs(taken[source] - targets[source]) <= max(sizes) / 2 + 45


def test_threshold_is_the_nearest_hash_prefix(documents):
    rows = [(i, "w " * (1 + i * 13 % 50), "a" if i % 2 else "b") for i in range(300)]
    found = {r.doc_id: r for r in mix_sources(documents(rows)).collect()}
    for source in "ab":
        own = [r for r in rows if r[2] == source]
        digest = {d: hashlib.md5(f"{d}:{t}".encode()).hexdigest()[:15] for d, t, _ in own}
        order = sorted((found[d] for d, *_ in own), key=lambda r: digest[r.doc_id])
        need = order[0].target - (order[0].target // order[0].source_size) * order[0].source_size
        base, before = int(order[0].target // order[0].source_size), 0
        for r in order:
            again = need > 0 and before + r.size / 2 <= need
            assert r.taken == r.size * (base + again)
            before += r.size


def test_mixed_rows(documents):
    rows = _corpus()
    docs = documents(rows)
    wanted = {}
    for r in mix_sources(docs).collect():
        if r.taken:
            wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.taken // r.size
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == wanted


def test_nothing(documents):
    assert mix_sources(documents([])).count() == 0
    only = mix_sources(documents([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2


def test_mixed_documents_with_columns_that_clash(spark):
    names = ("below", "rounds", "p", "__copy", "row", "size", "hash", "from_source", "copy")
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, "a b c d" if i % 3 else None, "s" if i % 2 else None, *names) for i in range(30)]
    docs = spark.createDataFrame(rows, schema)
    plain = docs.select("doc_id", "text", "source")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    wanted = sorted(r.doc_id for r in mixing.mixed_documents(plain).collect())
    assert sorted(r.doc_id for r in mixed.collect()) == wanted and wanted
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_near_duplicates_with_columns_that_clash(spark):
    names = ("__id", "__k", "own", "hash", "row", "gone_id", "node", "kept")
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, *names), (2, text, *names), (3, None, *names)], schema)
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert near_dedup.without_near_duplicates(docs.where("false")).count() == 0
