import hashlib

from stayrate.llm.exact_dedup import ContentTable, exact_dedup, grace_groups


def _records(contents):
    for i, content in enumerate(contents):
        number = int.from_bytes(hashlib.sha256(content).digest()[:8], "big")
        yield number, content, [i], (i, i), 1


def test_spilling_gives_the_same_groups():
    contents = [b"x%d" % (i % 700) * 20 for i in range(3000)]
    whole = sorted(map(repr, grace_groups(_records(contents), 1 << 30)))
    spilled = sorted(map(repr, grace_groups(_records(contents), 5_000)))
    assert len(whole) == 700
    assert [eval(r)[2] for r in whole] == [eval(r)[2] for r in spilled]
    assert {r[1] for r in map(eval, whole)} == {r[1] for r in map(eval, spilled)}


def test_equal_hashes_do_not_merge_contents():
    table = ContentTable()
    assert [table.place(5, b"a"), table.place(5, b"b"), table.place(5, b"a")] == [
        (0, True),
        (1, True),
        (0, False),
    ]
    groups = list(grace_groups(iter([(5, b"a", [0], (1, 0), 1), (5, b"b", [1], (2, 1), 1)] * 2), 1))
    assert sorted(g[2] for g in groups) == [2, 2]


def test_odd_rows(documents):
    long = "Wörd " * 50_000
    rows = [(1, "AÄb"), (2, "aÄB"), (3, "aäb"), (4, None), (5, ""), (None, "")]
    rows += [(7, long), (7, long), (8, long.upper().replace("Ö", "ö")), (None, "only")]
    found = [r.asDict() for r in exact_dedup(documents(rows), memory=1000).collect()]
    assert len(found) == len(rows)
    fold = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(fold), []).append(doc_id)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for row in found:
        ids = by_hash[row["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert row["group_size"] == len(ids)
        assert row["keep_id"] == (max(known) if known else None)
    for digest in by_hash:
        assert sum(r["kept"] for r in found if r["text_sha256"] == digest) == 1


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0
