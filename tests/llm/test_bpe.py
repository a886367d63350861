import hashlib
import pickle

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import bpe
from stayrate.llm.queries import public_codec

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return public_codec()


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding(
        "own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_perfect_hash_has_no_gap(codec):
    slots = sorted(map(codec.hash.slot, codec.keys))
    assert slots == list(range(len(codec.keys)))
    assert codec.rank(b"no such piece at all") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_pieces(codec, library):
    for text in ("ab" * 20_000, " " * 5_000, "thtionble" * 500, "é" * 3_000):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_documents(documents, codec, library):
    texts = [None, "", "a b", "a b", "It's  <|endoftext|>\n\n", "x" * 70_000, "Zürich 12.5%"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    docs = documents(rows)
    found = {(r.doc_id): r for r in bpe.round_trip(docs, codec, with_ids=True).collect()}
    encoded = bpe.encode(docs, codec)
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, codec).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        row = found[doc_id]
        assert row.n_tokens == len(ids) and row.ids == ids
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert decoded[doc_id] == (text or "").encode()
    assert bpe.round_trip(documents([]), codec).count() == 0


def test_tasks_of_a_worker_share_what_they_remember(codec, library, monkeypatch):
    """A later task of the same process looks up new pre-tokens only, also after the memory
    was full, and the ids stay those of the library."""
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    bpe._KEPT.clear()
    looked_up = []
    piece = bpe.Codec.piece
    monkeypatch.setattr(
        bpe.Codec, "piece", lambda own, found: looked_up.append(found) or piece(own, found)
    )

    def task(text):
        sent = pickle.loads(pickle.dumps(codec))
        batch = pa.RecordBatch.from_pydict({"id": [1], "text": [text.encode()]})
        (out,) = bpe._encoder(sent)(iter([batch]))
        assert out.column("ids")[0].as_py() == library.encode_ordinary(text)

    task(" ".join(f"blonde{i}x" for i in range(20)))
    first = len(looked_up)
    task(" ".join(f"blonde{i}x" for i in range(20)))
    assert first and len(looked_up) == first
    task(" ".join(f"qu{'z' * i}v" for i in range(200)))
    assert len(bpe._KEPT) == 1
    (kept,) = bpe._KEPT.values()
    assert len(kept) <= 50 and len(kept.older) <= 50
    bpe._KEPT.clear()
