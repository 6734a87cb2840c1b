import base64
import hashlib
import random

import public_tokenizers as P
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import byte_bpe, token_counts
from tests.llm.fixtures import documents, rows

CODEC = byte_bpe.codec(P.path(byte_bpe.RANKS), P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTER = token_counts.counter(P.path(token_counts.MODEL))
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
TEXT = st.text(max_size=60) | st.text(alphabet=" ab\n\té▁😀\x1c\xa0Σ1'sx", max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert "".join(CODEC.decode(ids, block=3)) == text


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_are_the_librarys(text):
    assert COUNTER.count(text) == len(PIECES.encode(text))


def test_long_runs():
    for text in ("a" * 30000, " " * 5000 + "x", "-=" * 4000, "\n" * 999):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)
        assert COUNTER.count(text) == len(PIECES.encode(text))


def test_neighbours_agree_as_merges_do():
    pick, fst = random.Random(5), CODEC.fst
    for _ in range(4000):
        a, b = pick.randrange(3000), pick.randrange(50256)
        assert fst.agree(a, b) == (fst.merge(fst.bytes_of[a] + fst.bytes_of[b]) == [a, b])


def test_lookahead_is_bounded_and_states_restart(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 50)
    fst = byte_bpe.Transducer(RANKS)
    for _, text, *_ in rows()[:20]:
        for piece in CODEC.split(text):
            assert fst.encode(piece.encode()) == LIBRARY.encode_ordinary(piece)
    assert len(fst.states) <= 60


def test_documents(spark):
    docs = documents(spark)
    got = sorted((r.asDict().values() for r in byte_bpe.round_trip_digests(docs).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows():
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [tuple(x) for x in got] == [tuple(x) for x in sorted(want, key=lambda w: str(dict(zip("abcd", w)).values()))]
    back = {(r.doc_id, r.text) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows()}
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()}
    assert counts == {(i, len((t or "").encode()), n := len(PIECES.encode(t or "")), n > 4096) for i, t, *_ in rows()}


def test_empty_table(spark):
    none = documents(spark, [])
    assert byte_bpe.round_trip_digests(none).count() == token_counts.token_counts(none).count() == 0
