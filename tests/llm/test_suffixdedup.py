import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import suffixdedup as D
from millrace.llm.q_suffixdedup import op9_suffixdedup


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text, by counting all strings."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(2, 9))
def test_transform_equals_counting(pieces, length):
    count = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    want = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in pieces]
    assert [s.tolist() for s in D.repeated(pieces, length)] == want


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "née", "日本", "of", "and", f"w{r.randrange(900)}"])
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(80) for _ in range(4)]
    docs = [text(r.randint(0, 150)) for _ in range(40)]
    docs += [text(r.randint(0, 60)) + r.choice(shared)[r.randint(0, 60) :] + text(r.randint(0, 60)) for _ in range(40)]
    docs += ["ab" * 400, "x" * 1000, "x" * 150, docs[3], docs[3], None, "", shared[0] + " | " + shared[0]]
    return docs


@pytest.mark.parametrize(("hot", "shard_bytes", "limit"), [(4000, 3 << 20, 2_000_000), (3, 2000, 0)])
def test_equals_brute_force(spark, monkeypatch, hot, shard_bytes, limit):
    monkeypatch.setattr(D, "BROADCAST_GROUPS", limit)
    texts = corpus(hot)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "short", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in D.remove_repeats(df, hot=hot, shard_bytes=shard_bytes).collect()}
    want = dict(enumerate(brute(texts, 200))) | {None: (5, 0, 0, b"short")}
    assert got == want
    assert D.remove_repeats(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: (a, b, c, hashlib.sha256(k).hexdigest()) for d, (a, b, c, k) in zip(docs, brute([d.text for d in docs], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffixdedup(spark, sf).collect()}
    assert got == want


def test_copies_alone_in_their_group_need_no_transform(monkeypatch):
    taken = []
    plain = D.repeated
    monkeypatch.setattr(D, "repeated", lambda pieces, length: taken.append(pieces) or plain(pieces, length))
    pieces = [b"abcdef", b"xabcdy", b"lonely", b"copied", b"ababab"]
    got = D.solved_pieces(np.array([1, 1, 2, 3, 4]), pieces, np.array([2, 1, 1, 5, 1]), 4)
    assert got == [[(0, 2)], [(1, 1)], [], [(0, 2)], [(0, 0), (2, 2)]]
    assert taken == [[b"abcdef", b"xabcdy", b"lonely", b"ababab"]]
    assert D.solved_pieces(np.array([3]), [b"copied"], np.array([2]), 4) == [[(0, 2)]] and len(taken) == 1
