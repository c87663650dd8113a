import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import orderminhash as O
from millrace.llm.q_orderminhash import op6_orderminhash
from millrace.llm.tokens import pack, unpack, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_banded_distance(a, b, most):
    assert O.banded_distance(np.array(a, "<u8"), np.array(b, "<u8"), most) == min(distance(a, b), most + 1)


def test_words_are_those_of_the_pattern():
    texts = ["", None, "a", " A b\tc ", "x\x0by\x0cz  é É\n", "tail", "\n"]
    hashes, offsets = words(pa.array(texts))
    plain = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts]
    assert np.diff(offsets).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    again, _ = words(pa.array(["zz", *texts]).slice(1))
    assert again.tolist() == hashes.tolist()
    assert unpack(pack(np.sort(hashes))).tolist() == np.sort(hashes).tolist()


def test_order_and_occurrence_matter():
    base = [f"w{i}" for i in range(60)]
    swapped = base[30:] + base[:30]
    texts = pa.array([" ".join(x) for x in (base, base, swapped, base[:8] * 5, base[:8] * 9)])
    _, rows = O.sketch(*O.kmers(*words(texts)))
    same = lambda i, j: (rows[i] == rows[j]).mean()
    assert same(0, 1) == 1 and same(0, 2) < 0.85 and same(3, 4) < 0.9


def corpus():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    docs = [[word() for _ in range(r.randint(30, 120))] for _ in range(60)]
    line = [word() for _ in range(12)]
    docs += [line + [word() for _ in range(30)] for _ in range(20)]
    for i in range(40):
        d = list(docs[i % 12])
        for _ in range(max(1, len(d) // 20)):
            d[r.randrange(len(d))] = word()
        docs.append(d)
    docs += [docs[0], docs[70], ["a", "b"], ["a", "b"], [], []]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return [(i, " ".join(d)) for i, d in zip(ids, docs, strict=True)]


def brute(rows):
    seqs = {i: t.split() for i, t in rows}
    label = {i: i for i in seqs}
    ids = sorted(seqs)
    links = [(i, j) for i in ids for j in ids if i < j and O.similar(*(words(pa.array([" ".join(seqs[k])]))[0] for k in (i, j)))]
    for _ in ids:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize(("limit", "common"), [(C.BROADCAST_ROWS, 64), (0, 4), (0, 1)])
def test_equals_brute_force(spark, monkeypatch, limit, common):
    monkeypatch.setattr(O, "COMMON", common)
    monkeypatch.setattr(C.small, "__defaults__", (limit,))
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.kept) for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {i: (c, i == c) for i, c in brute(rows).items()}
    assert got == want


def edited(r, doc, edits, near=False):
    """doc with so many words replaced, at random or side by side around its middle."""
    d = list(doc)
    at = range((len(d) - edits) // 2, (len(d) + edits) // 2) if near else r.sample(range(len(d)), edits)
    for i in at:
        d[i] = f"new{r.randrange(10**9)}"
    return d


def test_pairs_near_the_threshold_are_found(spark):
    """As brute force: 200 words at 0.80 to 0.90, and 5 to 20 words with as many edits as 0.8 allows, in the middle or anywhere."""
    r = random.Random(11)
    docs = []
    for n, edits, near, copies in [(200, e, False, 15) for e in (20, 30, 40)] + [(n, n // 5, near, 3) for n in range(5, 21) for near in (False, True)] + [(n, n // 5, False, 3) for n in (30, 38, 41, 45, 50)]:
        for _ in range(copies):
            base = [f"w{r.randrange(10**6)}" for _ in range(n)]
            docs += [base, edited(r, base, edits, near)]
    for n in range(5, 50):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        docs += [base, base[: n // 2] + base[n // 2 + n // 5 :]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {x.doc_id: x.class_id for x in O.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    missed = [len(docs[i]) for i in range(0, len(docs), 2) if got[i] != got[i + 1]]
    assert missed == []
    assert all(got[i] == i for i in range(0, len(docs), 2))


def test_alike_by_a_passage_that_many_longer_ones_hold(spark):
    """Two documents that are alike in the passage only, among 1200 that hold it beside other text, the least ones among them."""
    r = random.Random(12)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = fresh(90)
    docs = [fresh(30) + passage + fresh(30) for _ in range(1200)] + [passage + fresh(20) for _ in range(2)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {x.doc_id: x.class_id for x in O.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: min(i, 1200) for i in range(1202)}


def test_odd_rows(spark):
    rows = [(4, "a b c", 0), (4, "a b c", 0), (2, "a b c", 0), (7, None, 0), (8, None, 0), (9, "", 0), (3, "  ", 0), (None, "a b c", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, class_id int")
    got = {r.doc_id: (r.class_id, r.kept) for r in O.near_duplicates(df).collect()}
    assert got == {4: (2, False), 2: (2, True), 7: (7, True), 8: (8, True), 9: (9, True), 3: (3, True), None: (None, True)}
    assert O.near_duplicates(df.limit(0)).collect() == []


def test_query(spark):
    rows = op6_orderminhash(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    label = {r.doc_id: r.class_id for r in rows}
    assert label == brute(list(texts.items()))


def test_rows_of_a_large_bucket_do_not_grow_with_its_square(spark, monkeypatch):
    """A bucket's members go to SPREAD tasks each at most; of buckets with the same members one is read; members without a possible pair are read once."""
    monkeypatch.setattr(O, "COMMON", 1)
    labelled = spark.range(300).selectExpr("5L as key", "id", "id as label", "10L as n", "cast('' as binary) as bins", "array(5L) as keys")
    keys = O.open_buckets(labelled)
    assert [r.c for r in keys.collect()] == [O.SPREAD]
    assert O.in_blocks(labelled.join(keys, "key")).count() == 300 * O.SPREAD
    same = labelled.union(labelled.withColumn("key", F.lit(3))).union(labelled.filter("id < 299").withColumn("key", F.lit(1)))
    assert {r.key for r in O.open_buckets(same).collect()} == {1, 3}
    monkeypatch.setattr(O, "COMMON", 64)
    r = random.Random(13)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    docs = [passage + fresh(60) for _ in range(200)] + [passage + fresh(3) for _ in range(3)]
    read = []
    plain = O.candidates
    monkeypatch.setattr(O, "candidates", lambda rows, *more: read.append(rows.count()) or plain(rows, *more))
    got = {x.doc_id: x.class_id for x in O.near_duplicates(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")).collect()}
    assert got == {i: min(i, 200) for i in range(203)}
    assert read[0] > 1000 and max(read[1:]) < 20


def test_a_document_comes_once_to_a_group_of_buckets(spark, monkeypatch):
    """Documents that share dozens of buckets by a passage are read once for each least document of those; a pair that meets in several groups is told of once."""
    r = random.Random(14)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = fresh(120)
    docs = [fresh(30) + passage + fresh(30) for _ in range(200)] + [passage + fresh(20) for _ in range(2)]
    read, told = [], []
    plain = O.candidates

    def seen(rows, *more):
        read.append((rows.count(), rows.select("key", "id").distinct().count()))
        out = plain(rows, *more)
        told.append((out.count(), out.select("a", "b").distinct().count()))
        return out

    monkeypatch.setattr(O, "candidates", seen)
    monkeypatch.setattr(O, "ROUNDS", 0)
    got = {x.doc_id: x.class_id for x in O.near_duplicates(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")).collect()}
    assert got == {i: min(i, 200) for i in range(202)}
    assert read[0][0] == read[0][1] < 15 * len(docs)
    assert told[0][0] == told[0][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_within(a, b, most):
    assert O.within(np.array(a, "<u8"), np.array(b, "<u8"), most) == (distance(a, b) <= most)


def test_replaced_words_or_one_gap_need_no_alignment(monkeypatch):
    monkeypatch.setattr(O, "banded_distance", None)
    a = np.arange(100, dtype="<u8")
    b = a.copy()
    b[::6] += np.uint64(1000)
    assert O.within(a, b, 20) and O.within(np.delete(b, slice(40, 43)), a, 20) and not O.within(a, a[:79], 20)


def test_sketch_is_the_same_in_blocks_of_any_size(monkeypatch):
    """Also for documents without k-mers, with one, or with more than a block holds."""
    r = np.random.default_rng(2)
    n = np.array([0, 1, 2, 50, 0, 3, 400, 7, 0])
    bounds = np.concatenate([[0], np.cumsum(n)]).astype("<i8")
    codes = r.integers(0, 2**63, bounds[-1]).astype(np.uint64)
    has, whole = O.sketch(codes, bounds)
    assert has.tolist() == np.flatnonzero(n).tolist() and len(np.unique(whole[0])) == 1
    monkeypatch.setattr(O, "BLOCK", 16)
    assert O.sketch(codes, bounds)[1].tolist() == whole.tolist()
    for row, i in zip(whole, has, strict=True):
        assert O.sketch(codes[bounds[i] : bounds[i + 1]], np.array([0, n[i]]))[1].tolist() == [row.tolist()]
