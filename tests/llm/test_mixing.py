import hashlib
import random
import re

import duckdb
import pytest

from millrace.llm import mixing
from millrace.llm.q_mixing import SQL, op2_mixing


def water(sizes, weights, ratio, cap):
    """Targets as the contract tells them: share, stop at the cap, share what is over again."""
    left, open_, out = ratio * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        left = 0.0
        for i in list(open_):
            out[i] += share[i]
            if out[i] >= cap * sizes[i]:
                left += out[i] - cap * sizes[i]
                out[i] = cap * sizes[i]
                open_.discard(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 50, 1000, 9000]) * r.randint(1, 5) for _ in range(11)]
    names = [None, *sorted(f"s{i}" for i in range(10))]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size bigint")
    order = names[1:] + [None]
    by = dict(zip(names, sizes, strict=True))
    want = water([by[n] for n in order], [(3, 1, 2)[i % 3] for i in range(11)], 1.5, 2)
    got = {r.source: r.target for r in mixing.targets(df, [3, 1, 2], 1.5, 2.0).collect()}
    assert all(abs(got[n] - w) < 1e-6 * (1 + w) for n, w in zip(order, want, strict=True))


def test_taken_is_exact_and_repeats(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), r.choice(["a", "a", "a", "b", None]), 9) for i in range(300)]
    rows += [(None, None, "a", 1), (7, "x y", None, 1), (7, "x y", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    for target in {r.target for r in got}:
        same = [r for r in got if r.target == target]
        assert sum(r.taken for r in same) == round(target)
        assert all(0 <= r.taken <= 2 * r.size for r in same)
    drawn = mixing.drawn(mixing.mix(df, keep=["text"])).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in drawn) == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_edge_document_is_cut_after_its_words(spark):
    text = " a\tb\n" + "word " * 30_000
    df = spark.createDataFrame([(1, text, 30_002, 60_004, 1.0, 30_003 + 4)], "doc_id bigint, text string, size bigint, source_size bigint, target double, taken bigint")
    first, second = sorted((r.text for r in mixing.drawn(df).collect()), key=len, reverse=True)
    assert first == text and second == " a\tb\nword word word"


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    assert sorted(map(tuple, op2_mixing(spark, sf).collect())) == sorted(con.sql(SQL).fetchall())
    assert hashlib.md5(b"").hexdigest()  # the key's hash is MD5 in both engines


@pytest.mark.parametrize("part", [1, 2])
def test_ranges_of_many_levels(spark, monkeypatch, part):
    """However many digits ranges have, and however few a window sums, the mix is the same."""
    docs = spark.createDataFrame([(i, "w " * (i % 13), f"s{i % 3}" if i % 7 else None) for i in range(900)], "doc_id bigint, text string, source string")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    monkeypatch.setattr(mixing, "PART", part)
    assert sorted(map(str, mixing.mix(docs).collect())) == want
