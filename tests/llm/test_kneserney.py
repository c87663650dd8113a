import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import kneserney as KN
from millrace.llm import ngrams as N
from millrace.llm.q_kneserney import op4_kneserney

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return KN.train(*tables, train_docs=200)


class Plain:
    """One language's model in dictionaries, from the definitions."""

    def __init__(self, texts, order):
        self.order = order
        raw = [None] + [Counter() for _ in range(order)]
        for t in texts:
            for h, w in self.steps(t):
                for m in range(1, order + 1):
                    raw[m][(*h[order - m :], w)] += 1
        before = defaultdict(set)
        for m in range(2, order + 1):
            for g in raw[m]:
                before[g[1:]].add(g[0])
        self.c = [None] + [{g: raw[m][g] if m == order or g[0] is None else len(before[g]) for g in raw[m]} for m in range(1, order + 1)]
        self.d = [None] + [KN.kn_discounts([sum(x == r for x in c.values()) for r in (1, 2, 3, 4)]) for c in self.c[1:]]
        self.after = defaultdict(list)
        for m in range(1, order + 1):
            for g, c in self.c[m].items():
                self.after[m, g[:-1]].append(c)

    @staticmethod
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x.group().lower(), t or "")), ()]

    def steps(self, t):
        padded = [None] * (self.order - 1) + self.tokens(t)
        return [(tuple(padded[i : i + self.order - 1]), w) for i, w in enumerate(padded[self.order - 1 :])]

    def p(self, h, w):
        m = len(h) + 1
        low = self.p(h[1:], w) if h else 1 / (len(self.c[1]) + 1)
        after = self.after.get((m, h))
        if not after:
            return low
        c = self.c[m].get((*h, w), 0)
        freed = sum(self.d[m][min(x, 3) - 1] for x in after)
        return (c - (self.d[m][min(c, 3) - 1] if c else 0) + freed * low) / sum(after)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_equals_dictionaries(spark, monkeypatch, order):
    monkeypatch.setattr(N, "BLOCK_BYTES", 600)
    monkeypatch.setattr(N, "CHUNK_BYTES", 300)
    monkeypatch.setattr(N, "SHARD_TOKENS", 200)
    r = random.Random(9)
    text = lambda: " ".join(r.choice(["The", "of", "and", "to", f"w{r.randrange(40)}", "É"]) for _ in range(r.randint(0, 30)))
    rows = [(i, text(), r.choice(["en", "de", None]), 1) for i in range(150)] + [(400, None, "en", 1), (401, "the " * 2000, "de", 1), (402, "never seen", "en", 1), (403, "the of", "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, block int").repartition(3)
    labels = docs.filter("doc_id < 120").selectExpr("doc_id", "1 as quality", "0 as toxic")
    model = KN.train(docs, labels, order=order)
    ids = sorted(range(120), key=lambda i: __import__("hashlib").md5(str(i).encode()).hexdigest())
    by = {x[0]: x for x in rows}
    plain, held = {}, {}
    for lang in ("en", "de", None):
        drawn = [i for i in ids if by[i][2] == lang]
        plain[lang] = Plain([by[i][1] for k, i in enumerate(drawn, 1) if k % 5], order)
        held[lang] = [by[i][1] for k, i in enumerate(drawn, 1) if k % 5 == 0]
        words = [*[w for (w,) in plain[lang].c[1]], "unknown"]
        for m, h in list(plain[lang].after)[:: max(1, len(plain[lang].after) // 50)]:
            assert sum(plain[lang].p(h, w) for w in words) == pytest.approx(1, abs=1e-9)
    score = lambda lang, t: sum(math.log10(plain[lang].p(h, w)) for h, w in plain[lang].steps(t))
    got = {x.doc_id: x for x in KN.judge(docs, model).collect()}
    assert len(got) == len(rows) and got[403].log10_p is None and got[403].kept
    for i, t, lang, _ in rows[:-1]:
        n = len(Plain.tokens(t))
        assert got[i].n_tokens == n and got[i].log10_p == pytest.approx(score(lang, t), rel=1e-9)
        assert got[i].perplexity == pytest.approx(10 ** min(300, -score(lang, t) / n), rel=1e-8)
        ranked = sorted(-score(lang, x) / len(Plain.tokens(x)) for x in held[lang])
        limit = ranked[math.ceil(KN.QUANTILE * len(ranked)) - 1]
        assert got[i].threshold == pytest.approx(10**limit, rel=1e-8) and got[i].kept == (got[i].perplexity <= got[i].threshold)
    assert {x.doc_id for x in KN.accepted(docs, model).collect()} == {i for i, x in got.items() if x.kept}


def test_keeps_clean_and_rejects_junk(model, tables):
    got = KN.judge(tables[0], model).join(tables[1], "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.25


def test_odd_rows(spark, model):
    junk = " ".join(f"q{i}" for i in range(50_000))
    rows = [(1, None, "en", 5), (1, "", "en", 5), (2, "the of", None, 5), (None, "the and of", "en", 5), (3, junk, "en", 5), (4, "the", "xx", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int")
    got = KN.judge(df, model).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.lang): r for r in got}
    assert by[2, None].perplexity is None and by[2, None].kept and by[4, "xx"].kept
    assert by[1, "en"].n_tokens == 1 and not by[3, "en"].kept
    assert KN.accepted(df, model).columns == df.columns
    assert sorted(r.text or "" for r in KN.accepted(df, model).collect()) == ["", "", "the", "the and of", "the of"]
    assert KN.judge(df.limit(0), model).collect() == []
    nothing = KN.train(df.limit(0), df.selectExpr("doc_id", "1 as quality").limit(0))
    assert all(r.kept for r in KN.judge(df, nothing).collect())


def test_a_rare_language_keeps_its_filter(spark):
    """One language has 60 times the trusted documents of another; a third one has too few."""
    r = np.random.default_rng(4)
    text = lambda lang: " ".join(f"{lang}{i}" for i in r.integers(0, 30, 40))
    langs = ["aa"] * 1800 + ["bb"] * 30 + ["cc"] * 3
    docs = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(langs)] + [(9000, "zz " * 60, "bb"), (9001, "zz " * 60, "cc")], "doc_id bigint, text string, lang string")
    labels = docs.filter("doc_id < 9000").selectExpr("doc_id", "1 as quality")
    model = KN.train(docs, labels, train_docs=30)
    assert {KN.lang_key("aa"), KN.lang_key("bb")} == set(model.limits) and model.unjudged == {"cc": 3}
    kept = {x.doc_id: x.kept for x in KN.judge(docs, model).filter("lang <> 'aa'").collect()}
    assert not kept[9000] and kept[9001] and sum(kept[i] for i in range(1800, 1830)) >= 28


def test_all_trusted_documents_count(spark, monkeypatch):
    """Over 2000 trusted documents of a language: all of them train or set the threshold, through many blocks, shards and ranges of ranks."""
    for name, value in {"BLOCK_BYTES": 3000, "MODEL_TOKENS": 900, "RANKED": 200}.items():
        monkeypatch.setattr(KN, name, value)
    r = random.Random(5)
    rows = [(i, " ".join(f"w{min(int(r.expovariate(0.05)), 90)}" for _ in range(r.randint(1, 6))) + f" only{i // 2}", "en") for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = KN.train(docs, docs.selectExpr("doc_id", "1 as quality"))
    ids = sorted(range(2600), key=lambda i: __import__("hashlib").md5(str(i).encode()).hexdigest())
    plain = Plain([rows[i][1] for k, i in enumerate(ids, 1) if k % 5], 3)
    own = model.languages[KN.lang_key("en")]
    assert own.kinds == len(plain.c[1]) and own.total == sum(plain.c[1].values()) and own.discounts[1:] == plain.d[1:]
    score = lambda t: sum(math.log10(plain.p(h, w)) for h, w in plain.steps(t))
    ranked = sorted(-score(rows[i][1]) / len(Plain.tokens(rows[i][1])) for k, i in enumerate(ids, 1) if k % 5 == 0)
    assert model.limits[KN.lang_key("en")] == pytest.approx(ranked[math.ceil(KN.QUANTILE * len(ranked)) - 1], rel=1e-9)
    got = {x.doc_id: x.log10_p for x in KN.judge(docs, model).collect()}
    assert all(got[i] == pytest.approx(score(t), rel=1e-9) for i, t, _ in rows[::7])
    model.drop()


def test_query_is_repeatable(spark):
    first, second = (sorted(map(tuple, op4_kneserney(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert first == second and len(first) == 200


def test_blocks_make_only_what_is_read():
    """Keys that are only sent get no numbers, and longer ones don't need the shorter ones sorted; all is as by plain sorting."""
    r = np.random.default_rng(8)
    lengths, vocabulary = np.array([300, 3, 200]), np.sort(r.integers(0, 1 << 63, 50).astype(np.uint64))
    begins = np.cumsum(lengths) - lengths
    tokens = r.integers(1, 50, lengths.sum())
    tokens[begins] = 0
    row = {"lengths": KN.pack_ints(lengths), "marks": bytes(3), "vocabulary": KN.pack(vocabulary), "tokens": KN.pack_ints(tokens)}
    block = N.Block(row)
    grams = block.keys.of.__self__
    assert len(block.keys[3]) and set(grams._number) == {1} and set(grams._keys) == {1, 3}
    key, before = vocabulary[tokens], np.maximum(np.arange(len(tokens)) - 1, np.repeat(begins, lengths))
    for m in (2, 3):
        key = N.pair_keys(key[before], vocabulary[tokens])
        keys, number = np.unique(key, return_inverse=True)
        real = np.isin(np.arange(len(tokens)), begins, invert=True)
        for made in (N.Block(row), block):
            assert (made.counts(m) == np.bincount(number[real], minlength=len(keys))).all()
            assert (made.keys[m] == keys).all() and (made.number[m] == number).all() and (key[made.place[m]] == keys).all()


@pytest.mark.parametrize("keys", [[], [7], [7, 7, 7], [5, 4, 5, (1 << 64) - 1, 0, 4], [*range(1000, 0, -1), 1 << 63, (1 << 63) + 1, 1 << 63]])
def test_places_in_order_of_key(keys):
    """Also where the bits that places take tell keys apart."""
    keys = np.array(keys, np.uint64)
    order, held = N.in_order(keys)
    assert (order == np.argsort(keys, kind="stable")).all() and (held == np.sort(keys)).all()
