import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import katz as K
from millrace.llm import ngrams as N
from millrace.llm.q_katz import op3_katz


class Plain:
    """The model in dictionaries."""

    def __init__(self, rows, order=3):
        self.order, self.count = order, [None] + [Counter() for _ in range(order)]
        for i, t in rows:
            if not self.held_out(i):
                for h, w in self.steps(t):
                    for m in range(1, order + 1):
                        self.count[m][(*h[order - m :], w)] += 1
        self.n = sum(self.count[1].values())
        of = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
        d = [None] + [K.discounts(of(c)) for c in self.count[1:]]
        self.cut = lambda m, c: d[m][c - 1] * c if c <= 5 else c
        kept = {w: self.cut(1, c) for (w,), c in self.count[1].items()}
        freed = (self.n - sum(kept.values())) or 0.5
        z = sum(kept.values()) + freed
        self.p1 = defaultdict(lambda: freed / z, {w: v / z for w, v in kept.items()})
        self.total = Counter()
        for m in range(2, order + 1):
            for g, c in self.count[m].items():
                self.total[g[:-1]] += c
        used, covered = Counter(), Counter()
        for m in range(2, order + 1):
            for g in self.count[m]:
                used[g[:-1]] += self.p(g[:-1], g[-1])
                covered[g[:-1]] += self.p(g[1:-1], g[-1])
        self.alpha = {h: (1 - used[h]) / (1 - covered[h]) for h in self.total}

    def steps(self, t):
        seq = self.tokens(t)
        padded = [None] * (self.order - 1) + seq
        return [(tuple(padded[i : i + self.order - 1]), w) for i, w in enumerate(seq)]

    @staticmethod
    def held_out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    @staticmethod
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), ()]

    def p(self, h, w):
        if not h:
            return self.p1[w]
        c = self.count[len(h) + 1].get((*h, w), 0)
        return self.cut(len(h) + 1, c) / (self.total[h] + K.HELD) if c else self.alpha.get(h, 1.0) * self.p(h[1:], w)

    def row(self, i, t):
        seq, one = self.tokens(t), self.count[1]
        base = sum(math.log10((one[w,] + 0.5) / (self.n + 0.5 * (len(one) + 1))) for w in seq)
        return i, self.held_out(i), len(seq), sum(one[w,] > 0 for w in seq), self.n, base, sum(math.log10(self.p(h, w)) for h, w in self.steps(t))


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_equals_dictionaries_in_many_blocks_and_shards(spark, monkeypatch, order):
    monkeypatch.setattr(N, "BLOCK_BYTES", 500)
    monkeypatch.setattr(N, "CHUNK_BYTES", 300)
    monkeypatch.setattr(N, "SHARD_TOKENS", 100)
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["The", "of", "and", "to", f"w{r.randrange(90)}", "É"]) for _ in range(r.randint(0, 40)))) for i in range(120)]
    rows += [(7, rows[7][1]), (None, None), (None, "the of"), (500, ""), (501, "the " * 3000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, block int").repartition(3)
    plain = Plain(rows, order)
    same(K.score(df, order=order).collect(), [plain.row(*x) for x in rows])
    words = [*[w for (w,) in plain.count[1]], "unknown"]
    contexts = [("the",), ("unknown",), (None,) * (order - 1), *list(plain.total)[:: max(1, len(plain.total) // 40)]]
    for h in contexts:
        assert sum(plain.p(h, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_words_whose_polynomials_collide(spark):
    """Thue-Morse words and their complements of 1024 to 4096 letters agree in every polynomial hash modulo 2^64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    pairs = [(word[:n], word[n : 2 * n]) for n in (512, 1024, 2048)] + [(word, word.translate(str.maketrans("ab", "ba")))]
    train, held = [i for i in range(60) if not Plain.held_out(i)], [i for i in range(60) if Plain.held_out(i)]
    rows = [(train[k], a) for k, (a, _) in enumerate(pairs)] + [(held[k], b) for k, (_, b) in enumerate(pairs)]
    got = {r.doc_id: r.n_known for r in K.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[held[k]] == 1 and got[train[k]] == 2 for k in range(len(pairs)))


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("x", "a b"), (None, "a"), ("y" * 50, None)], "name string, text string")
    got = {r.name: r.n_tokens for r in K.score(df, id_col="name").collect()}
    assert got == {"x": 3, None: 2, "y" * 50: 1}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(60) if Plain.held_out(i)], "doc_id bigint, text string")
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in K.score(df).collect())
    assert K.score(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = Plain(rows)
    got = op3_katz(spark, sf).collect()
    same(got, [plain.row(*x) for x in rows])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
