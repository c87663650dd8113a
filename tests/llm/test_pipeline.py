import numpy as np

import corpus_pipeline as P
from millrace.llm import mixing, ngrams, pii, sentencepiece_bpe
from millrace.llm.orderminhash import near_duplicates
from millrace.llm.sentencepiece_bpe import load

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    tables = [docs.collect()]
    for at, (_, stage) in enumerate(P.STAGES):
        docs = P.written(stage(spark, docs, SF), "test")
        if at < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS
        tables.append(docs.collect())
    start, good, single, clean, mixed, tokens = tables
    ids = [{r.doc_id for r in t} for t in tables]
    assert len(trusted - ids[1]) <= 0.02 * len(trusted) and len(ids[1]) < len(ids[0])
    kept = near_duplicates(spark.createDataFrame(good, docs_schema(spark))).filter("kept").collect()
    assert ids[2] == {r.doc_id for r in kept} and len(single) == len(ids[2])
    text = {r.doc_id: r.text for r in single}
    weights = dict(pii.trained())
    assert {r.doc_id: r.text for r in clean} == {i: pii.masked(t, pii.all_spans(t, weights)[1]) for i, t in text.items()}
    assert all(r.n_chars == len(r.text) for r in clean + mixed)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(spark.createDataFrame(clean, docs_schema(spark))).collect()}
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: t for i, (t, _) in taken.items() if t}
    library = load(P.model_path()).library
    assert sorted(len(library.encode(r.text)) + 2 for r in mixed) == sorted(r.n_tokens for r in tokens)


def docs_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema


def test_run(spark):
    rows = P.run(spark, SF).collect()
    assert rows and all(r.matches_library for r in rows)


def test_clashing_columns_and_repeated_rows(spark):
    """Extra columns with the names that operators use inside, rows that repeat, share an id, or have none."""
    words = " ".join(f"w{i}" for i in range(60))
    base = [(1, words, "en"), (1, words, "en"), (None, words + " x", "en"), (None, "other text of its own", "en"), (None, "other text of its own", "en"), (2, "one more with mail a@b.cd here", None), (2, "a different text under the same id", "en"), (3, None, "en"), (3, None, "en"), (4, "", "en"), (4, "", "en")]
    rows = [(*x, f"s{n % 2}", 7, f"spans{n}", n, "k", [n], "t", n, "h") for n, x in enumerate(base)]
    names = ["spans", "size", "_key", "row", "_text", "Masked", "h"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, size int, _key string, row array<int>, _text string, Masked int, h string"
    docs = spark.createDataFrame(rows, schema)
    for at, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, P.written(stage(spark, docs, SF), "test")
        got = docs.collect()
        if at < len(P.STAGES) - 1:
            assert docs.columns == [*COLUMNS, *names], name
            by = {x[6]: x for x in rows}
            assert all(r[7:] == by[r.size][7:] and r.spans == f"spans{r.size}" and r.doc_id == by[r.size][0] for r in got)
        if name == "MinHash near-dedup":
            assert sorted((r.doc_id or 0, "-" if r.text is None else r.text) for r in got) == sorted([(1, words), (0, "other text of its own"), (2, base[5][1]), (2, base[6][1]), (3, "-"), (3, "-"), (4, "")])
        if name == "PII":
            assert {r.text for r in got if r.size == 5} == {"one more with mail <EMAIL> here"}
    assert before.count() == len(got) > 0


def test_near_dedup_equals_brute_force(spark):
    """Against alignment of all pairs, on documents with planted copies at all distances."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        base = [f"v{x}" for x in rng.integers(0, 400, rng.integers(4, 120))]
        texts.append(base)
        for _ in range(2):
            new = list(base)
            for _ in range(int(rng.integers(0, len(new) // 3 + 1))):
                new[rng.integers(len(new))] = f"n{rng.integers(10**6)}"
            texts.append(new)
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    got = {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, docs_schema(spark)), SF).collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i], texts[j]
            row = list(range(len(b) + 1))
            for x, u in enumerate(a, 1):
                last, row[0] = row[0], x
                for y, v in enumerate(b, 1):
                    last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (u != v))
            if 1 - row[-1] / max(len(a), len(b)) >= 0.8 - 1e-12:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert got == {i for i, r in enumerate(root) if r == i}


def test_empty_and_null(spark):
    rows = [(1, None, "en", "a", None), (1, None, "en", "a", None), (None, "the of and", None, None, 3), (2, "", "en", "b", 0), (3, "the and of to in", "en", "a", 16)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, docs_schema(spark))
        for _, stage in P.STAGES:
            docs = P.written(stage(spark, docs, SF), "test")
        assert all(np.isfinite(r.n_tokens) for r in docs.collect())


def test_quality_takes_back_what_tokens_kept():
    """A worker that has encoded texts lets its stretches go when it counts n-grams."""
    load(P.model_path()).encode(["some words of a text"])
    assert sentencepiece_bpe._loaded
    assert list(ngrams.rows_of(iter([]))) == [] and not sentencepiece_bpe._loaded
