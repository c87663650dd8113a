import numpy as np
import pytest

from millrace.llm import crosspolytope as C


def brute(rows):
    ids = np.array([i for i, _ in rows])
    x = C.unit(np.array([v for _, v in rows], float))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)}


def sample(rng):
    rows = list(rng.normal(size=(150, 16)))
    for size, noise in ((40, 0.02), (25, 0.06), (12, 0.09)):
        centre = rng.normal(size=16)
        rows += [centre + noise * np.linalg.norm(centre) * rng.normal(size=16) for _ in range(size)]
    rows += [rows[0]] * 30 + [rows[1] * 3]
    return [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize(("axes", "tile"), [(None, 1024), (1, 7), (2, 1024), (3, 16)])
def test_equals_brute_force(spark, axes, tile):
    rows = sample(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df, axes=axes, tile=tile).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert got == want


def test_drafts_bound_the_cosine():
    rng = np.random.default_rng(6)
    for dim in (1, 2, 5, 64):
        u = C.unit(np.concatenate([rng.normal(size=(200, dim)), np.eye(dim)[:1], np.ones((1, dim))]))
        d = C.Drafts(C.drafts(u), dim)
        assert (np.linalg.norm(u - d.vectors(), axis=1) <= d.error).all() and (d.error < 0.01 * np.sqrt(dim)).all()


def test_pairs_at_the_edge_are_settled_by_doubles(spark):
    """A star of vectors whose cosine with the first is within 1e-6 of the threshold, above and below."""
    rng = np.random.default_rng(8)
    rows = [(0, [1.0] + [0.0] * 15)]
    for i in range(1, 61):
        side = C.unit(rng.normal(size=(1, 15)))[0]
        cosine = 0.9 + (1e-6 if i % 2 else -1e-6)
        rows.append((i, [cosine, *(np.sqrt(1 - cosine**2) * side)]))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert got[0][0] == 30


def test_hadamard_keeps_length_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(C.hadamard(x) @ C.hadamard(x).T, x @ x.T)


def test_odd_rows(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(5, x, 1), (5, x, 1), (3, x, 1), (7, None, 1), (8, [0.0] * 3, 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [None, 1.0, 1.0], 1), (None, x, 1), (11, [1.0, 2.0], 1), (12, [1e300, 2e300, 3e300], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df).collect()}
    alone = {i: (0, i, True) for i in (7, 8, 9, 10, 11)}
    assert got == alone | {5: (2, 3, False), 3: (2, 3, True), 12: (2, 3, False), None: (0, None, False)}
    assert C.near_duplicates(df.limit(0)).collect() == []
