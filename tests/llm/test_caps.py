import numpy as np
import pytest

from panelspark.llm.caps import CODES, DENSE, HITS, code, compared, decoded, filters_of, near_vectors, nearest, scores, shape, turned


def brute(rows, cosine=0.98):
    """(id, links, component) by comparing everything."""
    sound = []
    for k, (_, label, v) in enumerate(rows):
        ok = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        sound.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    by = {}
    for k, (_, label, v) in enumerate(rows):
        if sound[k] is not None:
            by.setdefault((label, len(v)), []).append(k)
    for members in by.values():
        m = np.stack([sound[k] for k in members])
        for a, b in np.argwhere(m @ m.T >= cosine):
            if a != b:
                near[members[a]][members[b]] = True
    component = list(range(n))
    for k in range(n):
        if component[k] == k:
            todo = [k]
            while todo:
                x = todo.pop()
                for y in range(n):
                    if near[x][y] and component[y] == y and y != k:
                        component[y] = k
                        todo.append(y)
    out = []
    for k in range(n):
        ids = [rows[j][0] for j in range(n) if component[j] == component[k] and rows[j][0] is not None]
        out.append((rows[k][0], sum(near[k]), min(ids, default=None)))
    return out


def test_list_decoding_finds_all_directions():
    draw = np.random.default_rng(1)
    for blocks, size in ((1, 50), (2, 30), (3, 12)):
        lists = code(24, blocks, size)
        v = draw.normal(size=24)
        parts = scores(v, lists)
        total = parts[0]
        for s in parts[1:]:
            total = (total[:, None] + s[None, :]).ravel()
        for limit in np.quantile(total, [0.5, 0.99, 1.0]) - 1e-6:
            assert decoded(parts, limit).tolist() == np.flatnonzero(total >= limit).tolist()
        assert len(decoded(parts, total.max() + 1)) == 0


@pytest.mark.parametrize("n", [100, 50_000, 5_000_000])
def test_vectors_at_the_limit_meet(n):
    """Recall of pairs at exactly the least cosine, where it is lowest."""
    draw = np.random.default_rng(2)
    blocks, size, limit = shape(n, 64)
    met = 0
    for _ in range(150):
        a, b = draw.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b)
        lists = [code(64, blocks, size, c) for c in range(CODES)]
        met += any(np.intersect1d(decoded(scores(a, x), limit), decoded(scores(b, x), limit)).size for x in lists)
    assert met / 150 > 0.95


def test_pairs_count_in_their_first_common_filter_only():
    v = np.array([[1.0, 0.0], [1.0, 0.001], [1.0, 0.002], [0.0, 1.0]])
    earlier = [np.array([3]), np.array([3]), np.array([], int), np.array([3])]
    counts, label = compared(v, np.array([1, 2, 4, 8]), earlier, np.zeros(4, int), 0.98)
    assert counts.tolist() == [4, 4, 3, 0]
    assert label.tolist() == [0, 0, 0, 3]
    across, _ = compared(v, np.array([1, 2, 4, 8]), [np.array([], int)] * 4, np.array([0, 0, 1, 1]), 0.98)
    assert across.tolist() == [4, 4, 3, 0]


def test_whole_table_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    want = {r[0]: r[1:] for r in brute(rows)}
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    assert set(got) == set(want)
    assert all(got[k].n_links <= want[k][0] for k in want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[k].component_id == want[k][1] for k in want) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def clouds(n, copies, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(4):
        centre = draw.normal(size=16)
        for _ in range(n):
            rows.append((len(rows), c % 2, (centre + draw.normal(size=16) * 0.09).astype(np.float32).tolist()))
    for _ in range(copies):
        rows.append((len(rows), 0, rows[0][2]))
    return rows


@pytest.mark.parametrize("tile", [4096, 16])
def test_clouds_copies_and_tiles(spark, tile, monkeypatch):
    from panelspark.llm import caps

    rows = clouds(40, 30, tile)
    monkeypatch.setattr(caps.cap_links, "__defaults__", (caps.COSINE, caps.HITS, tile))
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    want = {r[0]: r[1:] for r in brute(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table, hits=60).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, None), (2, 1, []), (3, 1, [0.0, 0.0]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, [None, 1.0]),
        (7, None, [1.0, 0.0]), (8, 1, [1.0, 0.0]), (9, 1, [2.0, 0.0]), (10, 1, [1.0, 0.0]), (11, 2, [1.0, 0.0]),
        (None, 1, [3.0, 0.0]), (12, 1, [1.0, 0.0, 0.0]), (8, 1, [1.0, 0.0]), (13, 1, [-1.0, 0.0]), (4, 1, [nan, 1.0]),
    ]
    table = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "vec_id bigint, label int, embedding array<float>, rep string, n int, filters int")
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(table).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert near_vectors(table.limit(0)).count() == 0


def uneven(kind, draw, dim=64):
    v = draw.normal(size=dim)
    if kind == "half":
        v[dim // 2 :] *= 0.1
    elif kind == "sparse":
        v[draw.permutation(dim)[4:]] = 0
    elif kind == "one":
        v = np.eye(dim)[draw.integers(dim)]
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("n", [100_000, 500_000_000])
@pytest.mark.parametrize("kind", ["half", "sparse", "one"])
def test_uneven_vectors_at_the_limit_meet(kind, n):
    """Energy in one block of two or three is found like any other."""
    draw = np.random.default_rng(4)
    blocks, size, limit = shape(n, 64)
    assert blocks == (2 if n < 1_000_000 else 3)
    met = 0
    for _ in range(100):
        a = uneven(kind, draw)
        b = uneven("half", draw) if kind == "half" else draw.normal(size=64)
        b -= a * (a @ b)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b)
        met += np.intersect1d(*filters_of(np.stack([a, b]), blocks, size, limit, HITS)).size > 0
    assert met >= 95


def test_turns_keep_angles_and_best_directions_are_found():
    draw = np.random.default_rng(5)
    for dim in (1, 2, 64, DENSE + 1):
        v = draw.normal(size=(3, dim))
        assert np.allclose(turned(v, 1) @ turned(v, 1).T, v @ v.T)
    lists = code(24, 3, 12)
    parts = scores(draw.normal(size=24), lists)
    total = (parts[0][:, None, None] + parts[1][:, None] + parts[2]).ravel()
    assert nearest(parts, 5).tolist() == sorted(np.argsort(-total)[:5].tolist())
    # every vector has filters, in ascending order, however high the limit
    for found in filters_of(draw.normal(size=(5, 24)), 3, 12, 9.0, 3):
        assert len(found) == 3 * CODES and (np.diff(found) > 0).all()


def test_more_than_a_thousand_lengths(spark):
    rows = [(n, 0) for n in range(1, 1004)] + [(n, 1) for n in range(998, 1004)]
    ids = spark.createDataFrame(rows, "label int, copy int").repartition(4)
    table = ids.selectExpr("label * 10 + copy vec_id", "label", "transform(sequence(1, label), i -> sin(i * label) + copy * 0.001) embedding")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()}
    assert got == {n * 10 + c: (int(n >= 998), n * 10) for n, c in rows}
