import numpy as np

from weft.functions.nearest import Nearest, few_copies


def seen(q, ids, x, k, own, once, step):
    dot = lambda at, rows: (q[at] * rows).sum(axis=1)
    best = Nearest(q, dot, k, own, once)
    for at in range(0, len(ids), step):
        best.see(ids[at : at + step], x[at : at + step], x[at : at + step])
    out = {}
    for at, i, s in zip(*best.found()):
        out.setdefault(int(at), []).append((int(i), float(s)))
    return out


def brute(q, ids, x, k, own, once):
    out = {}
    for at in range(len(q)):
        found = [(-float(s), int(i)) for i, s in zip(ids, (q[at] * x).sum(axis=1)) if own is None or i != own[at]]
        if once:
            nearest = {}
            for s, i in sorted(found):
                nearest.setdefault(i, s)
            found = [(s, i) for i, s in nearest.items()]
        out[at] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def test_equals_brute_force():
    rnd = np.random.RandomState(2)
    x = rnd.randn(900, 12)
    x[200:400] = x[:200]  # copies of other ids
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    ids = rnd.permutation(900).astype(np.int64)
    shared = np.where(rnd.rand(900) < 0.3, ids // 9, ids)  # some ids on many rows
    q = x[np.argsort(ids)][::7]
    own = np.arange(0, 900, 7)
    for step in (3, 100, 900):
        assert seen(q, ids, x, 5, own, True, step) == brute(q, ids, x, 5, own, True)
        assert seen(q, ids, x, 5, None, False, step) == brute(q, ids, x, 5, None, False)
        assert seen(q, shared, x, 5, own, True, step) == brute(q, shared, x, 5, own, True)


def test_copies_leave_the_least_ids():
    x = np.array([[1.0, 2.0]] * 6 + [[3.0, 4.0]])
    ids = np.array([9, 4, 4, 7, 1, 3, 8])
    assert sorted(ids[few_copies(x, ids, 3, False)].tolist()) == [1, 3, 4, 8]
    assert sorted(ids[few_copies(x, ids, 4, True)].tolist()) == [1, 3, 4, 7, 8]
    assert sorted(ids[few_copies(x, ids, 4, False)].tolist()) == [1, 3, 4, 4, 8]
