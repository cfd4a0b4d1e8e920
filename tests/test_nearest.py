"""Lists of nearest vectors against sorting all."""

import numpy as np

from eventloom.operators import search


def test_nearest_looks_at_few_similarities(monkeypatch):
    """By blocks; of many similarities few are sorted."""
    r, sorted_rows = np.random.default_rng(3), []
    monkeypatch.setattr(search._Best, "_sort", lambda self, f=search._Best._sort: (sorted_rows.append(self.waiting), f(self)))
    for copies in (0, 0.6):
        v = r.standard_normal((4000, 8))
        v[r.random(len(v)) < copies] = v[0]
        v /= np.sqrt((v * v).sum(1))[:, None]
        own = r.permutation(len(v))
        q, ids, names = v[:50], own[:50], np.array(own % 3, object)
        top = search._Best(q, ids, 5, None)
        for lo in range(0, len(v), 100):
            top.add(v[lo : lo + 100], own[lo : lo + 100], names[lo : lo + 100])
        at, near, sims, labels = top.rows()
        all_ = np.round(q @ v.T, 6)
        want = [[(own[j], all_[i, j], own[j] % 3) for j in np.lexsort((own, -all_[i])) if own[j] != ids[i]][:5] for i in range(len(q))]
        assert list(zip(at, near, sims, labels, strict=True)) == [(i, *x) for i, rows in enumerate(want) for x in rows]
        if not copies:
            assert sum(sorted_rows) < q.shape[0] * len(v) / 20
