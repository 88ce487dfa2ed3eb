"""The codes of vector near-dedup choose the pairs that are compared exactly."""

import numpy as np
import pandas as pd
from threadlens.llm import vector_dedup
from threadlens.llm.vector_dedup import _compare, fit_codebook


def test_exact_cosines_of_candidates_only(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[200:] = x[:100] + rng.normal(size=(100, 16)) * 0.03
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit @ unit.T >= 0.98
    np.fill_diagonal(want, False)
    side = pd.DataFrame({"list": 0, "cls": np.arange(300), "rep": np.arange(300), "n": 1, "vec": list(x)})
    frame = pd.concat([side.assign(asks=True), side.assign(asks=False)], ignore_index=True)
    seen, cosines = [], vector_dedup.exact_cosines

    def counted(a, b, na, nb, i, j):
        seen.append((len(i), set(zip(i.tolist(), j.tolist()))))
        return cosines(a, b, na, nb, i, j)

    monkeypatch.setattr(vector_dedup, "exact_cosines", counted)
    monkeypatch.setattr(vector_dedup, "_SLICE", 16 * 50)
    out = _compare(fit_codebook(x, 300, lists=1), 0.98, float(np.sqrt(0.04)))(frame)
    met = set().union(*(s for _, s in seen))
    assert max(n for n, _ in seen) <= 50 and len(met) == sum(n for n, _ in seen)
    assert set(zip(*(c.tolist() for c in np.nonzero(want)))) <= met
    assert len(met) < 300 * 299 / 10
    links = out.groupby("cls")["links"].sum()
    assert {k: n for k, n in links.items() if n} == {k: n for k, n in enumerate(want.sum(1)) if n}
