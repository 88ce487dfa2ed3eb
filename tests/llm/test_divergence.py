"""Source divergences against plain Python, with tiny blocks and the odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadlens.llm import divergence
from threadlens.llm.divergence import _share, source_divergence

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, text string, lang string, source string"


def expected(rows, min_docs=3, top=4):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    share = lambda n, total, v: 1 + (10**9 * (n + 2)) // (total + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        peers = [s for x, s in groups if x == lang]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in peers}
        whole = {t: sum(n[s][t] for s in peers) for t in kept}
        p = {s: {t: share(n[s][t], sum(n[s].values()), len(kept)) for t in kept} for s in peers}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        pairs = [(-sum(apart(p[source][t], p[s][t]) for t in kept), s.encode(), s) for s in peers if s != source]
        terms = [(-apart(p[source][t], q[t]), t.encode(), t) for t in kept
                 if n[source][t] > 0 and p[source][t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, i, -v, r) for r, (v, _, i) in enumerate(found, 1)]
    return sorted(out)


def rows_of(seed, docs=160):
    pick = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60)] + ["Äö", "äö", "中文", "I'm"]
    out = []
    for i in range(docs):
        source = "hot" if i % 2 else pick.choice(["a", "b", "é", None])
        lang = "en" if i % 3 else pick.choice(["fr", None])
        text = " ".join(pick.choice(words[: pick.randint(3, 64)]) for _ in range(pick.randint(0, 30)))
        out.append((i, pick.choice([text, text.upper(), text.replace(" ", "-1,")]), lang, source))
    out += [(900, None, "en", "silent"), (901, "", "en", "silent"), (902, "12 34", "de", "alone"),
            (903, "rare words", "xx", "a"), (904, "other ones", "xx", "b"), (905, "wa " * 200_000, "en", "a"),
            (906, "wa", "en", "a"), (906, "wa", "en", "a"), (None, "wb wb", "en", None)]
    return out


@pytest.mark.parametrize("block, slab", [(200_000, 2_000_000), (7, 9)])
def test_matches_brute_force(spark, block, slab):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = source_divergence(docs, 3, 4, block_postings=block, slab_cells=slab)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == expected(rows)


def test_counting_flushes_and_long_texts_are_cut(spark, monkeypatch):
    """Small limits must not change anything: they hold only within the task here."""
    rows = rows_of(4, 60)
    texts = [((t or "").encode(), lang or "", source or "") for _, t, lang, source in rows]
    import pyarrow as pa

    monkeypatch.setattr(divergence, "FLUSH_TERMS", 5)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 11)
    batch = pa.RecordBatch.from_pydict(
        {"lang": [x[1] for x in texts], "source": [x[2] for x in texts], "text": [x[0] for x in texts]}
    )
    n, docs = Counter(), Counter()
    for part in divergence._count_terms(iter([batch])):
        for r in part.to_pylist():
            if r["term"] is not None:
                n[r["lang"], r["term"].decode()] += r["n"]
                docs[r["lang"], r["term"].decode()] += r["docs"]
    want, held = Counter(), Counter()
    for _, text, lang, _ in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
        want.update((lang or "", w) for w in words)
        held.update((lang or "", w) for w in set(words))
    assert n == want and docs == held


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert source_divergence(docs).count() == 0
    rows = rows_of(5, 30)
    named = spark.createDataFrame(
        [(*r, "x", 1, 2, "y") for r in rows], SCHEMA + ", term string, n int, kept int, item string"
    )
    assert sorted(tuple(r) for r in source_divergence(named, 3, 4).collect()) == expected(rows)


def test_shares_are_exact_for_large_counts():
    n = np.array([0, 1, 10**12, 9 * 10**14, 8_999_999_999_999], np.int64)
    whole = np.full(5, 9 * 10**14 + 2, np.int64)
    assert _share(n, whole).tolist() == [1 + 10**9 * (int(x) + 2) // int(whole[0]) for x in n]
