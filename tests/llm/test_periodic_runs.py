"""Periodic runs against brute force over all periods, and the query's digests."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

import __spark_entry__  # noqa: F401
from plan_alloc.llm import periodic_runs
from plan_alloc.llm.queries import op13_periodic_runs


def _brute(w, least=6, times=4):
    """start, length, period of every run, by start and then period."""
    n, best = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                best.setdefault((s, i + q), q)  # periods rise: the first is the smallest
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def _collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def _texts():
    r = np.random.default_rng(3)
    texts = []
    for t in range(400):
        n, letters = int(r.integers(0, 150)), int(r.integers(1, 5))
        w = [str(x) for x in r.integers(0, letters, n)]
        if t % 2 and n:
            a = int(r.integers(n))
            p = 1 + (n - a) // (3 + int(r.integers(8)))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(" ".join(w))
    return texts


def _split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ODD = [None, "", " \n\t\x0b ", "a", "a a a a a", "a a a a a a", "a b " * 9, "x" * 100_000, "ab " * 3000 + "c " + "ab ba " * 2000, "é ü " * 4, "a b c " * 4, "a b c " * 4 + "a b"]


@pytest.mark.parametrize("chunk", [200, 500_000])
def test_runs_and_collapse_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)  # taken along with the function
    texts = _texts() + ODD + [ODD[8]]
    df = spark.createDataFrame([(i if i % 7 else None, t, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, runs int, collapsed string")
    got = sorted((r.collapsed, r.n_words, [tuple(x) for x in r.runs]) for r in periodic_runs.collapse(df).collect())
    want = []
    for t in texts:
        w = _split(t)
        runs = _brute(w) if len(w) < 1000 else None
        if runs is None:  # two long stretches
            runs = [(0, 3000, 1), (3001, 4000, 2)]
        want.append((_collapsed(w, runs), len(w), runs))
    assert got == sorted(want)


def test_highly_periodic_blocks():
    """Blocks that are themselves periodic inside a longer period (three and more occurrences)."""
    r = np.random.default_rng(9)
    for _ in range(400):
        unit = ["a"] * int(r.integers(1, 30)) + ["b"] * int(r.integers(0, 3)) + ["a"] * int(r.integers(0, 30))
        unit = unit * int(r.integers(1, 3)) + ["c"] * int(r.integers(0, 2))
        w = (["a"] * int(r.integers(0, 9)) + unit * int(r.integers(3, 7)) + unit[: int(r.integers(0, len(unit) + 1))]) * int(r.integers(1, 3))
        a, z, q = periodic_runs.find_runs(np.array([ord(x) for x in w]), len(w))
        assert list(zip(a.tolist(), (z - a).tolist(), q.tolist(), strict=True)) == _brute(w)


def test_wavelet_successor():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 100, 257):
        values = r.permutation(n)
        tree = periodic_runs.WaveletMatrix(values)
        lo = r.integers(0, n + 1, 500)
        hi = np.minimum(n, lo + r.integers(0, n + 1, 500))
        bound = r.integers(0, 2 * n, 500)
        want = [min([v for v in values[a:b].tolist() if v >= x], default=n) for a, b, x in zip(lo, hi, bound, strict=True)]
        assert tree.successor(lo, hi, bound).tolist() == want


def test_empty_table(spark):
    assert periodic_runs.collapse(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_query_equals_brute_force_on_whole_table(spark):
    want = {}
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        w = _split(d.text)
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = _brute(w)
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, _collapsed(w, runs))]
        want[d.doc_id] = (d.doc_id, len(runs), s, m, q, 1000 * m // q if q else None, *digests)
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, SF_SMALL).collect()}
    assert got == want
    assert sum(r[1] > 0 for r in got.values()) > 5
