"""Spelling variants against brute force over all pairs of words."""

import collections
import re
import zlib

import numpy as np
from conftest import SF_SMALL

import __spark_entry__  # noqa: F401
from plan_alloc.llm import spelling
from plan_alloc.llm.queries import op11_spelling


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _brute(count, ratio=10):
    """word: (form, root, n, n_near, form_n), by all pairs that share a word with one letter left out."""
    buckets = collections.defaultdict(set)
    for w in count:
        buckets[w].add(w)
        for i in range(len(w)):
            buckets[w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for members in buckets.values():
        for a in members:
            near[a].update(b for b in members if _one_edit(a, b))
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), count[w], len(near[w]), count[form[w]] if form[w] is not None else None) for w in count}


def _got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_brute_force_on_random_words(spark):
    r = np.random.default_rng(7)
    for letters, sizes in (("ab", (0, 7)), ("abcé\U0001f600", (3, 9)), ("etaoinshr", (7, 9))):
        words = {"".join(letters[int(i)] for i in r.integers(0, len(letters), int(r.integers(*sizes)))) for _ in range(700)}
        count = {w: int(10 ** r.uniform(0, 5)) for w in words}
        df = spark.createDataFrame([(w, n, "clash") for w, n in count.items()], "word string, n long, form string")
        assert _got(spelling.group(df)) == _brute(count)


def test_edges(spark):
    long = "ab" * 4000
    rows = [(None, 5), ("", 1), ("a", 3), ("b", None), ("a", 7), (long, 2), (long[:-1], 30), ("chain", 1), ("chains", 10), ("chainse", 100), ("xchainse", 1000), ("tie", 1), ("tia", 50), ("tib", 50)]
    got = _got(spelling.group(spark.createDataFrame(rows, "w string, c int"), word_col="w", count_col="c"))
    assert got[None] == (None, None, 5, 0, None)
    assert got["a"] == (None, "a", 10, 2, None) and got["b"] == ("a", "a", 0, 2, 10) and got[""] == ("a", "a", 1, 2, 10)
    assert got[long] == (long[:-1], long[:-1], 2, 1, 30)
    assert got["chain"] == ("chains", "xchainse", 1, 1, 10)
    assert got["tie"] == ("tia", "tia", 1, 2, 50)
    assert spelling.group(spark.createDataFrame([], "word string, n long")).collect() == []


def test_one_crowded_signature(spark):
    """Anagrams with one head and tail share every signature."""
    r = np.random.default_rng(2)
    count = {"abc" + "".join(r.permutation(list("defghij"))) + "xyz": int(n) for n in r.integers(1, 1000, 500)}
    assert _got(spelling.group(spark.createDataFrame(list(count.items()), "word string, n long"))) == _brute(count)


def test_nothing_is_broadcast(spark):
    """the files of the words are small, the signatures of all of them are not."""
    df = spark.createDataFrame([(f"word{i:05d}", i) for i in range(500)], "word string, n long")
    for out in (spelling.near_pairs(df), spelling.group(df)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_query_equals_brute_force_on_whole_table(spark):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = collections.Counter()
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{d.doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 7
    want = _brute({w: n for w, n in count.items() if n >= 2})
    got = _got(op11_spelling(spark, SF_SMALL))
    assert got == want and sum(x[0] is not None for x in got.values()) > 5
