"""SimHash, line and suffix dedup, decontamination, URL filter, nearest neighbours and the pipeline against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from plan_alloc.llm import ann, components, decontaminate, line_dedup, simhash, suffix_dedup, url_filter
from plan_alloc.llm.queries import RULES


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One two three"), (5, "one TWO three"), (6, "x" * 5000), (None, "one two three"), (4, "One two three"), (7, "é" * 300), (8, "a b")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(0)).withColumn("n_lines", F.lit("clash"))


def _ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def _groups(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 202), (300, 300), (200, 202)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", _ascii_lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        bits += [h >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(spark, which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, _fingerprint(r.text)) for r in df.collect()]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3]
    root = _groups(len(rows), pairs)
    least = {g: min((d for (d, _), r in zip(rows, root, strict=True) if r == g and d is not None), default=None) for g in root}
    want = sorted((str(d), f"{f:016x}", least[g]) for (d, f), g in zip(rows, root, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.link(df).collect()) == want


def test_simhash_crowded_buckets_lose_no_link(spark):
    r = np.random.default_rng(5)
    base = int(r.integers(1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 62, (300, 2))} | {int(x) for x in r.integers(1 << 62, size=300)})
    reps = spark.createDataFrame([(p,) for p in prints], "f long")
    near = lambda p: p.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    got = {x.node: x.component for x in components.bucket_components(simhash.members_of(reps, 3, crowded=8), near).collect()}
    root = _groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for i, p in enumerate(prints):
        assert got.get(p, p) == prints[root[i]]


def _shingles(line):
    t = line.ljust(8, "\0")
    return {t[i : i + 8] for i in range(len(t) - 7)}


def _jaccard_pairs(lines, t=0.8):
    sets = [_shingles(x) for x in lines]
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]


def _template_lines(r, n):
    """Lines that share a template but differ in more than a fifth, some with near variants, and short and odd ones."""
    word = lambda k: "".join(chr(97 + int(c)) for c in r.integers(0, 26, k))
    own = [f"the same notice stands on every page of this site, number {word(30)}" for _ in range(n)]
    near = [x[:-1] + "X" for x in own[: n // 10]] + [x + "é" for x in own[: n // 20]] + ["Ж" + x for x in own[n // 20 : n // 8]]
    long = [word(3000) for _ in range(3)]
    return list(dict.fromkeys([*own, *near, *long, *[x[:-100] + "Y" * 100 for x in long], "a", "b", "ab", "12345678", "123456789", "1234567890" * 3, "1234567890" * 4]))


def test_rare_shingles_find_every_pair_at_the_threshold(spark):
    lines = _template_lines(np.random.default_rng(3), 150)
    n, want = len(lines), _jaccard_pairs(lines)
    table = lambda c: spark.createDataFrame([(i, c(i), x) for i, x in enumerate(lines)], "h long, c long, line string")
    got = {(r.b, r.a) for r in line_dedup.rare_shingle_pairs(table(lambda i: i), 0.8).collect()}
    assert set(want) <= got and len(want) > 20
    assert len(got) < n * n // 50  # the shared template makes no pairs
    assert line_dedup.rare_shingle_pairs(table(lambda i: 0), 0.8).count() == 0  # all of one component already
    assert line_dedup.rare_shingle_pairs(table(lambda i: i).limit(0), 0.8).count() == 0


def test_a_crowded_bucket_is_split_without_all_its_pairs(spark):
    lines = _template_lines(np.random.default_rng(4), 200)
    judged = []

    def verify(pairs):
        rows = [(r.a, r.b) for r in pairs.select("a", "b").collect()]
        judged.append(len(rows))
        good = [(a, b) for a, b in rows if len(_shingles(lines[a]) & _shingles(lines[b])) >= 0.8 * len(_shingles(lines[a]) | _shingles(lines[b]))]
        return spark.createDataFrame(good, "a long, b long")

    def split(full):
        texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
        return line_dedup.rare_shingle_pairs(full.join(texts, "node").withColumnRenamed("node", "h"), 0.8)

    members = spark.createDataFrame([(b, i) for i in range(len(lines)) for b in ((7, 8) if i % 3 else (7,))], "bucket long, node long")
    got = {r.node: r.component for r in components.bucket_components(members, verify, split, crowded=20).collect()}
    assert [got.get(i, i) for i in range(len(lines))] == _groups(len(lines), _jaccard_pairs(lines))
    assert sum(judged) < 5 * len(lines)


def test_lines_of_crowded_buckets_go_on_by_their_prefixes_only(spark, tmp_path):
    """pipeline, op7: every shingle of every line in a crowded bucket was a row, and met its count in a join."""
    lines = _template_lines(np.random.default_rng(5), 120)
    table = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "h long, c long, line string")
    want = _jaccard_pairs(lines)
    kept = {}
    keep = line_dedup.keep
    line_dedup.keep = lambda df, label: kept.setdefault(label, keep(df, label))
    try:
        got = {(r.b, r.a) for r in line_dedup.rare_shingle_pairs(table, 0.8).collect()}
    finally:
        line_dedup.keep = keep
    assert set(want) <= got
    assert max(df.count() for df in kept.values()) < sum(len(_shingles(x)) for x in lines) // 2


def test_near_copies_of_one_class_make_few_pairs(spark):
    """pipeline, op7: copies that are linked through a common line met each other line by line."""
    r = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 6))
    base = [word() for _ in range(60)]
    lines = [" ".join(base)]
    for i in range(150):
        words = list(base)
        for at in r.choice(np.arange(2, 58), 3, replace=False):
            words[at] = word()
        lines.append(" ".join(words))
    want = _jaccard_pairs(lines)
    table = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "h long, c long, line string")
    got = {(r.b, r.a) for r in line_dedup.rare_shingle_pairs(table, 0.8, line_dedup.GATHERED).collect()}
    linked = [p for p in got if p in set(want)]
    assert _groups(len(lines), linked) == _groups(len(lines), want)
    assert len(got) < 10 * len(lines)


def test_shared_buckets_are_found_in_one_pass_over_sorted_rows():
    r = np.random.default_rng(6)
    for _ in range(200):
        rows = sorted(zip(r.integers(0, 8, 20).tolist(), r.integers(0, 4, 20).tolist(), strict=True))
        cuts = [0, *sorted(r.integers(0, 21, 4).tolist()), 20]
        batches = [pa.RecordBatch.from_arrays([pa.array([x for _, x in rows[a:z]], pa.int64()), pa.array([b for b, _ in rows[a:z]], pa.int64())], ["node", "bucket"]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        got = [(b, x) for out in line_dedup._shared(batches) for x, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        every = sorted(set(rows))
        assert got == [x for x in every if sum(y[0] == x[0] for y in every) > 1]


def test_line_dedup(spark, docs, odd):
    pool = docs.where("doc_id < 60")
    lines = [(r.doc_id, i, x) for r in pool.collect() for i, x in enumerate(r.text.split("\n")) if x.strip()]
    distinct = list(dict.fromkeys(x for *_, x in sorted(lines)))
    root = dict(zip(distinct, _groups(len(distinct), _jaccard_pairs(distinct)), strict=True))
    seen, kept = set(), {}
    for d, i, x in sorted(lines):
        kept.setdefault(d, [])
        if root[x] not in seen:
            seen.add(root[x])
            kept[d].append(i)
    wrong = 0
    for r in line_dedup.dedup(pool).join(pool.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
        old = r.old.split("\n")
        want = "\n".join(x for i, x in enumerate(old) if not x.strip() or i in kept[r.doc_id])
        wrong += want != r.text
        assert r.n_lines == len(old) and r.n_removed <= len(old)
    assert wrong <= 1  # banding finds a pair at the threshold with a chance of over 0.99
    got = sorted((str(r.doc_id), r.text is None, r.text or "", r.n_removed) for r in line_dedup.dedup(odd).collect())
    assert ("None", False, "one two three", 0) in got and ("1", True, "", 0) in got and len(got) == 10
    assert line_dedup.dedup(odd.limit(0)).count() == 0


def test_blank_lines_of_any_white_space_stay(spark):
    text = "one line of text\r\n\r\n\t\r\n\u3000\u00a0\nanother line of text\r\n\x0b"
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()}
    assert got == {1: (text, 0), 2: ("\r\n\t\r\n\u3000\u00a0\n\x0b", 2)}


def test_leaks_are_removed_by_text_where_ids_repeat(spark, tmp_path):
    import corpus_pipeline as P

    leak, clean = " ".join(f"leaked{i}" for i in range(14)), " ".join(f"clean{i}" for i in range(14))
    spark.createDataFrame([("i1", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, leak), (None, clean), (7, leak), (7, clean), (8, clean), (9, None), (9, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for kept in (rows, [r for r in rows if r != (7, clean)][2:5]):
        docs = spark.createDataFrame([(*r, "en", "s", 1) for r in kept], columns)
        got = [(r.doc_id, r.text) for r in P.drop_leaks(spark, docs, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted([r for r in kept if r[1] != leak], key=str)
    assert P.drop_leaks(spark, spark.createDataFrame([], columns), str(tmp_path)).count() == 0


def test_line_dedup_compares_characters(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for i, letters in enumerate(("абвгдежзиклмнопрст", "天地人日月山水火木金土石花草虫魚鳥", "abcdefghijklmnop", "😀😁😂😃😄😅😆😇😈😉😊")):
        for k, n in enumerate((40, 60, 100, 200, 400)):
            line = "".join(r.choice(list(letters), n))
            other = line[: n // 2] + "ю" + line[n // 2 + 1 :]
            rows += [(10 * i + 2 * k, line), (10 * i + 2 * k + 1, other)]
            a, b = ({t[j : j + 8] for j in range(n - 7)} for t in (line, other))
            want[10 * i + 2 * k + 1] = len(a & b) >= 0.8 * len(a | b)
    assert set(want.values()) == {False, True}
    got = {x.doc_id: x.text for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d] == "" for d in want} == want and all(got[d] for d, _ in rows if d % 2 == 0)


def _cut(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        out[i] = (bytes(x for x, y in zip(b, gone, strict=True) if not y), len(re.findall(b"\1+", bytes(gone))))
    return out


def test_suffix_dedup(spark, docs, odd):
    own = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["a" * 500, "a" * 99, "a" * 100, None, "", "ab" * 300, "xé" * 120, "é" * 200, "Q" * 50 + "a" * 120 + "Z"])], "doc_id long, text string")
    df = docs.unionByName(own)
    want = _cut([(r.doc_id, r.text) for r in df.collect()], 100)
    for r in suffix_dedup.dedup(df).collect():
        assert (bytes(r.kept), len(r.spans)) == want[r.doc_id]
        assert r.n_bytes - sum(s.bytes for s in r.spans) == len(r.kept)
    got = suffix_dedup.dedup(odd).collect()
    assert len(got) == 10 and next(bytes(r.kept) for r in got if r.doc_id == 6) == b"x"
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0


def test_suffix_refinement_merges_common_anchors():
    import pyarrow as pa

    data = [b"k" * 20 + bytes(range(100)) * 2, bytes(range(100)) * 2]
    table = pa.table({"key": [1, 1], "hot": [True, True], "id": [2, 1], "copy": [0, 0], "lo": pa.array([0, 5], pa.int32()), "bytes": data})
    out = pa.Table.from_batches(list(suffix_dedup._repeats(table, 100))).to_pylist()
    first = {(r["id"], r["lo"]) for r in out if r["h1"] is not None}
    repeat = {(r["id"], r["lo"] + k) for r in out if r["h1"] is None for k in range(r["n"])}
    assert len(first) == len({(r["h1"], r["h2"]) for r in out if r["h1"] is not None}) and not first & repeat
    assert len(first) + len(repeat) == 221 - 100 + 101


def test_decontaminate(spark, docs, odd):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "one two"), (901, None), (902, "...")], "item_id long, text string"))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _ascii_lower(t))
    windows = {}
    for r in items.collect():
        w = cut(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    for df in (docs, odd):
        want = []
        for r in df.collect():
            w, hit, of = cut(r.text), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        of |= windows[tuple(w[k : k + n])]
            want.append((str(r.doc_id), len(w), len(hit), sorted(of), bool(hit)))
        got = decontaminate.judge(df, items).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == sorted(want)
    near = decontaminate.matches(spark.createDataFrame([(1, "one x two")], "doc_id long, text string"), items, slop=1)[0]
    assert near.count() > 0
    assert not any(r.contaminated for r in decontaminate.judge(odd, items.limit(0)).collect())
    assert decontaminate.judge(odd.limit(0), items).count() == 0


def test_decontaminate_runs_no_python(spark, docs):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    plan = decontaminate.judge(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_rules_and_verdicts(spark):
    urls = ["https://a.example.org/es/1", "http://example.org/en/12?x=1", "https://X.ORG/q", "https://org", "http://a.com/fr/1#t", "http://b.com/de/", "http://b.net/de/", None, "nothing", "", "http://b.net/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 30)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("id", F.lit(2))
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    assert len(got) == len(urls) * 30
    assert [got[i].rule for i in range(11)] == ["example.org/es/", "example.org/en/1", "org/", None, "com/fr/", "com/de/", None, None, None, None, None]
    assert [got[i].verdict for i in (0, 1, 2, 4, 5)] == ["block", "block", "allow", "allow", "block"]
    assert (got[2].host, got[2].path) == ("x.org", "/q") and (got[7].host, got[7].path) == ("", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert {r.verdict for r in url_filter.judge(pages.where("page_id in (6, 7)"), RULES).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_nearest_neighbours(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    table = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    hit = total = 0
    found = {}
    for r in ann.search(rows).collect():
        found.setdefault(r.query_id, {})[r.rank] = r
        assert r.score == pytest.approx(float((table[r.query_id] * table[r.vec_id]).sum()), abs=1e-12)
    assert set(found) == {i for i in table if i % 20 == 0}
    for q, ranks in found.items():
        best = sorted((-round(float(table[q] @ v), 12), i) for i, v in table.items() if i != q)[:20]
        hit += len({i for _, i in best} & {r.vec_id for r in ranks.values()})
        total += 20
        assert sorted(ranks) == list(range(1, 21))
    assert hit / total >= 0.9


def test_nearest_neighbours_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.1]), (101, None), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [1.0]), (None, [1.0, 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in ann.search(df, success=0.99).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [v for _, v in sorted(got[0])] == list(range(1, 21))
    assert [v for _, v in sorted(got[40])] == list(range(20))
    assert len(got[100]) == 20 and ann.search(df.limit(0)).count() == 0


def test_nearest_neighbours_of_vectors_of_many_lengths(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((6000, 32))
    x *= (np.exp(0.5 * r.standard_normal(6000)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for row in ann.search(df, every=100).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        near = x @ x[q]
        near[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-near)[:20].tolist()))
    assert hit / (60 * 20) >= 0.9


def test_nearest_neighbours_of_a_lonely_query(spark):
    r = np.random.default_rng(4)
    x = np.vstack([np.eye(8)[0] + 0.02 * r.standard_normal((2000, 8)), -np.eye(8)[0] + 0.02 * r.standard_normal((3, 8))])
    ids = [2 * i + 1 for i in range(2000)] + [0, 20, 40]  # the queries lie far from all other rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = {}
    for row in ann.search(df).collect():
        found.setdefault(row.query_id, []).append((row.rank, row.vec_id))
    for n, q in enumerate((0, 20, 40)):
        score = x @ x[2000 + n]
        want = sorted((i for i in range(2003) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:20]
        assert {v for _, v in found[q]} >= {0, 20, 40} - {q} and [k for k, _ in sorted(found[q])] == list(range(1, 21))
        assert len({v for _, v in found[q]} & {ids[i] for i in want}) >= 18


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = [(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(["you idiot and moron " + "word " * 20, ""])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = P.keep(stage(spark, before, SF_SMALL), "test")
        assert docs.columns == P.COLUMNS and docs.count() <= before.count()
        if name == "line dedup":
            assert docs.count() == before.count()
        if name == "simhash near-dedup":
            kept = {r.doc_id for r in docs.collect()}
            groups = {}
            for r in simhash.link(before).collect():
                groups.setdefault(r.component_id, set()).add(r.doc_id)
            assert kept == set(groups)
        if name == "benchmark decontamination":
            assert not any(r.contaminated for r in decontaminate.judge(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect())
    packed = P.STAGES[-1][1](spark, docs, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()
