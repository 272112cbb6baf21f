"""Token counts, packing, toxicity and page text against the tokenizer library, brute force and held-out labels."""

import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (puts the repository on the path)
from plan_alloc.llm import html_extract, packing, queries, toxicity

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "a  b", "\n\n a", "x<|endoftext|>y <|startoftext|>", "aaaaaaa aaaa", "a\tb", "日本語 123", "it's we'll", "a\x1cb c\x1f", "W̊ İ Σας µ ß", "a\xa0b　c", "K Å é", "x" * 3000, "ab " * 2000]


def _odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a  b")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("length", F.lit(1))


def test_token_counts_are_the_library_s(spark):
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    for df in (docs, _odd(spark)):
        text = {}
        for r in df.select("doc_id", "text").collect():
            text.setdefault(r.doc_id, []).append(r.text)
        got = queries.token_counts.count_tokens(df, queries.vocabulary("byte_bpe_50k.json")).collect()
        assert len(got) == df.count()
        for r in got:
            want = {(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in text[r.doc_id]}
            assert (r.n_bytes, r.n_tokens) in want and r.over_limit == (r.n_tokens > 512)


def test_packing_holds_every_id_once(spark):
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(_odd(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text").where("doc_id is not null").dropDuplicates(["doc_id"]))
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    pieces = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), shard_tokens=40_000).collect()
    at = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at.get(p.doc_id, 0) and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        at[p.doc_id] = p.start + p.length
    assert at == {d: len(x) for d, x in ids.items()}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096 and end & (end - 1) == 0  # full, or a power of two: no padding
    assert packing.pack(docs.limit(0), queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_puts_lexical_neighbours_together():
    words = [np.array(w) for w in ([1, 2, 3, 9], [50, 51, 52, 9], [1, 2, 3, 8], [50, 51, 52, 8])]
    pieces = packing.pack_shard([4, 4, 4, 4], words, 8)
    assert [{p[0] for p in pieces if p[3] == s} for s in (0, 1)] == [{0, 2}, {1, 3}]


def test_packing_finds_neighbours_all_over_the_table(spark):
    r = np.random.default_rng(6)
    topics = [[f"{chr(97 + t)}{chr(97 + k % 26)}{k}" for k in range(80)] for t in range(16)]
    rows = [(d * 16 + t, " ".join([*r.choice(topics[t], 30), *r.choice(["the", "of", "and", "to"], 20)])) for d in range(32) for t in range(16)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(32), queries.vocabulary("word_bpe_49k.json"), window=512, shard_tokens=8000).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p.doc_id % 16)
    several = [w for w in windows.values() if len(w) > 1]
    assert len({s >> 20 for s in windows}) > 2  # more than one shard
    assert np.mean([max(w.count(t) for t in w) / len(w) for w in several]) > 0.8


def test_packing_scores_with_all_terms_and_the_counts_of_all_documents():
    r = np.random.default_rng(7)
    words = [np.sort(r.zipf(1.3, 60) % 500).astype(np.uint64) for _ in range(100)]
    names = np.arange(500, dtype=np.uint64)
    df = np.array([sum(int(w in set(x.tolist())) for x in words) for w in range(500)]) * 7 + 2
    shard = packing.Shard(words, 1.2, 0.75, packing.Counts(10_000, 45.0, names, df))
    for seed in (0, 17, 99):
        score = np.zeros(100)
        for w in set(words[seed].tolist()):
            tf = np.array([(x == w).sum() for x in words])
            score += np.log1p((10_000 - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 60 / 45.0))
        shard.used[seed] = True
        got = shard.neighbours(seed)
        shard.used[seed] = False
        assert set(got) == set(np.flatnonzero(score)) - {seed} and np.all(np.diff(score[got]) <= 1e-9)


def test_packing_does_not_depend_on_what_a_worker_did_before(spark, monkeypatch):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in r.permutation(400)[:60]) for _ in range(40)]
    path = queries.vocabulary("word_bpe_49k.json")

    def packed(encoder):
        ids = [encoder.encode([t])[0] for t in texts]
        return packing.pack_shard([len(x) for x in ids], ids, 512)

    want = packed(packing.WordEncoder(path))
    other = packing.WordEncoder(path)
    other.encode([" ".join(f"w{k}" for k in reversed(range(400)))])
    assert packed(other) == want
    monkeypatch.setattr(packing, "REMEMBERED", 100)  # now it forgets in the midst of a shard
    assert packed(other) == want
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = packing.pack(rows, path)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "MapInArrow" not in plan


def test_toxicity_held_out(spark):
    d = SF_SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in scored if r.toxic], [r.score for r in scored if not r.toxic]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)


def test_toxicity_finds_gapped_insults_and_bears_odd_rows(spark):
    plain = "the river rose and you know the road stayed open near the market of the town".split()
    rows = [(f"{' '.join(plain[i:])} you {w} {' '.join(plain[:i])}", 1) for i in range(12) for w in ("snorkelhead", "gribblefop")]
    rows += [(" ".join(plain[i:] + plain[:i]) + f" word{chr(97 + i)}x", 0) for i in range(12)] + [(" ".join(plain[::-1][i:]), 0) for i in range(8)]
    machine = toxicity.train(rows)
    texts = [(1, "you snorkelhead"), (2, "you snorkqelhead"), (3, "you s.n.o.r.k.e.l.h.e.a.d"), (4, "s n o r k e l h e a d"), (5, "the road to the market"), (6, ""), (7, None), (None, "the town")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash")), machine).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4, 5, 6, 7, None)] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    assert toxicity.train([("only clean", 0)]) is None and toxicity.train([]) is None
    none = toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), None).collect()
    assert {r.predicted for r in none} == {0}


def test_toxicity_learns_from_every_labelled_row(spark):
    """the pipeline's machine came from at most 1200 toxic and 2400 clean rows. Copies and held-out rows add nothing."""
    plain = "the river rose and you know the road stayed open near the market of the town".split()
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"{' '.join(plain[i % 9 :])} {letters(i)}way {('snorkelhead', 'gribblefop')[i % 2] if i < 1900 else 'road'}", int(i < 1900)) for i in range(6000)]
    rows += [(6000 + i, t, y) for i, (_, t, y) in enumerate(rows[1800:2000]) if zlib.crc32(str(1800 + i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "no id"), (9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9001, 1), (9002, 1), (1, None)], "doc_id long, toxic int")
    learnt = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(y for _, y in learnt) > 1200 and sum(1 - y for _, y in learnt) > 2400
    got, want = toxicity.fit(docs, labels), toxicity.train(learnt)
    assert np.allclose(got.weights, want.weights, atol=1e-6)
    assert np.allclose([got.offset, got.slope, got.shift], [want.offset, want.slope, want.shift], atol=1e-6)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    odd = toxicity.train([("gribblefop", 1), ("...", 0)])
    assert odd is not None and np.isfinite(odd.offset)


def test_toxicity_tells_letters_of_every_script_apart():
    first = lambda w: {(int(f), round(float(v), 9)) for _, fs, vs in toxicity.features([w]) for f, v in zip(fs, vs, strict=True)}
    for a, b in (("дурак", "жхуич"), ("白痴", "朋友"), ("ab", "cd")):
        assert toxicity.plain(a) == a and not first(a) & first(b), a
    for a, b in (("été", "ètè"), ("हिन", "हीन")):
        assert toxicity.plain(a) == a and len(first(a) & first(b)) < len(first(a)) / 2, a
    assert toxicity.words_of("你是白痴") == toxicity.words_of("你.是白痴") and "白痴" in toxicity.words_of("你是白痴")
    for clean, insult in (("река дома город поле мост дорога рынок зима вода лес", "дуракин"), ("河 水 城 市 道路 市場 冬 天 橋 梁", "白痴"), ("νερο δρομος πολη αγορα χειμωνας γεφυρα", "βλακας")):
        words = clean.split()
        gap = "" if insult == "白痴" else " "
        turned = [gap.join(words[i:] + words[:i]) for i in range(len(words))]
        machine = toxicity.train([(gap.join([t, insult, t]), 1) for t in turned] + [(t, 0) for t in turned] + [(gap.join([t, t]), 0) for t in turned])
        bad, good = toxicity.Scorer(machine).strongest([gap.join([t, insult]) for t in turned]), toxicity.Scorer(machine).strongest([gap.join([t, words[0]]) for t in turned])
        assert bad.min() > 0 > good.max()


def test_toxicity_trains_on_texts_that_only_begin_and_end_alike():
    head, tail = "the river rose in the night and by morning the lower fields were under water again " * 2, " and the road to the market stayed open as the farmers had said it would all winter" * 2
    rows = [(f"{head}gribblefop{tail}", 1), (f"{head}bridge{tail}", 0)]
    assert toxicity.train(rows) is not None and toxicity.train(rows[::-1]) is not None


def test_html_main_text(spark):
    field = html_extract.train([c for p in html_extract.LABELLED for c in html_extract.labelled(p, False)] * 3)
    right = total = 0
    for p in html_extract.LABELLED:
        blocks = html_extract.blocks_of(p)
        labels = field.decode(blocks)
        right += sum(b.main == bool(y) for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right / total > 0.95
    page = "<body><nav><a href=/>Home</a></nav><article><h1>One</h1><p>A &amp;amp; b&nbsp; c<br>d, as it goes on and on for a while.<p>Two <b>bold</b> words &lt;p&gt;, and the text goes on.</article><script>var x='</p>'</script><footer>© me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "plain < text"), (1, "u", page), (4, "x", "<p" * 500)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), field).collect()
    assert len(got) == 6
    text = next(r.text for r in got if r.page_id == 1)
    assert text == "One\n\nA &amp; b c d, as it goes on and on for a while.\n\nTwo bold words <p>, and the text goes on."
    assert all(r.n_chars == len(r.text) for r in got) and all(r.text == "" for r in got if r.page_id in (2, 3))


def test_html_unseen_elements_end_where_they_end():
    texts = lambda page: [b.text for b in html_extract.blocks_of(page)]
    for gap in ("<svg-icon></svg-icon>", "<video-js id=a>", "<template-x>", "<svg/>", '<svg viewBox="0 0 1 1" />', "<math/>", "<video src=a>", "<canvas>", "<noscript>", "<object data=a>",
                "<svg><title>no</title></svg>", "<SVG a=b/>no</svg>", "<svg><svg><text>no</text></svg><text>no</text></svg>", "<svg>no<svg/>no</svg>", "<style-guide></style-guide>",
                "<script>a='<svg>'</script >", "<svg><style>a:'</svg>'</style>no</svg>", "<template><p>no</p></template>", "<textarea>no<svg></textarea>"):
        assert texts(f"<p>one</p>{gap}<p>two</p>") == ["one", "two"], gap
    assert texts("<p>one</p><video src=a><p>two</p><video src=b>no</video><p>three") == ["one", "two", "three"]
    assert texts("<p>one</p><script>no <p>two</p>") == ["one"] and texts("<p>one</p><style>no") == ["one"]
    assert texts("<svg>" * 20_000 + "<p>one") == ["one"]


def test_html_viterbi_is_the_best_chain():
    import itertools

    field = html_extract.Field()
    field.steps = np.array([[0.5, -0.2], [0.1, 0.7]])
    scores = [1.0, -2.0, 0.3, 0.4, -0.1]
    field.emission = lambda blocks: scores
    value = lambda ys: sum(s * y for s, y in zip(scores, ys, strict=True)) + sum(field.steps[a, b] for a, b in itertools.pairwise(ys))
    assert value(field.decode([None] * 5)) == max(value(ys) for ys in itertools.product((0, 1), repeat=5))


def test_packing_of_odd_rows(spark):
    """Null ids, repeated rows, empty and very long texts, clashing names: every row's ids are packed once."""
    library = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    long = " ".join(f"{'abcdefg'[k % 7]}{k} café 日本" for k in range(30_000))
    rows = [(None, "no id"), (None, None), (None, "no id"), (1, long), (2, ""), (2, ""), (3, "same id"), (3, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("leaf", F.lit(1)).withColumn("shard", F.lit(None))
    pieces = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), shard_tokens=1000).collect()
    tokens = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    for name in {d for d, _ in rows}:
        want = [n for (d, _), n in zip(rows, tokens, strict=True) if d == name]
        got = [p for p in pieces if p.doc_id == name]
        assert sum(p.length for p in got) == sum(want)
        assert sorted(p.doc_tokens for p in got if p.start == 0) == sorted(want)
    ids = np.array([*library.encode(long, add_special_tokens=False).ids, 2], "<u4")
    parts = sorted((p for p in pieces if p.doc_id == 1), key=lambda p: p.start)
    assert len(ids) > 10 * 4096 and [p.ids_crc32 for p in parts] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts]


def test_packing_counts_documents_of_each_token(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(_odd(spark).select("doc_id", "text")).repartition(3)
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()]
    learnt = packing._learnt(docs, path, 2, 50)
    encoded = packing._encoded(docs, path, spark.sparkContext.broadcast(learnt))
    total, held, df = packing._counts(encoded, len(learnt.number), learnt.width)
    assert learnt.width == "<u2" and total == len(ids) and held == sum(map(len, ids))
    want = np.zeros(len(df), int)
    for x in ids:
        want[list(set(x))] += 1
    assert np.array_equal(df, want)
    assert sorted(r.ids for r in encoded.collect()) == sorted(np.array(x, "<u2").tobytes() for x in ids)


def test_toxicity_remembers_words_between_tasks():
    """op6: each task met all its words again; and the faster reading gives the same words."""
    weights = np.random.default_rng(1).normal(size=toxicity._SIZE).astype(np.float32)
    machine = toxicity.Machine(weights, -0.3)
    scorer = toxicity._scorer(machine)
    texts = [" Plain words, and w o r d s set apart. ", "a b c", "x a b", "", None, "\x1ctab\tand  spaces　Ärger ", "long" * 30, "日本語 text"]
    got = scorer.strongest(texts)
    for text, margin in zip(texts, got, strict=True):
        best = -2.0
        for w in toxicity.words_of(text):
            w = toxicity.plain(w)
            long = len(w) > toxicity.LONGEST
            parts = [w[k : k + toxicity.LONGEST] for k in range(0, len(w) - toxicity.LONGEST // 2, toxicity.LONGEST // 2)] if long else [w] if w else []
            best = max([best, *machine.margins(parts)]) if parts else best
        assert margin == np.clip(best, -2, 2)
    assert "words" in toxicity.words_of(texts[0]) and toxicity.words_of("a b c")[-1] == "abc"
    same = toxicity.Machine(weights.copy(), -0.3, 5.0, 1.0)
    assert toxicity._scorer(same) is scorer and len(scorer.seen) > 5
    assert toxicity._scorer(toxicity.Machine(weights, 0.3)) is not scorer
