"""Lexical retrieval packing.

Texts are read and tokenized once; everything after works on the token ids, which
are written in two bytes each (four for vocabularies above 65 536 tokens). The
terms of the lexical search are the vocabulary's tokens, so the document
frequencies of the whole table are one small array, bounded by the vocabulary.

Documents are dealt into index shards by lexical likeness, wherever in the table
they stand: a tree of cuts through the main directions of a sample's weighted
tokens gives each its place, they are sorted by it (the one shuffle), and a shard
is a run of that order of about ``shard_tokens`` tokens. Document frequencies and
the mean length are counted over all documents.

A shard has a BM25 inverted index over the tokens of its documents. The packer
opens a window of ``window`` tokens with a seed (what was cut off the last
document, else the first unused document), asks the index, with all tokens of the
seed, for the unused documents nearest to it and fills the window with them,
nearest first; the one that does not fit is cut at the window's end and seeds the
next. So windows are full but for a shard's last, which is cut into sequences
whose lengths are powers of two and need no padding. A seed is not asked against
other shards than its own.

Work and memory per task are bounded by the shard and its longest document, and
shards are independent. Sequence ids hold the shard's number in the high bits.

Null text counts as empty (its end token is packed); a null id is kept; repeated
rows are packed each on their own, their order among themselves being that of the
written rows; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import pickle
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import in_arrow, keep, ship
from plan_alloc.llm.token_counts import Merges

#: Fixed value: the split rule of the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids a Python worker remembers at most.
REMEMBERED = 600_000
#: White space for Python but not for the vocabulary's split rule; such texts are encoded whole.
_SEPARATORS = "\x1c", "\x1d", "\x1e", "\x1f"
_WIDE = regex.compile("[^\x00-\xff]")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plain(text: str | None) -> str:
    """The text, in lower case if all its characters are Latin-1: as the vocabulary
    does, and these characters have no other form."""
    text = text or ""
    return text if not text.isascii() and _WIDE.search(text) else text.lower()


class WordEncoder:
    """The tokenizer library's ids, each distinct word encoded once.

    The vocabulary drops white space and no token crosses it, so a text's ids are
    those of its words one after another. Words of Latin-1 characters, whose
    normal form is their lower case, are merged in numpy batches; all others go
    through the library itself. Both give the library's ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.split = regex.compile(SPLIT)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {"": 0}
        self.start, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, each given once and none empty."""
        joined = "  ".join(words)  # no piece of the split crosses a space
        rest = []
        if _WIDE.search(joined) or any(x in joined for x in self.merges.specials):
            latin, rest = [], []
            for w in words:
                (rest if _WIDE.search(w) or any(x in w for x in self.merges.specials) else latin).append(w)
            words, joined = latin + rest, "  ".join(latin)
        n = len(words) - len(rest)
        flat, size = [self.flat], [self.size]
        if n:
            pieces = self.split.findall(joined.lower())  # of as many characters
            ids, parts = self.merges.encode([p.encode() for p in pieces])
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))[:n])
            of = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), side="left")
            flat.append(ids)
            size.append(np.bincount(of, parts, n).astype(np.int64))
        for w in rest:
            flat.append(self.ids(w))
            size.append(np.array([len(flat[-1])]))
        self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words)), strict=True))
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text, whatever was encoded before."""
        if len(self.seen) > REMEMBERED:
            self.clear()
        split = pc.utf8_split_whitespace(pa.array([plain(t) for t in texts], pa.large_string()))
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        every = pc.list_flatten(split).dictionary_encode()
        words = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [words[i] for i in missing]
            self.learn(new)
            at[missing] = [*map(self.seen.__getitem__, new)]
        at = at[every.indices.to_numpy(zero_copy_only=False)]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])  # ids before each word
        flat = self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        out = np.split(flat, total[ends])[: len(texts)]
        return [self.ids(t) if t and any(c in t for c in _SEPARATORS) else x for t, x in zip(texts, out, strict=True)]


class Counts:
    """Of all documents: how many, their mean number of terms, and how many hold a term (1 if not given)."""

    def __init__(self, total: int, mean: float, words: np.ndarray, documents: np.ndarray):
        order = np.argsort(words, kind="stable")
        self.total, self.mean, self.words, self.documents = total, mean, words[order], documents[order]

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.documents[at], 1)


class Shard:
    """BM25 over the documents of a shard; retrieval of unused neighbours.

    ``counts``: those of all documents (else the shard's own are taken).
    """

    def __init__(self, words: list[np.ndarray], k1: float, b: float, counts: Counts | None = None):
        self.n = n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        flat = np.concatenate(words).astype(np.int64) if n else np.zeros(0, np.int64)
        held = np.bincount(flat) > 0
        names = np.flatnonzero(held)
        key, tf = np.unique((np.cumsum(held) - 1)[flat] * n + np.repeat(np.arange(n), sizes), return_counts=True)
        self.term, self.doc = key // max(1, n), key % max(1, n)
        own = np.bincount(self.term, minlength=len(names))  # postings of each term
        self.end = np.cumsum(own)
        self.own = own
        df = own if counts is None else np.maximum(counts.of(names), own)
        total, mean = (n, sizes.mean() if n else 1.0) if counts is None else (max(counts.total, n), counts.mean)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * sizes / max(1.0, mean))
        self.weight = idf[self.term] * tf * (k1 + 1) / (tf + norm[self.doc])
        # Terms of many documents as rows of all documents' weights.
        common = np.flatnonzero(own > n / 8) if n > 64 else np.zeros(0, np.int64)
        self.row = np.full(len(names), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n))
        at = np.flatnonzero(self.row[self.term] >= 0)
        self.rows[self.row[self.term[at]], self.doc[at]] = self.weight[at]
        self.of = np.argsort(self.doc, kind="stable")  # postings by document
        self.at = np.searchsorted(self.doc[self.of], np.arange(n + 1))
        self.used = np.zeros(n, bool)
        self.next = 0

    def first_unused(self) -> int | None:
        while self.next < self.n and self.used[self.next]:
            self.next += 1
        return self.next if self.next < self.n else None

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term with the seed, best first (ties: earlier first)."""
        terms = self.term[self.of[self.at[seed] : self.at[seed + 1]]]
        score = self.rows[self.row[terms[self.row[terms] >= 0]]].sum(0)
        terms = terms[(self.row[terms] < 0) & (self.own[terms] > 1)]
        size = self.own[terms]
        if len(terms):
            ends = np.cumsum(size)
            hits = np.arange(ends[-1]) + np.repeat(self.end[terms] - ends, size)
            score = score + np.bincount(self.doc[hits], self.weight[hits], self.n)
        score[self.used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(sizes: list[int], words: list[np.ndarray], window: int, k1: float = 1.2, b: float = 0.75, counts: Counts | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard, in sequence order."""
    shard, pieces = Shard(words, k1, b, counts), []
    sequence = offset = 0
    seed, start = shard.first_unused(), 0  # start: what of the seed is packed already
    queue: list[int] = []
    while seed is not None:
        shard.used[seed] = True
        doc, queue = seed, []
        asked = False
        while doc is not None:
            length = min(sizes[doc] - start, window - offset)
            pieces.append((doc, start, length, sequence, offset))
            offset, start = offset + length, start + length
            if offset == window:
                sequence, offset = sequence + 1, 0
                if start == sizes[doc]:
                    doc, start = None, 0
                break
            start = 0
            if not asked:
                queue, asked = shard.neighbours(seed)[::-1].tolist(), True
            doc = queue.pop() if queue else None
            if doc is not None:
                shard.used[doc] = True
        seed = doc if doc is not None else shard.first_unused()
    # The last window: from the front, sequences of the largest powers of two.
    last = [p for p in pieces if p[3] == sequence] if offset else []
    pieces = pieces[: len(pieces) - len(last)]
    free = 0
    for doc, begin, length, _, _ in last:
        while length:
            if not free:
                whole, place = 1 << (offset.bit_length() - 1), 0
                free, offset = whole, offset - whole
            take = min(length, free)
            pieces.append((doc, begin, take, sequence, place))
            begin, length, free, place = begin + take, length - take, free - take, place + take
            if not free:
                sequence += 1
    return pieces


class Places:
    """Where documents stand in an order of lexical likeness, learnt from the token ids of a sample.

    A document is the sum of its tokens' vectors (the sample's main directions of
    tokens weighted by rarity); a binary tree cuts the sample at the median of its
    main direction until few are left, and documents of a leaf stand along its own.
    """

    def __init__(self, bags: list[np.ndarray], tokens: int, *, most: int = 8192, axes: int = 32, leaf: int = 32):
        r = np.random.default_rng(5)
        df = np.zeros(tokens, np.int64)
        for b in bags:
            df[b] += 1  # a repeated index counts once
        names = np.flatnonzero(df > 1)
        names = names[np.argsort(-df[names], kind="stable")][:most]
        self.number = np.full(tokens, len(names), np.int32)  # the last: other tokens
        self.number[names] = np.arange(len(names))
        idf = np.log((len(bags) + 0.5) / (df[names] + 0.5)).astype(np.float32)
        x = np.zeros((len(bags), len(names)), np.float32)
        for i, b in enumerate(bags):
            x[i] = np.bincount(self.number[b], minlength=len(names) + 1)[:-1]
        x *= np.maximum(idf, 0)
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        axes = min(axes, *x.shape)
        self.vectors = np.zeros((len(names) + 1, max(1, axes)), np.float32)
        if axes:
            q = r.standard_normal((len(names), axes)).astype(np.float32)
            for _ in range(4):
                q = np.linalg.qr(x.T @ (x @ q))[0]
            self.vectors[:-1] = q * np.maximum(idf, 0)[:, None]
        y = self._unit(x @ q) if axes else np.zeros((len(bags), 1))
        self.direction, self.cut, self.child = [], [], []

        def grow(rows: np.ndarray) -> int:
            node = len(self.cut)
            part = y[rows]
            d = np.zeros(y.shape[1])
            if len(part) > 1:
                d = np.linalg.svd(part - part.mean(0), full_matrices=False)[2][0]
                d *= np.sign(d[np.argmax(np.abs(d))])
            along = part @ d
            cut = float(np.median(along)) if len(part) else 0.0
            self.direction.append(d)
            self.cut.append(cut)
            self.child.append((-1, -1))
            low = along < cut
            if len(part) > leaf and low.any():
                self.child[node] = (grow(rows[low]), grow(rows[~low]))
            return node

        grow(np.arange(len(y)))
        self.direction, self.cut, self.child = np.array(self.direction), np.array(self.cut), np.array(self.child)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))

    @property
    def width(self) -> str:
        """The type that holds a token id."""
        return "<u2" if len(self.number) <= 1 << 16 else "<u4"

    def of(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Leaf (like ones have near numbers) and place along it of each document."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        x = np.zeros((len(ids), self.vectors.shape[1]))
        weights = self.vectors.T.copy()
        # Some documents at a time, so that their tokens stay near the processor.
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // 65_536, append=-1)) + 1
        for at, end in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
            some = at + np.flatnonzero(size[at:end])
            if len(some):
                tokens = self.number[np.concatenate(ids[at:end])].astype(np.intp)
                first, weight = np.cumsum(size[some]) - size[some], np.empty(len(tokens), np.float32)
                for axis in range(len(weights)):
                    np.take(weights[axis], tokens, out=weight, mode="clip")  # unbuffered; all are in range
                    x[some, axis] = np.add.reduceat(weight, first)
        x = self._unit(x)
        node = np.zeros(len(ids), np.int64)
        while True:
            along = (x * self.direction[node]).sum(1)
            to = self.child[node, (along >= self.cut[node]).astype(int)]
            if (to < 0).all():
                return node, along
            node = np.where(to < 0, node, to)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(vocabulary: str) -> WordEncoder:
    return _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, WordEncoder(vocabulary))


def _parts(column: pa.Array):
    """The texts in pieces of about 4 MB."""
    part, size = [], 0
    for t in column:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size > 4_000_000:
            yield part
            part, size = [], 0
    if part:
        yield part


#: Characters of a sampled text from which the order of likeness is learnt. It bounds
#: the sample alone: every document is placed and packed by its whole text.
SAMPLED = 20_000


def _learnt(rows: DataFrame, vocabulary: str, end_id: int, sample: int) -> Places:
    """The order of likeness, from the ``sample`` texts of least hash. Only hashes are
    ordered, and only what is learnt reaches the driver, not the texts: one task
    learns it, from ``sample`` times ``SAMPLED`` characters at most."""
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    last = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = hashed.where(F.col("h") <= F.lit(last).cast("long")).select("h", F.substring("text", 1, SAMPLED).alias("text"))

    def learn(batches):
        texts = sorted({(h, t) for b in batches for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}, key=lambda x: (x[0], x[1] or ""))
        encoder = _encoder(vocabulary)
        places = Places(encoder.encode([t for _, t in texts]), max(encoder.library.get_vocab_size(), end_id + 1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(places)], pa.binary())], ["places"])

    found = in_arrow(drawn.repartition(1), learn, "places binary").collect()
    return pickle.loads(found[0].places) if found else Places([], end_id + 1)


def _encoded(rows: DataFrame, vocabulary: str, places) -> DataFrame:
    """doc_id, ids, leaf, along, h, row: the one pass over the texts (written)."""

    def run(batches):
        encoder, row = _encoder(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            first = 0
            for part in _parts(batch.column(1)):
                ids = encoder.encode(part)
                leaf, along = places.value.of(ids)
                held = batch.slice(first, len(part))
                packed = [x.astype(places.value.width).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([held.column(0), pa.array(packed, pa.binary()), pa.array(leaf), pa.array(along), held.column(2), pa.array(range(row, row + len(ids)), pa.int64())], ["doc_id", "ids", "leaf", "along", "h", "row"])
                first, row = first + len(part), row + len(part)

    return keep(in_arrow(rows.withColumn("h", F.xxhash64("text")), run, "doc_id long, ids binary, leaf long, along double, h long, row long"), "packing_ids")


def _counts(encoded: DataFrame, tokens: int, width: str) -> tuple[int, int, np.ndarray]:
    """Documents, their tokens, and how many documents hold each token: at most one
    row for each token of the vocabulary and task, summed by Spark."""

    def run(batches):
        df, docs, held = np.zeros(tokens, np.int64), 0, 0
        for batch in batches:
            for x in batch.column(0):
                ids = np.frombuffer(x.as_buffer(), width)
                docs, held = docs + 1, held + len(ids)
                df[ids] += 1  # a repeated index counts once
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int64()), pa.array([*df[some].tolist(), docs, held], pa.int64())], ["token", "n"])

    sums = {r.token: r.n for r in in_arrow(encoded.select("ids"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    docs, held = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(tokens, np.int64)
    df[list(sums)] = list(sums.values())
    return docs, held, df


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, shard_tokens: int = 2_000_000, sample: int = 4096) -> DataFrame:
    """Pieces of all documents' token ids (text, then ``end_id``) in sequences of
    at most ``window``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``sample``: texts from which the order of likeness is learnt.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = rows.sparkSession
    ship(spark)
    learnt = _learnt(rows, vocabulary, end_id, sample)
    tokens, width = len(learnt.number), learnt.width
    encoded = _encoded(rows, vocabulary, spark.sparkContext.broadcast(learnt))
    total, held, df = _counts(encoded, tokens, width)
    counts = spark.sparkContext.broadcast(Counts(total, held / max(1, total), np.arange(tokens), df))

    def packed(shard: int, names: list[int | None], terms: list[np.ndarray]) -> pa.RecordBatch:
        ids = [np.append(x, end_id).astype("<u4") for x in terms]
        pieces = pack_shard([len(x) for x in ids], terms, window, counts=counts.value)
        doc, start, length, sequence, offset = (list(x) for x in zip(*pieces, strict=True))
        crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n in zip(doc, start, length, strict=True)]
        columns = [[names[d] for d in doc], start, length, crc, [len(ids[d]) for d in doc], [(shard << 20) + x for x in sequence], offset]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        shard, names, terms, n = TaskContext.get().partitionId() << 20, [], [], 0
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                terms.append(np.frombuffer(x, width))
                n += len(terms[-1]) + 1
                if n >= shard_tokens:
                    yield packed(shard, names, terms)
                    shard, names, terms, n = shard + 1, [], [], 0
        if names:
            yield packed(shard, names, terms)

    order = ["leaf", "along", "doc_id", "h", "row"]
    # Partitions of several shards, as each ends with a short one.
    dealt = encoded.repartitionByRange(1 + (held + total) // max(1, min(8_000_000, 16 * shard_tokens)), *order).sortWithinPartitions(*order)
    # Written once: a task that runs again can't mix two packings in what is read.
    return keep(in_arrow(dealt.select("doc_id", "ids"), run, SCHEMA), "packed")
