"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letter multiset is a binary vector: dimension (letter, j) is set if the
word has the letter more than j times. Words one inserted, deleted or replaced
letter apart have vectors at Hamming distance two or less. The dimensions are
dealt to ``PARTS`` parts; two such vectors differ in two parts at most, so of the
choices of ``PARTS - 2`` parts at least one finds them equal: each choice's
projection is a signature, exact and complete. Words are equi-joined on it, along
with what else such words must share - with m letters in the shorter word, m is
within one of either length, and their first or their last m // 2 letters are
equal - and every pair is verified by its edit distance in the join itself, so
only true pairs are ever written. A signature's rows are split by Spark if they are skewed.
Every join is a shuffled one by hint: Spark takes a table for as large as its compressed
files, without the signatures a word is repeated for, and would broadcast it.

A word's form is its near word of largest count (ties: smallest in code-point
order), if that is at least ``ratio`` times its own count; its root is the end of
the chain of forms, found by pointer jumping (counts rise along a chain, so it
ends, after at most log(largest count, ratio) steps).

Rows that repeat a word count together; a null count is zero. A null word has no
near words and is its own root; an empty word is a word of no letters.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import forget, keep, map_batches

PARTS = 4
#: Letters by how common they are: neighbours in this order go to different parts.
COMMON = "etaoinshrdlucmfwypvbgkjqxz"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)


def letter_parts(words: list[str], parts: int = PARTS) -> np.ndarray:
    """One row a word: a hash of its vector's dimensions in every part."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    key = np.sort(np.repeat(np.arange(len(words)), sizes) << 21 | letters)
    of, letter = key >> 21, key & 0x1FFFFF
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    rank = np.arange(0x110000 if len(letter) and letter.max() >= 256 else 256)
    rank[[ord(c) for c in COMMON]] = range(len(COMMON))
    part = (rank[letter] + nth) % parts
    x = (letter << 32 | nth).astype(np.uint64) * _FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * _FACTORS[1]
    x ^= x >> np.uint64(32)
    out = np.zeros(len(words) * parts, np.uint64)
    np.add.at(out, of * parts + part, x)
    return out.reshape(-1, parts).view(np.int64)


def _keys(m, side: str):
    """The signatures of a word in the class of pairs whose shorter word has ``m`` letters."""
    affix = (F.left if side == "head" else F.right)("word", F.floor(m / 2).cast("int"))
    return [F.xxhash64(F.lit(f"{side} {i} {j}"), F.col("parts")[i], F.col("parts")[j], m, affix) for i, j in itertools.combinations(range(PARTS), PARTS - 2)]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: every pair of different words (of distinct ``word``, ``n``) one edit apart, once."""

    def work(batch):
        parts = letter_parts(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(parts), pa.list_(pa.int64()))], ["word", "n", "parts"])

    filed = map_batches(words.where("word is not null").select("word", "n"), work, "word string, n long, parts array<long>")
    size = F.length("word")
    own = [k for side in ("head", "tail") for k in _keys(size, side)]
    longer = [k for side in ("head", "tail") for k in _keys(size - 1, side)]
    # ``a`` is the shorter word, or the smaller of two of one length.
    a = filed.select(F.explode(F.array(*own)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = filed.select(F.explode(F.array(*own, *longer)).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    apart = F.length("b") - F.length("a")
    met = a.join(b.hint("merge"), "key").where(((apart == 1) | ((apart == 0) & (F.col("a") < F.col("b")))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def group(words: DataFrame, *, word_col: str = "word", count_col: str = "n", ratio: int = 10) -> DataFrame:
    """Per different word: word, form, root, n, n_near (number of near words), form_n (the form's n)."""
    words = words.select(F.col(word_col).cast("string").alias("word"), F.coalesce(F.col(count_col), F.lit(0)).cast("long").alias("n"))
    words = keep(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    end = lambda own, n, other, n_other: F.struct(F.col(own).alias("word"), F.col(n).alias("n"), F.struct((-F.col(n_other)).alias("less"), F.col(other).alias("form")).alias("best"))
    ends = F.explode(F.array(end("a", "n_a", "b", "n_b"), end("b", "n_b", "a", "n_a")))
    # Text order is by bytes in Spark, which is code-point order.
    near = near_pairs(words).select(ends.alias("end")).select("end.*").groupBy("word").agg(F.max("n").alias("own"), F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("own")
    near = keep(near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    chains = keep(near.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("end"))
        step = chains.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        chains, old = keep(step, "roots"), chains
        forget(old)
        if not chains.where("moved").limit(1).count():
            break
    out = words.join(near.hint("merge"), "word", "left").join(chains.select("word", "root").hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
