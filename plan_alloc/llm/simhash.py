"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, Hamming distance verified.

A fingerprint bit is the majority among the 64-bit hashes of a text's word
shingles. Of ``BLOCKS`` blocks of a fingerprint, two that differ in at most
``max_bits`` bits share at least ``BLOCKS - max_bits``; so each fingerprint is
filed under every choice of so many blocks, and two near ones meet in a bucket.
Equal fingerprints are one node. A bucket whose members are many is filed again
under finer choices of its remaining bits, which bounds what one key can hold
(2 ** 12 fingerprints) and loses no pair.

Null and empty texts, and texts without words, have fingerprint zero and are
linked like any other. Rows that repeat an id keep one row each; the class id is
the smallest id reachable. Rows with a null id take part; a class of only such
rows has a null class id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import in_arrow, keep
from plan_alloc.llm.components import bucket_components

BLOCKS = 6
FINE = 8  # parts of the remaining bits in a crowded bucket
CROWDED = 256  # members from which a bucket is filed again


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """Majority bits of the hashes of one text's shingles."""
    if not text:
        return 0
    # bytes.lower and bytes.split know ASCII letters and ASCII white space only.
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    end = np.cumsum(size)
    start = (end - size)[:n].tolist()
    stop = (end[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(line[a:b], seed) for a, b in zip(start[at : at + (1 << 16)], stop[at : at + (1 << 16)], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int((np.packbits(total * 2 > n, bitorder="little").view("<u8"))[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """id, f: the fingerprint of every whole text, as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            f = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], ["id", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, "id long, f long")


def _choices(lo: int, bits: int, blocks: int, chosen: int) -> list[int]:
    """Masks (signed) of every choice of blocks of the bits from ``lo`` on."""
    edges = [lo + round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(a, z)) for a, z in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, chosen)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket(f: Column, masks: list[int]) -> Column:
    """One bucket id per mask: a hash of the mask's number and the fingerprint's bits in it.
    (An equal hash by chance adds a pair to verify and loses none.)"""
    return F.array(*[F.xxhash64(F.lit(i), f.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])


def members_of(reps: DataFrame, max_bits: int, crowded: int = CROWDED) -> DataFrame:
    """bucket, node (a fingerprint) for every bucket of two or more."""
    masks = _choices(0, 64, BLOCKS, BLOCKS - max_bits)
    filed = reps.select(F.col("f").alias("node"), F.posexplode(_bucket(F.col("f"), masks)).alias("choice", "bucket"))
    filed = keep(filed, "buckets")
    sizes = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = filed.join(sizes, "bucket")
    shared = keep(shared, "shared_buckets")
    # In a crowded bucket the bits outside its choice are cut again.
    fine = []
    for i, mask in enumerate(masks):
        free = [b for b in range(64) if not mask >> b & 1]
        parts = [free[round(k * len(free) / FINE) : round((k + 1) * len(free) / FINE)] for k in range(FINE)]
        finer = [mask | sum(1 << b for p in c for b in p) for c in itertools.combinations(parts, FINE - max_bits)]
        fine.append(F.when(F.col("choice") == i, F.transform(F.array(*[F.lit(_signed(m)) for m in finer]), lambda m: F.xxhash64("bucket", m, F.col("node").bitwiseAND(m)))))
    again = shared.where(F.col("n") > crowded).select(F.explode(F.coalesce(*fine)).alias("bucket"), "node")
    return shared.where(F.col("n") <= crowded).select("bucket", "node").unionAll(again)


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id."""
    prints = keep(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "fingerprints")
    reps = prints.groupBy("f").agg(F.min("id").alias("first"))
    near = lambda pairs: pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    of = bucket_components(members_of(reps, max_bits), near)
    classes = reps.join(of, reps["f"] == of["node"], "left").select("f", "first", F.coalesce("component", "f").alias("c"))
    named = classes.groupBy("c").agg(F.min("first").alias("component_id"))
    found = classes.join(named, "c").select("f", "component_id")
    return prints.join(found, "f").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
