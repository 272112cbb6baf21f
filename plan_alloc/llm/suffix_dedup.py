"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier (smaller id, or earlier in the same text). Three steps, all exact:

1. Anchors. Of each string of ``length`` bytes the q-gram with the least hash is
   its anchor; equal strings have equal anchors. Neighbouring starts with one
   anchor form a run, and runs are dealt out by the anchor's hash. Of runs with
   the same bytes (told apart by 128 bits of hash) all but the first are repeats.
2. Refinement. What first runs of one anchor but different bytes share is found
   on their bytes: suffixes are put into buckets by their first eight bytes, and
   the buckets are refined by sorting on the bucket identifiers at later offsets
   (8, 16, 32 ... bytes on), each round using the identifiers of the last, until
   suffixes in one bucket agree in ``length`` bytes. Of a bucket all but the
   first start are repeats.
3. Removal. A text's repeated starts are gathered and its covered bytes cut out.

A task combines equal runs before anything is dealt out. Anchors that are very
common (found on a sample; a wrong guess costs time only) are salted by their
run's bytes; their buckets from different tasks are then merged by the string.

Null texts count as empty. Rows with a null id lose nothing and repeat nothing.
Rows that repeat an id are told apart by their texts; equal ones are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plan_alloc.llm.common import in_arrow, keep, small, text_bytes

GRAM = 32
PART = 1_000_000  # bytes of text handled at a time in a task
CHUNK = 4_000_000  # bytes of runs refined at a time
_F = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text number, first start, starts, anchor hash."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets) - (length - 1)
    size[size < 0] = 0
    if not size.sum():
        return none, none, none, none
    x = flat.astype(np.uint64) + np.uint64(1)
    step = 1
    for factor in _F:  # 32 = 2 ** 5
        x = x[:-step] * factor + x[step:]
        step *= 2
    x = (x ^ (x >> np.uint64(31))) * _F[0]
    x ^= x >> np.uint64(29)
    window = length - GRAM + 1
    low = (x >> np.uint64(32) << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: -(window - width)], low[window - width :])
    text = np.repeat(np.arange(len(size)), size)
    start = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(first, len(at)))
    return text[first], start[first], count, x[at[first]].view(np.int64)


def refine(flat: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """For texts at ``start`` of ``size`` bytes in ``flat``: the bucket of every
    position's suffix, equal for suffixes that agree in ``length`` bytes (-1:
    fewer bytes are left)."""
    n = len(flat)
    left = np.zeros(n, np.int64)  # bytes from here to the text's end
    text = np.repeat(np.arange(len(size)), size)
    place = start[text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    left[place] = start[text] + size[text] - place
    # First buckets: eight bytes, read as a number.
    head = np.zeros(n, np.uint64)
    for i in range(8):
        head[: n - i] = (head[: n - i] << np.uint64(8)) | flat[i:].astype(np.uint64)
    bucket = np.full(n, -1, np.int64)
    live = np.flatnonzero(left >= 8)
    bucket[live] = np.unique(head[live], return_inverse=True)[1]
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        live = np.flatnonzero(left >= depth + step)
        members = np.bincount(bucket[live], minlength=1) if len(live) else np.zeros(1, np.int64)
        new = np.full(n, -1, np.int64)
        # Suffixes alone in their bucket are settled; the others are sorted on the
        # identifier of the bucket that their later bytes are in.
        alone = members[bucket[live]] == 1
        many = live[~alone]
        pair = bucket[many] * (np.int64(n) + 1) + bucket[many + step]
        new[many] = np.unique(pair, return_inverse=True)[1]
        base = int(new[many].max()) + 1 if len(many) else 0
        new[live[alone]] = base + np.arange(int(alone.sum()))
        # Positions too near the end keep out of this depth, but not of look-ups
        # at their own: every look-up above stays within the text by ``left``.
        bucket, depth = new, depth + step
    return bucket


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the stretches of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    begin = np.flatnonzero(edge == 1)
    return begin, np.flatnonzero(edge == -1) - begin


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Per row: id, n_bytes, spans (removed runs of bytes), kept (the remaining bytes)."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated_ids = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    rows = rows.withColumn("copy", F.xxhash64("text") if repeated_ids else F.lit(0).cast("long"))
    named = rows.where("id is not null").select("id", "copy", "text")

    def anchored(batches):
        for batch in batches:
            lengths = np.diff(text_bytes(batch.column(2))[1])
            at = size = 0
            for i in range(len(lengths)):
                size += int(lengths[i])
                if size < PART and i + 1 < len(lengths):
                    continue
                part = batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
                flat, offsets = text_bytes(part.column(2))
                text, start, count, key = anchors(flat, offsets, length)
                if not len(text):
                    continue
                data = flat.tobytes()
                digest = xxhash.xxh3_64_intdigest
                seg = np.array([digest(data[a:z]) for a, z in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
                ids, copies = part.column(0).to_numpy(), part.column(1).to_numpy()
                lo = start - offsets[:-1][text]
                order = np.lexsort((lo, copies[text], ids[text], seg, key))
                same = np.append(False, (key[order][1:] == key[order][:-1]) & (seg[order][1:] == seg[order][:-1]))
                repeat = np.zeros(len(order), bool)
                repeat[order] = same  # an equal run stands earlier in this part
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, seg, ids[text], copies[text], lo.astype(np.int32), count.astype(np.int16), repeat)], ["key", "seg", "id", "copy", "lo", "n", "again"])

    schema = "key long, seg long, id long, copy long, lo int, n short, again boolean"
    # Common anchors, by a sample of the documents.
    drawn = in_arrow(named.where(F.pmod(F.xxhash64("id"), F.lit(64)) == 0), anchored, schema)
    drawn = keep(drawn.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "anchor_sample")
    total = drawn.agg(F.sum("n")).first()[0] or 0
    common = small(drawn.where(F.col("n") > max(64, total / 2000)).select("key", F.lit(64).alias("salts")))
    found = in_arrow(named, anchored, schema).join(common, "key", "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod("seg", "salts")).otherwise(F.lit(0)).cast("int")
    # Repeats within a part are settled: they are dealt out evenly, by document.
    group = F.when(F.col("again"), F.xxhash64("id")).otherwise(F.col("key"))
    dealt = found.select(group.alias("key"), "seg", "id", "copy", "lo", "n", "again", salt.alias("salt"), F.col("salts").isNotNull().alias("hot"))
    anchor = Window.partitionBy("key", "salt", "again")
    before = F.lag("seg").over(anchor.orderBy("seg", "id", "copy", "lo"))
    marked = dealt.withColumns({"repeat": F.col("again") | F.coalesce(before == F.col("seg"), F.lit(False)), "lo_seg": F.min("seg").over(anchor), "hi_seg": F.max("seg").over(anchor)})
    marked = marked.where(F.col("repeat") | F.col("hot") | (F.col("lo_seg") != F.col("hi_seg")))
    runs = keep(marked.select("key", "id", "copy", "lo", "n", "repeat", "hot"), "runs")

    # First runs, with their bytes, by anchor; common anchors in salted parts.
    lists = runs.where("not repeat").groupBy("id", "copy").agg(F.collect_list(F.struct("key", "lo", "n", "hot")).alias("runs"))

    def cut_out(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py().encode()
                part = batch.column(3)[i].values
                lo, n = part.field(1).to_numpy(), part.field(2).to_numpy()
                who = [pa.array(np.full(len(lo), batch.column(c)[i].as_py()), pa.int64()) for c in (0, 1)]
                bytes_ = pa.array([data[a:z] for a, z in zip(lo.tolist(), (lo + n + length - 1).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.field(0), part.field(3), *who, pa.array(lo, pa.int32()), bytes_], ["key", "hot", "id", "copy", "lo", "bytes"])

    pieces = in_arrow(named.join(lists.hint("shuffle_hash"), ["id", "copy"]).select("id", "copy", "text", "runs"), cut_out, "key long, hot boolean, id long, copy long, lo int, bytes binary")
    pieces = pieces.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(F.lit(0)))
    pieces = pieces.repartition("key", "salt").sortWithinPartitions("hot", "key")

    def refined(batches):
        held, size = [], 0
        for batch in batches:
            at = 0
            keys, hot = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            lengths = np.diff(text_bytes(batch.column(5))[1])
            # A chunk ends where a key ends, or anywhere among common keys.
            for i in range(batch.num_rows):
                if size >= CHUNK and (hot[i] or keys[i] != last):
                    yield from _repeats(pa.Table.from_batches([*held, batch.slice(at, i - at)]), length)
                    held, size, at = [], 0, i
                size += int(lengths[i])
                last = keys[i]
            held.append(batch.slice(at))
        if held:
            yield from _repeats(pa.Table.from_batches(held), length)

    result = keep(in_arrow(pieces.select("key", "hot", "id", "copy", "lo", "bytes"), refined, "id long, copy long, lo int, n int, h1 long, h2 long"), "refined")
    merged = result.where("h1 is not null").withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id", "copy", "lo"))).where("r > 1")
    spans = runs.where("repeat").select("id", "copy", "lo", F.col("n").cast("int").alias("n")).unionAll(result.where("h1 is null").select("id", "copy", "lo", "n")).unionAll(merged.select("id", "copy", "lo", "n"))
    spans = spans.groupBy("id", "copy").agg(F.collect_list(F.struct("lo", "n")).alias("starts"))

    def cut(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py().encode()
                starts = batch.column(2)[i]
                if not starts.is_valid:
                    out.append((len(data), [], data))
                    continue
                lo, n = starts.values.field(0).to_numpy().astype(np.int64), starts.values.field(1).to_numpy()
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, lo + n + length - 1, -1)
                gone = np.cumsum(step)[:-1] > 0
                begin, many = _runs(gone)
                out.append((len(data), [{"begin": int(b), "bytes": int(m)} for b, m in zip(begin, many, strict=True)], np.frombuffer(data, np.uint8)[~gone].tobytes()))
            size, found_, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(found_, pa.list_(pa.struct([("begin", pa.int64()), ("bytes", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    joined = rows.join(spans.hint("shuffle_hash"), ["id", "copy"], "left").select("id", "text", "starts")
    cleaned = in_arrow(joined, cut, "id long, n_bytes long, spans array<struct<begin: long, bytes: long>>, kept binary")
    return cleaned.withColumnRenamed("id", id_col)


def _repeats(runs: pa.Table, length: int):
    """Starts of a chunk of runs whose string stands earlier in the chunk; of
    common anchors also the first starts, with 128 bits of hash of the string."""
    runs = runs.combine_chunks()
    hot, ids, copies, lo = (runs.column(c).to_numpy() for c in ("hot", "id", "copy", "lo"))
    flat, offsets = text_bytes(runs.column("bytes").chunk(0) if runs.num_rows else pa.array([], pa.binary()))
    size = np.diff(offsets)
    if not len(size):
        return
    bucket = refine(flat, offsets[:-1], size, length)
    starts = size - (length - 1)
    run = np.repeat(np.arange(len(size)), starts)
    ends = np.cumsum(starts)
    inner = np.arange(len(run)) - np.repeat(ends - starts, starts)
    where = offsets[:-1][run] + inner
    place = lo[run].astype(np.int64) + inner
    order = np.lexsort((place, copies[run], ids[run], bucket[where]))
    sorted_ = bucket[where][order]
    repeat = np.zeros(len(order), bool)
    repeat[order] = np.append(False, sorted_[1:] == sorted_[:-1])
    # Neighbouring starts of a run are one row.
    edge = np.append(True, (run[1:] != run[:-1]) | (repeat[1:] != repeat[:-1]))
    head = np.flatnonzero(edge)
    many = np.diff(np.append(head, len(repeat)))
    take = repeat[head]
    at, n = head[take], many[take]
    none = pa.nulls(len(at), pa.int64())
    names = ["id", "copy", "lo", "n", "h1", "h2"]
    yield pa.RecordBatch.from_arrays([pa.array(ids[run[at]]), pa.array(copies[run[at]]), pa.array(place[at].astype(np.int32)), pa.array(n.astype(np.int32)), none, none], names)
    first = np.flatnonzero(~repeat & hot[run])
    if len(first):
        data = flat.tobytes()
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[w : w + length]) for w in where[first].tolist()), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[run[first]]), pa.array(copies[run[first]]), pa.array(place[first].astype(np.int32)), pa.array(np.ones(len(first), np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names)
