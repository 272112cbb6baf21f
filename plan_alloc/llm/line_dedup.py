"""Fuzzy line deduplication by MinHash.

Lines are the parts of a text between line feeds. Equal lines are one node; a
line's signature is one-permutation MinHash over its character shingles (empty
slots filled from the next one that isn't), cut into bands. Lines that share a
band are candidates, verified by the exact Jaccard similarity of their shingle
sets; the components of the verified links (distributed union-find) are the
classes. Of each class the line that stands first (smallest document id, then
line number) is kept, all others are removed.

A bucket's lines are first compared with its smallest one. Small buckets that
still hold different classes then make all their pairs; the lines of large ones
are joined by their rarest shingles instead (``rare_shingle_pairs``), which loses
no pair at the threshold. Before, each is compared with a few lines of the largest
classes that it shares such shingles with (``_gathered``): classes that this joins
make no pairs.

A pair at the threshold shares a band with a chance of over 0.99 (``BANDS``
bands of ``ROWS`` slots). Lines are told apart by a 64-bit hash. Blank lines are
kept, and so are all lines of rows with a null id; a line of fewer characters
than a shingle is its own only shingle. Null texts stay null. A document whose
lines are all removed keeps its row with an empty text. Rows that repeat an id
are parts of one document: of equal lines with equal numbers all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import in_arrow, keep, map_batches, small, text_bytes
from plan_alloc.llm.components import bucket_components

SHINGLE, ROWS, BANDS = 8, 5, 14
CROWDED = 16  # members of a bucket of different classes that still make all their pairs
CELL_BITS = 20  # of a shingle's hash: cells of the table that tells common shingles from rare ones
GATHERED = 2  # rounds in which they are compared with a line of a larger class before
ASKED = 4  # lines of larger classes that they are compared with in a round
SHARED = 3  # rare shingles that lines of a crowded bucket must share to be compared
REMEMBERED = 400_000  # characters of lines whose shingles a task keeps
SIGNED = 200_000  # lines that a task remembers as signed
SLOTS = ROWS * BANDS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def points(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lines given as UTF-8 bytes and their offsets, and the offsets in those."""
    if not len(flat) or flat.max() < 128:
        return flat, offsets
    raw = flat.tobytes()
    try:
        text = raw.decode()
        before = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:  # broken bytes: each line on its own
        lines = [raw[a:z].decode(errors="replace") for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        text, before = "".join(lines), np.cumsum([0, *map(len, lines)])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), before


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines given as one array of code points and their
    offsets, in order, repeats included; and the number of the line of each."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    # Rolling sums over SHINGLE = 8 characters by doubling; short lines are padded with zeros.
    wide = np.maximum(size, SHINGLE)
    x = flat.astype(np.uint64) + np.uint64(1)
    short = size < SHINGLE
    if short.any():
        x = np.insert(x, np.repeat(offsets[1:][short], SHINGLE - size[short]), 0)
    x = np.append(x, np.zeros(SHINGLE, np.uint64))
    for step, factor in zip((1, 2, 4), _FACTORS, strict=True):
        x[:-step] = x[:-step] * factor + x[step:]
    # A line's last seven places begin no shingle.
    of = np.repeat(np.arange(n), wide - SHINGLE + 1)
    return _mix(x[np.arange(len(of)) + (SHINGLE - 1) * of]), of


def bands(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Band keys (line, band) of lines given as one array of code points and their offsets."""
    n = len(offsets) - 1
    h, of = shingle_hashes(flat, offsets)
    slot = ((h >> np.uint64(32)) * np.uint64(SLOTS)) >> np.uint64(32)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(n * SLOTS, none, np.uint64)
    np.minimum.at(low, of * SLOTS + slot.astype(np.int64), h)
    low = low.reshape(n, SLOTS)
    # An empty slot takes the next filled one's value, changed by how far that is.
    place = np.where(low != none, np.arange(SLOTS), 4 * SLOTS)
    place = np.hstack([place, place + SLOTS])
    place = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    far = (place - np.arange(SLOTS)).astype(np.uint64)
    filled = low[np.arange(n)[:, None], place % SLOTS] + far * _ODD
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key * _ODD + filled[:, r::ROWS])
    return key.view(np.int64)


def _lines(docs: DataFrame) -> DataFrame:
    """id, at, line, h: the lines that are not blank."""
    every = docs.where("id is not null and text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    # Most lines begin with a visible ASCII character and need no pattern.
    return every.where(F.ascii("line").between(33, 126) | F.col("line").rlike(r"(?U)\S")).withColumn("h", F.xxhash64("line"))


def _shared(batches):
    """Rows of (node, bucket), sorted by bucket and node, whose bucket has other nodes too, each once."""
    node, bucket, told = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether it was given
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.concatenate([node, batch.column(0).to_numpy()])
        bucket = np.concatenate([bucket, batch.column(1).to_numpy()])
        new = np.append(True, (np.diff(bucket) != 0) | (np.diff(node) != 0))
        node, bucket = node[new], bucket[new]
        same = bucket[1:] == bucket[:-1]
        out = np.append(False, same) | np.append(same, False)
        out[0] &= not told
        told = bool(out[-1]) if len(node) > 1 else told
        yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(bucket[out])], ["node", "bucket"])
        node, bucket = node[-1:], bucket[-1:]


def _jaccard(batches, threshold: float):
    """Keep the pairs whose lines' shingle sets (characters) reach the threshold."""
    known: dict[str, set] = {}
    held = 0  # characters of the lines in ``known``: a line's set takes some 100 bytes a character

    def shingles(t: str) -> set:
        nonlocal held
        s = known.get(t)
        if s is None:
            if held > REMEMBERED:
                known.clear()
                held = 0
            b = t.ljust(SHINGLE, "\0")
            s = known[t] = {b[i : i + SHINGLE] for i in range(len(b) - SHINGLE + 1)}
            held += len(b)
        return s

    for batch in batches:
        good = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = shingles(a), shingles(b)
            lo, hi = sorted((len(a), len(b)))
            both = len(a & b) if lo >= threshold * hi else 0
            good.append(both >= threshold * (lo + hi - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _shingled(batch: pa.RecordBatch):
    """Some lines (h, c, line) at a time: the lines, their different shingles line by line, and the number of the line of each."""
    lengths = np.diff(text_bytes(batch.column(2))[1])
    ends = np.flatnonzero(np.diff(np.cumsum(lengths) // 500_000, append=-1)) + 1
    for at, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        part = batch.slice(at, end - at)
        h, of = shingle_hashes(*points(*text_bytes(part.column(2))))
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.append(True, (np.diff(of) != 0) | (h[1:] != h[:-1]))
        yield part, h[new], of[new]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _commonness(lines: DataFrame) -> np.ndarray:
    """How often shingles stand in the lines (h, c, line), summed over the cells of a table of fixed size."""

    def count(batches):
        n = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, h, _ in _shingled(batch):
                n += np.bincount(_cells(h), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["cell", "n"])

    counted = in_arrow(lines, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return out


def _least(shingles, part: float):
    return F.ceil(shingles * F.lit(part) - F.lit(1e-9))


def _early(threshold: float):
    """Whether a shingle that is one of the first ``SHARED`` two lines share leaves enough after it in both."""
    after = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    return after >= _least(F.col("sa") + F.col("sb"), threshold / (1 + threshold)) - SHARED


def _largest(probe: DataFrame, turn: int) -> DataFrame:
    """Of each shingle that stands in several components a line of the one with most lines: shingle, b, cb, sb, pb."""
    # One number, so that Spark sums up by hashing: the component's lines, then the commonest line (after
    # the first turn of a fourth of them, another one each turn).
    order = F.shiftleft("lines", 31) + F.col("common")
    if turn:
        order += F.when(F.xxhash64("node", F.lit(turn)) % 4 == 0, 1 << 30).otherwise(0)
    first = [F.max_by(x, order).alias(y) for x, y in (("node", "b"), ("c", "cb"), ("size", "sb"), ("at", "pb"))]
    return probe.groupBy("shingle").agg(*first, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").drop("lo", "hi")


def _sized(of: DataFrame) -> DataFrame:
    """node, c, lines: how many lines the component has (written)."""
    return keep(of.join(of.groupBy("c").agg(F.count(F.lit(1)).alias("lines")), "c"), "gathered_parts")


def _moved(of: DataFrame, links: DataFrame) -> DataFrame:
    """node, c: each component takes the name of the weightiest one that it is linked to, by its
    lines and those linked to it, if that is weightier. Lines of one name are connected,
    though not all that are connected share one."""
    linked = links.groupBy(F.col("cb").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    names = of.select("c", "lines").distinct().join(linked, "c", "left").select("c", F.col("lines") + F.coalesce("n", F.lit(0)))
    to = links.select("ca", "cb").distinct().join(names.toDF("ca", "wa"), "ca").join(names.toDF("cb", "wb"), "cb")
    to = to.where(F.struct("wb", "cb") > F.struct("wa", "ca")).groupBy(F.col("ca").alias("c")).agg(F.max(F.struct("wb", "cb")).alias("to"))
    return of.join(to, "c", "left").select("node", F.coalesce("to.cb", "c").alias("c"))


def _gathered(lines: DataFrame, probe: DataFrame, threshold: float, turn: int) -> DataFrame:
    """a, ca, b, cb: links of lines with one of at most ``ASKED`` lines of other components
    each, those that most of their rare shingles lead to (written)."""
    a = probe.select("shingle", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("size").alias("sa"), F.col("at").alias("pa"))
    alike = F.least("sa", "sb") >= F.greatest("sa", "sb") * F.lit(threshold) - F.lit(1e-9)
    met = a.join(_largest(probe, turn), "shingle").where((F.col("ca") != F.col("cb")) & alike & _early(threshold))
    counted = met.groupBy("a", "ca", "b", "cb").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("a", "ca").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b", "cb")), False), 1, ASKED).alias("to"))
    pairs = keep(best.select("a", "ca", F.inline("to")).drop("n"), "gathered_pairs")
    both = pairs.join(lines.select(F.col("h").alias("a"), F.col("line").alias("ta")), "a").join(lines.select(F.col("h").alias("b"), F.col("line").alias("tb")), "b")
    links = in_arrow(both.select("a", "b", "ta", "tb"), lambda it: _jaccard(it, threshold), "a long, b long")
    return keep(pairs.join(links, ["a", "b"], "left_semi"), "gathered")


def rare_shingle_pairs(lines: DataFrame, threshold: float, gather: int = 0) -> DataFrame:
    """a, b: pairs of different components among which are all pairs of the lines
    (h, c: component, line) of Jaccard similarity ``threshold`` or more.

    Prefix filtering. A line's shingles are ordered from the rarest (among these
    lines) to the commonest. Two lines of s <= z shingles that reach the threshold t
    share o >= t/(1+t)*(s+z) of them, which is at least 2t/(1+t)*s and at least t*z.
    The k-th of the shared ones has o - k after it in both lines, so k of them stand
    among the first s - ceil(2t/(1+t)*s) + k of the shorter and the first
    z - ceil(t*z) + k of the longer line. Only these are joined, and a pair counts
    with ``SHARED`` = k of them (all, where o is less). Text that very many lines
    share stands last and is joined by none of them. Any order that is the same for
    all lines loses no pair, so shingles are counted by cells of a table that every
    task can hold. A shingle that stands in one component only is left out before
    the join, and in the join lines of a shingle's largest component aren't held
    against each other.

    ``gather``: rounds in which lines are compared with a few others before, to join
    components. Lines that this connects make no more pairs, so these are no longer
    all pairs at the threshold, but have the same connected components.
    """
    lines = keep(lines.select("h", "c", "line"), "crowded_lines")
    common = lines.sparkSession.sparkContext.broadcast(_commonness(lines))

    def prefixes(batch):
        for part, h, of in _shingled(batch):
            h = h[np.lexsort((h, common.value[_cells(h)], of))]
            many = np.bincount(of, minlength=part.num_rows)
            at = np.arange(1, len(of) + 1) - (np.cumsum(many) - many)[of]
            share = np.bincount(of, np.log2(1 + common.value[_cells(h)]), part.num_rows) / many  # below 64
            first = at <= (many - np.ceil(many * threshold - 1e-9) + SHARED)[of]
            of = of[first]
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), part.column(0).take(rows), pa.array(many[of].astype(np.int32)), pa.array(at[first].astype(np.int32)), pa.array((share[of] * (1 << 20)).astype(np.int32))],
                ["shingle", "node", "size", "at", "common"],
            )

    probe = keep(map_batches(lines, prefixes, "shingle long, node long, size int, at int, common int"), "prefixes")
    of, links = _sized(lines.select(F.col("h").alias("node"), "c")), []
    for turn in range(gather):
        links.append(_gathered(lines, probe.join(small(of), "node"), threshold, turn))
        of = _sized(_moved(of, links[-1]))
    probe = probe.join(small(of), "node")
    main = _largest(probe, gather).select("shingle", F.col("cb").alias("main"))
    probe = keep(probe.join(main, "shingle").withColumn("main", F.col("c") == F.col("main")), "shared_prefixes")
    # Lines of a shingle's largest component meet those of its other components only.
    meets = F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("main")
    short = probe.where(F.col("at") <= F.col("size") - _least(F.col("size"), 2 * threshold / (1 + threshold)) + SHARED)
    a = short.select("shingle", meets, F.col("node").alias("a"), F.col("c").alias("ca"), F.col("size").alias("sa"), F.col("at").alias("pa"))
    b = probe.select("shingle", "main", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("size").alias("sb"), F.col("at").alias("pb"))
    near = (F.col("ca") != F.col("cb")) & (F.struct("sa", "a") < F.struct("sb", "b")) & (F.col("sa") >= F.col("sb") * F.lit(threshold) - F.lit(1e-9))
    shared = _least(F.col("sa") + F.col("sb"), threshold / (1 + threshold))
    met = a.join(b, ["shingle", "main"]).where(near & _early(threshold)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(shared).alias("o"))
    out = met.where(F.col("n") >= F.least(F.lit(SHARED), "o")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for found in links:
        out = out.unionAll(found.select(F.least("a", "b"), F.greatest("a", "b")))
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with repeated and near-repeated lines removed from the text, and
    n_lines, n_removed (columns of these names are replaced)."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = _lines(slim)

    def signed(batches):
        seen: set[int] = set()  # equal lines have equal keys
        for batch in batches:
            h = batch.column(0).to_numpy()
            new = [i for i in np.unique(h, return_index=True)[1].tolist() if int(h[i]) not in seen]
            if len(seen) > SIGNED:
                seen.clear()
            seen.update(h[new].tolist())
            batch = batch.take(pa.array(new, pa.int64()))
            ends = np.cumsum(np.diff(text_bytes(batch.column(1))[1]))
            cuts = np.flatnonzero(np.diff(ends // 2_000_000, append=-1)) + 1
            for at, end in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                part = batch.slice(at, end - at)
                keys = bands(*points(*text_bytes(part.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], ["node", "bucket"])

    # One row per different line, with where it stands first.
    places = keep(lines.select("h", "id", "at"), "line_places")
    firsts = places.groupBy("h").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    # Moved once: a bucket's rows lie side by side, and those of a single line go.
    filed = in_arrow(lines.select("h", "line"), signed, "node long, bucket long").repartition("bucket").sortWithinPartitions("bucket", "node")
    members = in_arrow(filed, _shared, "node long, bucket long")

    texts = None

    def verify(pairs: DataFrame) -> DataFrame:
        nonlocal texts
        pairs = keep(pairs, "line_pairs")
        if texts is None:  # the first pairs, of buckets' smallest lines, hold every line that is asked for
            needed = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
            texts = keep(lines.join(small(needed), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "line_texts")
        # The join on ``a`` comes last: its rows come ordered by ``a``, a bucket's common line.
        both = pairs.join(texts.select(F.col("h").alias("b"), F.col("line").alias("tb")), "b").join(texts.select(F.col("h").alias("a"), F.col("line").alias("ta")), "a")
        return in_arrow(both.select("a", "b", "ta", "tb"), lambda it: _jaccard(it, threshold), "a long, b long")

    def split(full: DataFrame) -> DataFrame:
        return rare_shingle_pairs(texts.join(full.select(F.col("node").alias("h"), "c"), "h"), threshold, GATHERED)

    of = bucket_components(members, verify, split, CROWDED)
    # A line that stands once and has no like is a class of its own.
    classes = firsts.join(of, firsts["h"] == of["node"], "left").where("n > 1 or component is not null")
    classes = keep(classes.select("h", "first", "n", F.coalesce("component", "h").alias("c")), "line_classes")
    best = classes.groupBy("c").agg(F.min("first").alias("best"), F.sum("n").alias("n")).where("n > 1")
    repeated = classes.join(best.select("c", "best"), "c").select("h", "best")
    gone = places.join(repeated, "h").where((F.col("id") != F.col("best.id")) | (F.col("at") != F.col("best.at")))
    gone = gone.groupBy("id").agg(F.collect_set("at").alias("gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The lines are an own column, read twice below, so a text is split once.
    keyed = docs.select(F.struct(*rest).alias("row"), F.col(id_col).cast("long").alias("id"), F.split(text_col, "\n").alias("cut"))
    joined = keyed.join(gone.hint("shuffle_hash"), "id", "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    cut = F.col("cut")
    # By a difference of sets, not a search per line: texts may have very many lines.
    numbers = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), removed)
    kept = F.array_join(F.transform(numbers, lambda i: F.get("cut", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in rest], F.coalesce(F.size(cut), F.lit(0)).alias("n_lines"), F.size(removed).alias("n_removed"))
