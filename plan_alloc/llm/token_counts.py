"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array of symbol ids. In each round every
sequence's lowest-ranked adjacent pair is found and merged at all its places at
once (left to right, not overlapping), for all sequences together; sequences
without a known pair leave. What is left of each sequence are its tokens.

Texts are cut into chunks at places that no pre-token of the vocabulary's split
rule can cross (a single space or line feed between other characters), so equal
chunks are encoded once and looked up afterwards. A text with other white space
or a special token's string is split by the rule itself.

Null text counts as empty; rows are kept as they are (repeats included).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import map_batches

#: The split rule of the byte-level vocabulary, and the byte alphabet's printable ranges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (range(33, 127), range(161, 173), range(174, 256))

#: Chunks remembered by a Python worker at most (about 100 bytes each).
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = {b for r in PRINTABLE for b in r}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge table of a byte-level BPE vocabulary as sorted arrays.

    ``word_end``: the suffix that the vocabulary puts on the last symbol of a word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        word_end = model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + word_end] for s in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged[order]
        # Most pairs of a text are unknown; a bit for each slot finds that without a search.
        self.known = np.zeros(1 << 20, bool)
        self.known[self._slot(self.keys)] = True
        # The first round meets bytes only: its pairs are a table, by left byte,
        # right byte and whether the right one ends the word.
        left = np.repeat(np.arange(256), 512)
        right = np.concatenate([self.first, self.last])[np.tile(np.arange(512), 256)]
        self.first_rank, self.first_place = self.ranks(self.first[left], right)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of each pair; unknown pairs have a rank beyond all."""
        key = left.astype(np.int64) * self.width + right
        rank = np.full(len(key), len(self.keys), np.int32)
        place = np.zeros(len(key), np.int32)
        maybe = np.flatnonzero(self.known[self._slot(key)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == key[maybe]
        rank[maybe[hit]] = self.rank[at[hit]]
        place[maybe[hit]] = at[hit]
        return rank, place

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of each word's."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        none = len(self.keys)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        end = np.append(word[1:] != word[:-1], True)
        ids = np.where(end, self.last[flat], self.first[flat]).astype(np.int32)
        rank, place = np.full(len(ids), none, np.int32), np.zeros(len(ids), np.int32)
        code = flat[:-1].astype(np.int32) * 512 + flat[1:] + 256 * end[1:]
        rank[:-1] = np.where(end[:-1], none, self.first_rank[code])
        place[:-1] = self.first_place[code]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(ids)))
            if low.max() == none:  # words without a known pair are done
                live = np.repeat(low < none, size)
                done.append((word[~live], ids[~live]))
                word, ids, rank, place = word[live], ids[live], rank[live], place[live]
                low, size = low[low < none], size[low < none]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # A run of hits at neighbouring places is one symbol repeated: every second one merges.
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)
            if not fresh.all():
                head = hit[fresh][np.cumsum(fresh) - 1]
                hit = hit[(hit - head) % 2 == 0]
            ids[hit] = self.merged[place[hit]]
            left = np.ones(len(ids), bool)
            left[hit + 1] = False
            word, ids, rank, place = word[left], ids[left], rank[left], place[left]
            # Only the pairs that a merged symbol is part of are new.
            hit = hit - np.arange(len(hit))
            new = np.concatenate([hit, hit[hit > 0] - 1])
            inner = new[new < len(ids) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[hit] = none
            rank[inner], place[inner] = self.ranks(ids[inner], ids[inner + 1])
        word = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Counter:
    """Counts the tokens of texts, remembering those of the chunks met so far."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials)))
        self.seen: dict[str, int] = {}

    def chunks(self, text: str) -> list[str] | None:
        """Pieces whose pre-tokens can be found apart: one for each space or line
        feed, a line feed staying at its front. None if the text has other white
        space, white space next to white space or at an end, or special strings."""
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        if len(pieces) != len(text.split()) or any(s in text for s in self.merges.specials):
            return None
        return pieces

    def count_whole(self, text: str) -> int:
        parts = self.special.split(text) if self.merges.specials else [text]
        words = [w.encode() for p in parts for w in self.split.findall(p)]
        return int(self.merges.encode(words)[1].sum()) + len(parts) - 1

    def learn(self, chunks: set[str]) -> None:
        fresh = chunks.difference(self.seen)
        if len(self.seen) + len(fresh) > REMEMBERED:
            self.seen.clear()
            fresh = chunks
        fresh = list(fresh)
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            # Those after a line feed have no space in front; each is found again
            # by the mark before it, as no chunk has white space elsewhere.
            for mark, of in ((" ", [c for c in part if c[0] != "\n"]), ("\n", [c for c in part if c[0] == "\n"])):
                if not of:
                    continue
                words = self.split.findall(" " + " ".join(of) if mark == " " else "".join(of))
                n = self.merges.encode([w.encode() for w in words])[1]
                first = np.flatnonzero(np.fromiter((w[0] == mark for w in words), bool, len(words)))
                # The line feed itself is a token: it counts with what follows it.
                self.seen.update(zip(of, np.add.reduceat(n, first).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text (None: 0)."""
        split = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*(c for c in split if c)))
        get = self.seen.__getitem__
        # The mark in front of a text's first chunk is not the text's own.
        return [self.count_whole(t) if c is None else sum(map(get, c)) - 1 if c else 0 for t, c in zip(texts, split, strict=True)]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit.

    ``vocabulary``: path of a byte-level BPE file, readable on every executor.
    Special tokens' strings in a text count as one token each. One pass over the
    input, no shuffle; a task holds one Arrow batch in slices of 2 MB of text.
    """

    def work(batch: pa.RecordBatch):
        counter = _COUNTERS.get(vocabulary) or _COUNTERS.setdefault(vocabulary, Counter(vocabulary))
        texts, total = batch.column(1), []
        slice_, held = [], 0
        for t in texts:
            t = t.as_py()
            slice_.append(t)
            held += len(t or "")
            if held > 2_000_000:
                total += counter.count(slice_)
                slice_, held = [], 0
        total += counter.count(slice_)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_batches(rows, work, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
