"""Toxicity by a subsequence string kernel SVM with Nystroem landmarks.

Kernel: two words are near if they share subsequences of three and four letters,
each weighted by ``DECAY`` for every letter it skips (two at most), so insults
with a letter put in or left out stay near; characters that are not letters fall
out before, digits that stand for letters are read as those, and letters set
apart by spaces are read as one word. Scripts written without spaces are read in
windows of two to four characters. Letters of every script and their marks stand
for themselves (composed, accents not folded); a subsequence is told by a hash
of its code points. So the features are finite, the trained machine folds into
one weight per hash and a text is scored without meeting the landmarks again.

Training, on all labelled rows: words are the examples, not sentences. Clean ones
are all words of the clean texts; of a toxic text it is only known that something
in it is toxic, so the strongest word of each is chosen by the current machine,
and the machine trained again (multiple-instance learning). A text's score is that of its strongest
word, calibrated by a logistic curve. So toxicity that lies only in a phrase of
words which also stand in clean texts is not found.

Null and empty texts have no words and get the score of "no evidence". Repeated
rows are scored alike; null ids are kept, not held out and never trained on.
With no labelled row of either class every score is 0.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from plan_alloc.llm.common import forget, in_arrow, keep, small


DECAY = 0.6
LONGEST = 24  # letters; longer words are read in overlapping windows of this length
REMEMBERED = 600_000  # words whose margin a Python worker remembers at most
_PATTERNS = [(0, *p) for n, width in ((2, 4), (3, 5)) for p in itertools.combinations(range(1, width + 1), n)]
_BITS = 22  # of a subsequence's hash; the landmarks' subsequences fill about a hundredth of that at most
_SIZE = 1 << _BITS
STEPS = 1 << 12  # a coordinate or margin of 1 in training
MOST = 50  # times that a chosen word counts at most
#: Characters read as letters inside a word.
_LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_SPACED = re.compile(r"(?<!\S)(?:\w[ ]){2,}\w(?!\S)")
_APART = re.compile(r" \w \w(?!\S)")  # stands in every match of ``_SPACED`` and is found faster, from its space
_SENTENCE = re.compile(r"[.!?\n。！？]+")
#: Thai, Lao, Burmese, Khmer, kana and Han, written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def plain(word: str) -> str:
    """Letters of a lower-cased word, look-alikes read as letters; empty if it has none."""
    if not word.isalpha():
        word = word.strip(".,;:!?\"'()[]{}*#%&$-_")
        if not word.isalpha():
            word = "".join(filter(letter, word.translate(_LOOKALIKES))) if any(map(str.isalpha, word)) else ""
    return word


def windows(word: str) -> list[str]:
    """Its windows of two to four characters where a script has no spaces, and what stands between."""
    word = "".join(filter(letter, word))
    out = [w for w in _UNSPACED.split(word) if w]
    for run in _UNSPACED.findall(word):
        out += {run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)} or {run}
    return out


def spelled(text: str | None) -> str:
    """The text in lower case and, after it, its words of letters set apart; windows in the place of
    words without spaces. Split at white space, it is the text's words."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if _APART.search(text):
        text = " ".join([text, *(s.replace(" ", "") for s in _SPACED.findall(text))])
    if text.isascii() or not _UNSPACED.search(text):
        return text
    return " ".join(x for w in text.split() for x in (windows(w) if _UNSPACED.search(w) else (w,)))


def words_of(text: str | None) -> list[str]:
    return spelled(text).split()


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words one after another (marked ends), each one's word, and the words' norms.

    The kernel is scaled by the norm of a word of that length whose subsequences all differ.
    """
    coded = ["^" + w + "$" for w in words]
    lens = np.fromiter(map(len, coded), np.int64, len(coded))
    points = np.frombuffer("".join(coded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    norm = np.sqrt(sum(np.maximum(lens - p[-1], 0) * DECAY ** (2 * (p[-1] + 1 - len(p))) for p in _PATTERNS))
    return points, np.repeat(np.arange(len(words)), lens), norm


def features(words: list[str]):
    """Kernel features by pattern: (word number of each, feature of each, their weight)."""
    symbol, word, norm = symbols(words)
    for p in _PATTERNS:
        n = len(symbol) - p[-1]
        if n <= 0:
            continue
        at = np.flatnonzero(word[:n] == word[p[-1] :])
        code = symbol[at]
        for step in p[1:]:
            code = (code << np.uint64(21)) ^ (code >> np.uint64(43)) ^ symbol[at + step]
        of = word[at]
        code = (code ^ (code >> np.uint64(29)) ^ np.uint64(len(p) << 60)) * np.uint64(0x9E3779B97F4A7C15)
        code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield of, (code >> np.uint64(64 - _BITS)).astype(np.int64), DECAY ** (p[-1] + 1 - len(p)) / norm[of]


class Machine:
    """Weights of the subsequences, offset, and the calibration's two numbers."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.offset)
        for at in range(0, len(words), 10_000):  # bounds the arrays of all subsequences
            part = words[at : at + 10_000]
            for word, feature, value in features(part):
                out[at : at + len(part)] += np.bincount(word, self.weights[feature] * value, len(part))
        return out


class Scorer:
    def __init__(self, machine: Machine):
        self.machine, self.seen = machine, {}

    def _margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; of one that is read in several windows their largest."""
        plains = [w if w.isalpha() else plain(w) for w in words]
        parts = list(dict.fromkeys(plains))  # words that differ in marks alone
        known = dict(zip(parts, self._of(parts).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, plains), float, len(plains))

    def _of(self, words: list[str]) -> np.ndarray:
        best = np.full(len(words), -2.0)
        size = np.fromiter(map(len, words), np.int64, len(words))
        of = np.flatnonzero((size > 0) & (size <= LONGEST))
        if len(of):
            best[of] = np.maximum(best[of], self.machine.margins([words[i] for i in of.tolist()]))
        for i in np.flatnonzero(size > LONGEST).tolist():
            w = words[i]
            best[i] = max(-2.0, self.machine.margins([w[k : k + LONGEST] for k in range(0, len(w) - LONGEST // 2, LONGEST // 2)]).max())
        return best

    def learn(self, words: list[str]) -> np.ndarray:
        """Margin of each of the different words."""
        out = np.fromiter(map(self.seen.get, words, itertools.repeat(np.nan)), float, len(words))
        fresh = np.flatnonzero(np.isnan(out))
        if len(fresh) + len(self.seen) > REMEMBERED:
            self.seen.clear()
            fresh = np.arange(len(words))
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            names = [words[i] for i in part.tolist()]
            out[part] = self._margins(names)
            self.seen.update(zip(names, out[part].tolist(), strict=True))
        return out

    def strongest(self, texts: list[str | None]) -> np.ndarray:
        """Margin of each text's strongest word, within -2 and 2."""
        # Arrow's white space is Python's; at a text's ends it may give empty words.
        split = pc.utf8_split_whitespace(pa.array([spelled(t) for t in texts], pa.large_string()))
        every = pc.list_flatten(split).dictionary_encode()
        margin = self.learn(every.dictionary.to_numpy(zero_copy_only=False).tolist())[every.indices.to_numpy(zero_copy_only=False)]
        size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        out = np.full(len(texts), -2.0)
        some = np.flatnonzero(size)
        if len(some):
            out[some] = np.maximum.reduceat(margin, (np.cumsum(size) - size)[some])
        return np.clip(out, -2.0, 2.0)


_SCORERS: list[Scorer] = []


def _scorer(machine: Machine) -> Scorer:
    """The last task's scorer with the words it remembers, if its machine has the same margins."""
    if not (_SCORERS and _SCORERS[0].machine.offset == machine.offset and np.array_equal(_SCORERS[0].machine.weights, machine.weights)):
        _SCORERS[:] = [Scorer(machine)]
    return _SCORERS[0]


class Landmarks:
    """Nystroem map: a word's kernel with each landmark, turned so that its products are the kernel's."""

    def __init__(self, marks: list[str]):
        word, feature, value = (np.concatenate(x) for x in zip(*features(marks), strict=True))
        order = np.argsort(feature, kind="stable")
        self.word, self.feature, self.value = word[order], feature[order], value[order]
        self.names, self.begin, self.times = np.unique(self.feature, return_index=True, return_counts=True)
        self.held = np.zeros(_SIZE, bool)
        self.held[self.names] = True
        self.root = np.eye(len(marks))
        value, vector = np.linalg.eigh(self.kernel(marks) + 1e-6 * np.eye(len(marks)))
        self.root = vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T

    def kernel(self, words: list[str]) -> np.ndarray:
        """Of each word with each landmark."""
        size = len(self.root)
        out = np.zeros(len(words) * size)
        for word, feature, value in features(words):
            hit = np.flatnonzero(self.held[feature])
            if len(hit):
                at = np.searchsorted(self.names, feature[hit])
                times = self.times[at]
                ends = np.cumsum(times)
                mark = np.arange(ends[-1]) + np.repeat(self.begin[at] - ends + times, times)
                out += np.bincount(np.repeat(word[hit] * size, times) + self.word[mark], np.repeat(value[hit], times) * self.value[mark], len(out))
        return out.reshape(len(words), size)

    def of(self, words: list[str]) -> np.ndarray:
        """Coordinates in steps of 1 / ``STEPS`` (and the offset's 1), so that sums of their products
        are exact whatever the order of the words."""
        out = np.full((len(words), len(self.root) + 1), STEPS, np.int16)
        for first in range(0, len(words), 1000):  # bounds the arrays of all subsequences
            x = self.kernel(words[first : first + 1000]) @ self.root
            out[first : first + 1000, :-1] = np.rint(np.clip(x, -2, 2) * STEPS)
        return out

    def machine(self, w: np.ndarray) -> Machine:
        weights = np.zeros(_SIZE)
        np.add.at(weights, self.feature, (self.root @ w[:-1])[self.word] * self.value)
        return Machine(weights.astype(np.float32), float(w[-1]))


def _active(x: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over the words within the margin, of clean words (``n`` is 0) and of chosen ones,
    ``n`` times each: products of the coordinates, then the coordinates. Whole numbers."""
    x = x.astype(float)
    on = np.where(n > 0, 1, -1) * (x @ w) < STEPS
    out = []
    for part, times in ((on & (n == 0), np.ones(len(n))), (on & (n > 0), n)):
        out += [((x[part] * times[part, None]).T @ x[part]).ravel(), times[part] @ x[part]]
    return np.concatenate(out).astype(np.int64)


def _svm(active, size: int, clean: int, chosen: int, ridge: float = 1e-3) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; ``active`` gives the sums of ``_active`` over all
    words. Both classes weigh the same: that of ``clean`` words and that of ``chosen`` ones."""
    w = np.zeros(size)
    clean = max(1, clean)
    keep = np.eye(size) * ridge * 2 * clean
    keep[-1, -1] = 1e-9
    for _ in range(30):
        sums = active(w).astype(float)
        below, above = sums[: len(sums) // 2], sums[len(sums) // 2 :] * clean / max(1, chosen)
        square = (below + above)[: size * size].reshape(size, size) / STEPS**2
        new = np.linalg.solve(keep + square, (above - below)[size * size :] / STEPS)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _odds(toxic, clean, n_toxic: int, n_clean: int, log):
    """How much likelier a word is in toxic texts, more so if it is in many."""
    return log((toxic + 0.1) / (n_toxic + 0.2)) - log((clean + 0.1) / (n_clean + 0.2)) + 0.5 * log(toxic)


def bag(text: str) -> list[str]:
    """Distinct plain words of a text, read by sentences."""
    words = set().union(*map(words_of, _SENTENCE.split(text.lower())))
    return sorted({p for w in words if (p := plain(w))})


def train(rows: list[tuple[str | None, int]], *, landmarks: int = 128, rounds: int = 4) -> Machine | None:
    """Machine from (text, label) rows at hand, by the same steps as ``fit``; None if a class is missing.

    Landmarks: the strongest words of the toxic texts and common clean words.
    """
    # Copies of one text say the same thing once.
    rows = list(dict.fromkeys((t, y) for t, y in rows if t))
    sets = [(bag(t), y) for t, y in rows]
    toxic, clean, heads_t, heads_c = Counter(), Counter(), Counter(), Counter()
    for ws, y in sets:
        (toxic if y else clean).update(ws)
        (heads_t if y else heads_c).update({w[:4] for w in ws})
    bags = [ws for ws, y in sets if y and ws]
    n_clean = sum(1 for _, y in sets if not y)
    if not bags or not n_clean:
        return None
    # First choice of each toxic text's word: by its beginnings, seen in toxic texts and not in clean ones.
    heads = {h: _odds(n, heads_c[h], len(bags), n_clean, np.log) for h, n in heads_t.items()}
    odds = {w: max(heads[w[:4]], _odds(n, clean[w], len(bags), n_clean, np.log) if len(w) > 4 else -np.inf) for w, n in toxic.items()}
    chosen = [max(b, key=lambda w: (odds[w], w)) for b in bags]
    against = sorted(clean)
    common = sorted(clean, key=lambda w: (-clean[w], w))[: landmarks // 4]
    machine, before = None, None
    for _ in range(rounds):
        top = Counter(chosen)
        if top == before:  # the same machine again
            break
        before = top
        marks = Landmarks(_marks(sorted(top, key=lambda w: (-top[w], w))[: landmarks * 3 // 4], common))
        x = marks.of([*against, *top])
        n = np.array([0] * len(against) + [min(k, MOST) for k in top.values()])
        machine = marks.machine(_svm(lambda w: _active(x, n, w), x.shape[1], len(against), int(n.sum())))
        chosen = _strongest(machine, bags, [[clean[w] for w in b] for b in bags])
    margin = Scorer(machine).strongest([t for t, _ in rows])
    machine.slope, machine.shift = _logistic(np.rint(margin * STEPS) / STEPS, np.array([y for _, y in rows], float), np.ones(len(rows)))
    return machine


def _marks(toxic: list[str], common: list[str]) -> list[str]:
    return list(dict.fromkeys(sorted(toxic) + common))


def _strongest(machine: Machine, bags: list[list[str]], clean: list[list[int]]) -> list[str]:
    """Each bag's word of largest margin. Rare words of a toxic text gain nothing by
    chance: clean texts hold the choice down."""
    every = sorted({w for b in bags for w in b})
    known = dict(zip(every, machine.margins(every).tolist(), strict=True))
    return [max((known[w] - 0.05 * c, w) for w, c in zip(b, cs, strict=True))[1] for b, cs in zip(bags, clean, strict=True)]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic curve of the labels over the margins, ``n`` texts each (Newton, lightly held back)."""
    x = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + ridge * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def held_out(id_column) -> "F.Column":
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", landmarks: int = 128, rounds: int = 4) -> Machine | None:
    """Train on all labelled rows that are not held out.

    Words are counted, chosen and summed up by Spark. The driver gets the landmarks,
    the sums of a Newton step (their size is that of the landmarks) and the texts
    counted by margin."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("id"), F.col("toxic").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''").join(small(marked), "id")
    # Copies of one text say the same thing once.
    texts = keep(rows.select(F.sha2("text", 256).alias("key"), "y", "text").dropDuplicates(["key", "y"]), "toxicity_texts")

    def read_words(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                words = pa.array([bag(t) for t in part.column(2).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words], ["key", "y", "words"])

    bags = keep(in_arrow(texts, read_words, "key string, y int, words array<string>"), "toxicity_bags")
    n_toxic, n_clean = bags.agg(F.count_if((F.col("y") == 1) & (F.size("words") > 0)), F.count_if(F.col("y") == 0)).first()
    if not n_toxic or not n_clean:
        forget(texts, bags)
        return None
    counts = [F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")]
    vocab = keep(bags.select("y", F.explode("words").alias("word")).groupBy("word").agg(*counts), "toxicity_words")
    # First choice of each toxic text's word: by its beginnings, seen in toxic texts and not in clean ones.
    heads = bags.select("y", F.explode(F.array_distinct(F.transform("words", lambda w: F.left(w, F.lit(4))))).alias("head")).groupBy("head").agg(*counts).where("toxic > 0")
    by_head = heads.select("head", _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean, F.log).alias("by_head"))
    by_word = F.when(F.length("word") > 4, _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean, F.log))
    known = vocab.where("toxic > 0").join(by_head, F.left("word", F.lit(4)) == F.col("head")).select("word", "clean", F.greatest("by_head", by_word).alias("odds"))
    held = bags.where("y = 1").select("key", F.explode("words").alias("word")).join(known, "word")
    toxic = keep(held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("odds", "word", "clean"))).alias("of")).select(F.col("of.word").alias("words"), F.col("of.clean").alias("clean")), "toxicity_choice")
    forget(bags)
    chosen = toxic.select(F.element_at("words", -1).alias("word"))
    against = vocab.where("clean > 0")
    common = [r.word for r in against.orderBy(F.desc("clean"), "word").limit(landmarks // 4).collect()]
    n_against = against.count()
    machine, before = None, None
    for turn in range(rounds):
        top = keep(chosen.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "toxicity_top")
        if before is not None:
            same = top.join(before, ["word", "n"], "left_anti").isEmpty()
            forget(before)
            if same:  # the same machine again
                break
        before = top
        first = [r.word for r in top.orderBy(F.desc("n"), "word").limit(landmarks * 3 // 4).collect()]
        marks = Landmarks(_marks(first, common))
        examples = _examples(against.select("word", F.lit(0).alias("n")).unionAll(top.select("word", F.least("n", F.lit(MOST)).cast("int"))), marks)
        size = len(marks.root) + 1
        n_chosen = top.agg(F.sum(F.least("n", F.lit(MOST)))).first()[0]
        machine = marks.machine(_svm(lambda w: _summed(examples, w), size, n_against, n_chosen))
        forget(examples)
        if turn < rounds - 1:
            chosen = _choose(toxic, spark.sparkContext.broadcast(machine))
    forget(top, toxic, vocab)
    shipped = spark.sparkContext.broadcast(machine)

    def margins(batches):
        scorer = _scorer(shipped.value)
        for batch in batches:
            for part, held in _parts(batch, 1):
                steps = np.rint(scorer.strongest(part) * STEPS)
                yield pa.RecordBatch.from_arrays([pa.array(steps, pa.float64()), held.column(0)], ["margin", "y"])

    found = in_arrow(texts.select("y", "text"), margins, "margin double, y int").groupBy("margin", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("margin", "y").collect()
    margin, y, n = (np.array(x, float) for x in zip(*found, strict=True))
    forget(texts)
    machine.slope, machine.shift = _logistic(margin / STEPS, y, n)
    return machine


def _examples(words: DataFrame, marks: Landmarks) -> DataFrame:
    """x: the coordinates of each word in two bytes each, n (written)."""
    shipped = words.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        for batch in batches:
            x = shipped.value.of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1)], ["x", "n"])

    return keep(in_arrow(words, run, "x binary, n int"), "toxicity_examples")


def _summed(examples: DataFrame, w: np.ndarray) -> np.ndarray:
    """The sums of ``_active`` over all words, added up by Spark place by place."""

    def run(batches):
        out = 0
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int16).reshape(batch.num_rows, len(w))
                out = out + _active(x, batch.column(1).to_numpy(), w)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(out[some] if len(some) else [], pa.int64())], ["place", "v"])

    sums = in_arrow(examples, run, "place long, v long").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(2 * len(w) * (len(w) + 1), np.int64)
    out[sums.column("place").to_numpy()] = sums.column("v").to_numpy()
    return out


def _choose(toxic: DataFrame, machine) -> DataFrame:
    """word: the strongest of each toxic text."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                yield pa.RecordBatch.from_arrays([pa.array(_strongest(machine.value, part.column(0).to_pylist(), part.column(1).to_pylist()), pa.string())], ["word"])

    return in_arrow(toxic, run, "word string")


def _parts(batch: pa.RecordBatch, at: int):
    """The texts of column ``at`` in pieces of about 2 MB, and their rows."""
    part, size, first = [], 0, 0
    for t in batch.column(at):
        part.append(t.as_py())
        size += len(part[-1] or "") * (3 if part[-1] and not part[-1].isascii() else 1)
        if size > 2_000_000:
            yield part, batch.slice(first, len(part))
            first, part, size = first + len(part), [], 0
    if part:
        yield part, batch.slice(first)


def score(docs: DataFrame, machine: Machine | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted``; other
    columns stay (those names are replaced). One pass, no shuffle."""
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    held = held_out(F.col(id_col))
    if machine is None:
        return docs.select(*rest).withColumns({"held_out": held, "score": F.lit(0.0), "predicted": F.lit(0)})
    shipped = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.select(*rest).schema
    at = rest.index(text_col)

    def run(batches):
        scorer = _scorer(shipped.value)
        for batch in batches:
            for part, held in _parts(batch, at):
                margin = scorer.strongest(part)
                p = 1 / (1 + np.exp(-(shipped.value.slope * margin + shipped.value.shift)))
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(p, pa.float64())], [*batch.schema.names, "score"])

    scored = in_arrow(docs.select(*rest), run, StructType([*schema.fields]).add("score", DoubleType()))
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})
