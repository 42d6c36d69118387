"""Operator 10, toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The kernel compares two words by the three-character subsequences that they share, gaps allowed and discounted, so that
letters put in, left out or spaced apart cost similarity but do not hide a word. Gaps are bounded, hence a word has few
subsequences and the kernel is a product of sparse vectors. A word that is like a landmark is also looked at without its odd
characters (one left out, a digit read as a letter), so that an inserted character costs it nothing; this look goes over pieces of
``PIECE`` characters that overlap by half (most words are one piece), so that its work grows as the word does. Landmarks are words picked from the labelled training texts, the
telling ones of the toxic class (unlike each other) and the clean words nearest to them. A sentence is described by its
best kernel value with each landmark, mapped by the inverse root of the landmarks' own kernel matrix (Nyström); a linear
support vector machine with squared hinge loss is trained on labelled sentences: all sentences of clean documents, and those
of toxic documents, which are picked anew in each round as the ones that the machine finds worst. A document's margin is that
of its worst sentence; a logistic curve fitted to the training documents makes it a score.

Training reads at most ``TRAIN_TOXIC`` + ``TRAIN_CLEAN`` labelled documents, chosen by a hash of their id, never held-out ones, and
of these at most ``TRAIN_BYTES`` of text: the bound of the one task that fits the model; the driver gets the model alone. Landmarks have
at most ``LANDMARK_CHARS`` characters and are chosen among the ``TELLING`` most telling words, their clean neighbours among ``CLEAN_WORDS``
words. These bound the fit alone.
Scoring reads every whole text; languages, sources, labels and ids are no input of it.

Defined cases: a null or empty text gets the score of a text without any telling word; repeated rows score alike; of training rows
that share an id the least text is used; null labels are not used; without a label of both classes every score is the share of the toxic class (0 without labels); other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import keep, release, staged, table

TRAIN_TOXIC, TRAIN_CLEAN = 2500, 4000  #: bounds of the training sample, in documents
TRAIN_BYTES = 256 << 20  #: bound of their texts
CLEAN_WORDS = 60_000  #: most frequent clean words among which those near to a landmark are looked for
TELLING = 4000  #: most telling words among which landmarks are chosen
LANDMARK_CHARS = 40  #: longest word that can be a landmark
PIECE = 64  #: characters of a word that are looked at together for odd ones; more than a landmark and its spare characters
CUT = 0.3  #: score from which a document is predicted toxic
DECAY = 0.6  #: discount of each skipped character
REACH = 5  #: farthest distance of a subsequence's last character from its first
FLOOR = 0.5  #: kernel values below this count as none
SCREEN = 0.3  #: a word with no more of its (squared) weight in the landmarks' subsequences counts as unlike all of them
CLOSE, ALIKE = 0.4, 0.95  #: kernel values between which a word is looked at for odd characters
SPARE, GAIN = 2, 0.05  #: how many, and the least that leaving one out must gain
SURPRISE = 6.0  #: standard deviations above chance from which a word can be a landmark
LANDMARKS, NEAR = 64, 8  #: toxic landmarks, and clean ones near them

# The alphabet of the kernel; 63 stands for any other character, 0 for none.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789^$áàâäéèêëíìîïóòôöúùûüñçßæ"
CODES = {c: k + 1 for k, c in enumerate(ALPHABET)}
LETTERS, DIGITS = ALPHABET[:26], ALPHABET[26:36]
EDGES = " \t\n\r.,;:!?\"'()[]{}<>*_#|&%$/\\-–—«»“”‘’…"
SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)|\n")
INNER = re.compile(r"[\W_]+")
STEPS = [(d, e, DECAY ** (d + e - 2)) for d in range(1, REACH) for e in range(1, REACH + 1 - d)]


def units(sentence: str) -> list[str]:
    """Words of a lower-cased sentence, and runs of three or more single characters put together."""
    words = sentence.split()
    single = [len(w) == 1 for w in words]
    out = words
    if sum(single) >= 3:
        run = ""
        out = list(words)
        for w, s in [*zip(words, single), ("", False)]:
            if s:
                run += w
            else:
                if len(run) >= 3:
                    out.append(run)
                run = ""
    return out


def forms(word: str) -> list[str]:
    """What the kernel sees of a word: without the marks around it, and also without marks inside it."""
    bare = word.strip(EDGES)
    if bare.isalpha():
        return [bare] if len(bare) >= 2 else []
    plain = INNER.sub("", bare)
    return [x for x in dict.fromkeys((bare, plain)) if len(x) >= 2]


def variants(word: str) -> list[str]:
    """A word with any one character left out, and with any one digit read as any letter."""
    out = [word[:k] + word[k + 1 :] for k in range(len(word))]
    digits = [k for k, c in enumerate(word) if c in DIGITS]
    if len(digits) < len(word):
        out += [word[:k] + c + word[k + 1 :] for k in digits for c in LETTERS]
    return [x for x in out if len(x) >= 2]


def pieces(word: str) -> list[str]:
    """A word of up to ``PIECE`` characters itself; of a longer one pieces that overlap by half."""
    if len(word) <= PIECE:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


def coded(words: list[str], width: int) -> np.ndarray:
    """Characters of the words between their edges, by the alphabet; 0 behind a word's end."""
    text = "".join([f"^{w}$".ljust(width, "\0") for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(points, len(TABLE) - 1)].reshape(len(words), width)


TABLE = np.full(0x180, 63, np.int32)
TABLE[0] = 0
TABLE[[ord(c) for c in CODES]] = list(CODES.values())


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each distance of the second and third character: the subsequences of all rows, and their weight.

    Where a row has ended the third character, and with it the last six bits, are 0.
    """
    first, second = codes << 12, codes << 6
    width = codes.shape[1]
    for d, e, weight in STEPS:
        if (n := width - d - e) > 0:
            what = first[:, :n] | second[:, d : d + n]
            what |= codes[:, d + e :]
            yield what, weight


def sparse(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, value), summed, with every row of length 1."""
    keys, weights = [], []
    for what, weight in subsequences(coded(words, width)):
        row, column = np.nonzero(what & 63)
        keys.append(row.astype(np.int64) << 18 | what[row, column])
        weights.append(np.full(len(row), weight))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(inverse, np.concatenate(weights), len(key))
    row = key >> 18
    norm = np.sqrt(np.bincount(row, value * value, len(words)))
    return row, key & (1 << 18) - 1, (value / norm[row]).astype(np.float32)


@dataclass
class Kernel:
    """Kernel values with fixed landmarks."""

    landmarks: list[str]
    telling: int | None = None  #: how many of them, from the first, are of the toxic class (None: all)
    place: np.ndarray = field(init=False)  #: row of ``matrix`` of each subsequence; row 0 is empty
    matrix: np.ndarray = field(init=False)
    known: np.ndarray = field(init=False)  #: whether a subsequence is in any landmark


    def __post_init__(self) -> None:
        row, what, value = sparse(self.landmarks, max(map(len, self.landmarks)) + 2)
        names, inverse = np.unique(what, return_inverse=True)
        self.place = np.zeros(1 << 18, np.int32)
        self.place[names] = np.arange(1, len(names) + 1)
        self.matrix = np.zeros((len(names) + 1, len(self.landmarks)), np.float32)
        self.matrix[inverse + 1, row] = value
        self.known = (self.place > 0).view(np.uint8)

    def values(self, words: list[str], floor: float = FLOOR) -> list[np.ndarray | None]:
        """Of each word the kernel values with all landmarks, those under the floor as 0; None where all are."""
        out: list[np.ndarray | None] = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w) + 2
            by_width.setdefault(8 if n <= 8 else 12 if n <= 12 else 1 << (n - 1).bit_length(), []).append(k)
        for width, group in by_width.items():
            step = max(1, 32768 // width)
            for first in range(0, len(group), step):
                self._some(words, group[first : first + step], width, floor, out)
        return out

    def tolerant(self, words: list[str]) -> list[np.ndarray | None]:
        """:meth:`values`, where a word, or a piece of a long one, that is like a landmark is also seen without its odd characters."""
        cut = [pieces(w) for w in words]
        flat = list(dict.fromkeys(p for some in cut for p in some))
        seen = dict(zip(flat, self._tolerant(flat)))
        long = [w for w in words if len(w) > PIECE]
        whole = dict(zip(long, self.values(long)))
        out = []
        for w, some in zip(words, cut):
            found = [v for v in (seen[p] for p in dict.fromkeys(some)) if v is not None]
            if len(w) > PIECE and whole[w] is not None:
                found.append(whole[w])
            out.append((np.max(found, axis=0) if len(found) > 1 else found[0]) if found else None)
        return out

    def _tolerant(self, words: list[str]) -> list[np.ndarray | None]:
        """:meth:`tolerant` of words of one piece.

        Characters are left out one by one, or a digit read as a letter, each time the one that makes the word likest, ``SPARE``
        times over; what comes out takes part where it is a landmark of the toxic class, or all but one.
        """

        def like(v: np.ndarray | None) -> float:
            return float(v[: self.telling].max(initial=0)) if v is not None else 0.0

        out = self.values(words, CLOSE)
        now = [(k, w, top) for k, (w, v) in enumerate(zip(words, out)) if CLOSE <= (top := like(v)) < ALIKE]
        for _ in range(SPARE):
            forms = {w: variants(w) for _, w, _ in now}
            flat = list(dict.fromkeys(x for many in forms.values() for x in many))
            found = dict(zip(flat, self.values(flat, CLOSE)))
            after = []
            for k, w, top in now:
                likest, best = max(((like(found[x]), x) for x in forms[w]), default=(0.0, ""))
                if likest >= ALIKE:
                    out[k] = np.maximum(out[k], found[best])
                elif likest > top + GAIN:
                    after.append((k, best, likest))
            now = after
        for v in out:
            if v is not None:
                v[v < FLOOR] = 0
        return [v if v is not None and v.any() else None for v in out]

    def _some(self, words: list[str], group: list[int], width: int, floor: float, out: list) -> None:
        some = [words[k] for k in group]
        length = np.fromiter(map(len, some), np.int64, len(some)) + 2
        hit, total = np.zeros(len(some)), np.zeros(len(some))
        for (what, weight), (d, e, _) in zip(subsequences(coded(some, width)), STEPS):
            hit += weight * weight * self.known[what].sum(1)
            total += weight * weight * np.maximum(0, length - d - e)
        close = np.flatnonzero(hit > SCREEN * total)
        if not len(close):
            return
        row, what, value = sparse([some[k] for k in close.tolist()], width)
        at = self.place[what]
        row, at, value = row[at > 0], at[at > 0], value[at > 0]
        found = np.zeros((len(close), self.matrix.shape[1]), np.float32)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        for k in range(0, len(starts), 256):  # some words at a time: the rows gathered for them stay small
            end = starts[k + 256] if k + 256 < len(starts) else len(row)
            first = starts[k]
            found[row[starts[k : k + 256]]] = np.add.reduceat(self.matrix[at[first:end]] * value[first:end, None], starts[k : k + 256] - first)
        found[found < floor] = 0
        for k in np.flatnonzero(found.any(1)).tolist():
            out[group[close[k]]] = found[k]


@dataclass
class Model:
    kernel: Kernel | None
    weights: np.ndarray  #: on the kernel values: the machine's weights behind the Nyström map
    bias: float
    slope: float
    shift: float
    key: str = ""

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


class Scorer:
    """Scores texts; kernel values of words are remembered, up to a bound."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.known: dict[str, np.ndarray | None] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = list(words)
        shapes = [forms(w) for w in new]
        flat = list(dict.fromkeys(x for s in shapes for x in s))
        found = dict(zip(flat, self.model.kernel.tolerant(flat)))
        for w, s in zip(new, shapes):
            best = [v for x in s if (v := found[x]) is not None]
            self.known[w] = (np.maximum(best[0], best[1]) if len(best) > 1 else best[0]) if best else None

    def sentence_values(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Of each text the kernel values of its sentences that have any: the best over a sentence's words."""
        split = [[units(x) for x in SENTENCE.split(t.lower())] for t in texts]
        words: set[str] = set()
        for sentences in split:
            words.update(*sentences)
        self.learn(words)
        get = self.known.get
        out = []
        for sentences in split:
            values: list[np.ndarray] = []
            for words in sentences:
                best = [v for v in map(get, words) if v is not None]
                if best:
                    values.append(np.max(best, axis=0) if len(best) > 1 else best[0])
            out.append(values)
        return out

    def scores(self, texts: list[str]) -> list[float]:
        m = self.model
        if m.kernel is None:
            return [m.score(0.0)] * len(texts)
        out = []
        for values in self.sentence_values(texts):
            margin = m.bias if not values else max(m.bias, float((np.stack(values) @ m.weights).max()) + m.bias)
            out.append(m.score(margin))
        return out


def pick_landmarks(texts: list[str], toxic: np.ndarray) -> tuple[list[str], int]:
    """Words that tell the toxic class, unlike each other, and behind them (their number) the clean words nearest to them."""
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for t, y in zip(texts, toxic):
        seen[int(y)].update({f for w in set(units(t.lower())) for f in forms(w)[-1:]})
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]

    def surprise(a: int, b: int) -> float:
        """Standard deviations by which the toxic share exceeds what both classes alike would give."""
        p = (a + b) / (n[0] + n[1])
        return (a / n[1] - b / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)

    worth = {w: z for w, a in seen[1].items() if a >= 8 and len(w) <= LANDMARK_CHARS and (z := surprise(a, seen[0][w])) >= SURPRISE}
    ranked = sorted(worth, key=lambda w: (-worth[w], w))[:TELLING]
    if not ranked:
        return [], 0
    width = max(map(len, ranked)) + 2
    row, what, value = sparse(ranked, width)
    bounds = np.searchsorted(row, np.arange(len(ranked) + 1))
    vector = np.zeros(1 << 18, np.float32)
    near = np.zeros(len(ranked), np.float32)
    chosen: list[int] = []
    for k in range(len(ranked)):
        if near[k] > 0.7:
            continue
        chosen.append(k)
        a, b = bounds[k], bounds[k + 1]
        vector[what[a:b]] = value[a:b]
        near = np.maximum(near, np.bincount(row, value * vector[what], len(ranked)).astype(np.float32))
        vector[what[a:b]] = 0
        if len(chosen) == LANDMARKS:
            break
    landmarks = [ranked[k] for k in chosen]
    kernel = Kernel(landmarks)
    clean = [w for w, c in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[:CLEAN_WORDS] if len(w) <= LANDMARK_CHARS and (c >= 3 and w not in worth or c >= 2 * seen[1][w])]
    close = [(seen[0][w] * float(v.max()), w) for w, v in zip(clean, kernel.values(clean)) if v is not None and w not in landmarks]
    return landmarks + [w for _, w in sorted(close, key=lambda x: (-x[0], x[1]))[:NEAR]], len(landmarks)


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton's method on the sentences inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = weight / weight.sum()
    shrink = np.full(x1.shape[1], ridge)
    shrink[-1] = 1e-9
    w = np.zeros(x1.shape[1])
    inside = np.ones(len(y), bool)
    for _ in range(30):
        part, own = x1[inside], weight[inside]
        w = np.linalg.solve((part * own[:, None]).T @ part + np.diag(shrink), part.T @ (own * y[inside]))
        now = y * (x1 @ w) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method with a little shrinkage."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    target = np.where(toxic, 1 - 1e-3, 1e-3)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hess, x.T @ (weight * (p - target)) + 1e-3 * w)
    return max(float(w[0]), 1e-3), float(w[1])


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None) -> Model:
    """The model of labelled texts; ``share``: of the toxic class where the texts come from, if they are no fair sample."""
    toxic = np.asarray(toxic, bool)
    share = float(toxic.mean()) if share is None and len(toxic) else (share or 0.0)
    landmarks, telling = pick_landmarks(texts, toxic) if toxic.any() and not toxic.all() else ([], 0)
    if not landmarks:
        return Model(None, np.zeros(0), 0.0, 1.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), "none")
    kernel = Kernel(landmarks, telling)
    scorer = Scorer(Model(kernel, np.zeros(len(landmarks)), 0.0, 1.0, 0.0))
    values = [v for k in range(0, len(texts), 500) for v in scorer.sentence_values(texts[k : k + 500])]
    own = np.stack([v if v is not None else np.zeros(len(landmarks), np.float32) for v in kernel.values(landmarks)])
    own = (own + own.T) / 2
    eigen, basis = np.linalg.eigh(own)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(eigen, 1e-2))) @ basis.T
    rows = [(k, v) for k, mine in enumerate(values) for v in mine]
    of = np.array([k for k, _ in rows], np.int64)
    x = (np.stack([v for _, v in rows]) @ root).astype(np.float64) if rows else np.zeros((0, len(landmarks)))
    bad = toxic[of]
    # Sentences without a telling word are all alike: one row stands for those of the clean documents.
    empty = max(1, sum(len(SENTENCE.split(t)) for t, y in zip(texts, toxic) if not y) - int((~bad).sum()))
    x = np.vstack([x, np.zeros((1, x.shape[1]))])
    y = np.append(np.where(bad, 1.0, -1.0), -1.0)
    use = np.ones(len(y), bool)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(3):
        weight = np.where(use, 1.0, 0.0)
        weight[-1] = min(empty, 4.0 * max(1, int(use[:-1].sum())))
        weight[:-1][y[:-1] > 0] *= max(1.0, weight[y < 0].sum() / max(1.0, weight[y > 0].sum())) / 4
        w, b = train_machine(x, y, weight)
        margin = x @ w + b
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, of, margin[:-1])
        use[:-1] = ~bad | (margin[:-1] > 0) | (margin[:-1] >= worst[of])
    worst = np.full(len(texts), b)
    np.maximum.at(worst, of, margin[:-1])
    fair = np.where(toxic, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    slope, shift = fit_curve(worst, toxic, fair)
    weights = (root @ w).astype(np.float32)
    key = hashlib.sha256(repr(landmarks).encode() + weights.tobytes() + repr((b, slope, shift)).encode()).hexdigest()
    return Model(kernel, weights, b, slope, shift, key)


def held_out(doc_id) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> Model:
    """Fit on a bounded sample: of each class the documents whose ids hash lowest, held-out ones never."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {int(r["toxic"] > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.filter(F.col("toxic") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic_rows), known.filter(F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(clean_rows)]
    ids = some[0].union(some[1]).withColumnRenamed("doc_id", "k")
    # The bounds above are those of this broadcast and of what comes to the driver.
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("k")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over no more rows than the bounds
    bounded = staged(sample.withColumn("upto", upto).filter(F.col("upto") <= TRAIN_BYTES).select("doc_id", "text", "toxic"), "sample")
    share = n.get(1, 0) / max(1, sum(n.values()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), SAMPLE).sort_by("doc_id")
        model = fit(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), np.int64) > 0, share)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del rows, model
        release()  # the worker is used again

    # One task for the bounded sample, away from the driver; it is read from its files, never shuffled into one place.
    fitted = bounded.coalesce(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit([], np.zeros(0, bool), share)


SAMPLE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])


def scorer_of(model: Model) -> Scorer:
    """One scorer a worker process and model: what it remembers outlives a task."""
    return keep(("scorer", model.key), lambda: Scorer(model))


def score_column(model: Model):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(model)
        for texts in batches:
            yield pd.Series(scorer.scores(["" if t is None else t for t in texts]), dtype="float64")

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for b in batches:
            found = scorer.scores(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(found, pa.float64()), pa.array([int(s >= CUT) for s in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    given = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out("doc_id").alias("held_out"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
