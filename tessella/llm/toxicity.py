"""Toxicity scores that see through disguised words.

A noisy channel explains a disguised token: letters were replaced by look-alike
signs, drawn out by repetition, or set apart by spaces and marks. A lattice of
what each sign may stand for is decoded by Viterbi search under a character
trigram model, and the restored word is scored beside the word as it stands.

The score is a logistic regression over the presence of words and word
beginnings in a document. Both models are fitted on all labelled rows that may be
learned from: tasks count trigrams and features and add up gradients, the driver
gets sums only (each Newton step one matrix of the features a task).

Defined cases: a null or empty text has no features and the score of a document
without any; a null doc_id is scored like another; labels with a null or without
a document are left out; of texts that share a doc_id, the first in order is learned
from; where one label is missing, every score is the share of the other; repeated
rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BROADCAST_KEYS, giving_back, small_batches, written

#: Bound of the features kept, and least number of toxic documents that have one.
FEATURES, LEAST_TOXIC = 600, 3
#: Items that a task counts before it hands its counts on, and words whose features it remembers.
HELD_ITEMS, HELD_WORDS = 250_000, 50_000
#: Features of most toxic rows that are sent to the tasks that count the others'.
SENT_FEATURES = 200_000
RIDGE, PART = 0.5, 0.4
THRESHOLD = 0.7
#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 200_000
#: Lengths of the word beginnings that are features.
STARTS = range(4, 10)
#: What a sign may stand for besides itself (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
_LOOKALIKE = frozenset(LOOKALIKES)
_EDGE = "".join(map(chr, range(33, 127))).translate({i: None for i in map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")}) + "«»“”„’‘…¿–—"
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ ._\-][^\W_]){3,}(?!\w)")
_MARKED = re.compile(r"[^\W_](?:[._\-][^\W_]){3,}\Z")
#: Characters that can stand alone between spaces.
_SINGLES = {chr(c) for c in range(0x21, 0x180)}
_DRAWN = re.compile(r"(.)\1\1")
_INNER_MARKS = re.compile(r"[._\-]")


def trigrams(words: Counter) -> Counter:
    """Numbers of the character trigrams of words, ``^`` before and ``$`` after."""
    out: Counter = Counter()
    for w, n in words.items():
        s = "^^" + w + "$"
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


@dataclass
class CharModel:
    """Interpolated character trigrams over words, ``^`` before and ``$`` after."""

    tri: dict = field(default_factory=dict)
    bi: dict = field(default_factory=dict)
    uni: dict = field(default_factory=dict)
    #: What logp gave, up to HELD_ITEMS.
    told: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def fit(cls, words: Counter) -> CharModel:
        return cls.of_trigrams(trigrams(words))

    @classmethod
    def of_trigrams(cls, found: dict) -> CharModel:
        counts = [defaultdict(float) for _ in range(6)]
        for (a, b, c), n in found.items():
            for k, x in zip(range(6), ((a, b, c), (a, b), (b, c), b, c, ""), strict=True):
                counts[k][x] += n
        tri, tri_of, bi, bi_of, uni, all_ = counts
        return cls(
            {x: n / tri_of[x[:2]] for x, n in tri.items()}, {x: n / bi_of[x[0]] for x, n in bi.items()}, {c: n / all_[""] for c, n in uni.items()}
        )

    def logp(self, a: str, b: str, c: str) -> float:
        p = self.told.get((a, b, c))
        if p is None:
            if len(self.told) >= HELD_ITEMS:
                self.told.clear()
            p = math.log(0.8 * self.tri.get((a, b, c), 0.0) + 0.18 * self.bi.get((b, c), 0.0) + 0.0199 * self.uni.get(c, 0.0) + 1e-5)
            self.told[a, b, c] = p
        return p


def options_of(sign: str, run: int) -> list[tuple[str, float]]:
    """What a sign may stand for, each with its cost; ``run``: how many of it came so far without another between."""
    out = [(sign, 0.0 if sign.isalpha() else -6.0)]
    out += [(c, -0.5) for c in LOOKALIKES.get(sign, "")]
    if run > 1:  # one more of the same: drawn out, likelier so the longer it gets
        out.append(("", -5.0 if run == 2 else -0.1))
    if not sign.isalnum():
        out.append(("", -4.0 if sign in LOOKALIKES else -1.0))
    return out


#: What options_of gives for the usual signs; a run of three is as one of more.
_OPTIONS = {(chr(c), run): options_of(chr(c), run) for c in range(33, 127) for run in (1, 2, 3)}


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind a token of letters, look-alikes, repetitions and
    marks: Viterbi over states of the last two characters, of which a sign's few
    options leave some dozens. Of equally likely words, the first in order."""
    states = {("^", "^"): (0.0, "")}
    before, run, told, logp = "", 0, model.told, model.logp
    for sign in token:
        run = run + 1 if sign == before else 1
        before = sign
        options = _OPTIONS.get((sign, run if run < 3 else 3)) or options_of(sign, run)
        if len(options) == 1 and len(states) == 1:
            (((a, b), (p, text)),), ((c, cost),) = states.items(), options
            states = {(b, c): (p + cost + logp(a, b, c), text + c)}
            continue
        following: dict = {}
        for state, (p, text) in states.items():
            a, b = state
            for c, cost in options:
                if c:
                    more = told.get((a, b, c))
                    key, q = (b, c), p + cost + (logp(a, b, c) if more is None else more)
                else:
                    key, q = state, p + cost
                met = following.get(key)
                if met is None or q > met[0] or (q == met[0] and text + c < met[1]):
                    following[key] = (q, text + c)
        states = following
    return min((-p - model.logp(a, b, "$"), text) for (a, b), (p, text) in states.items())[1]


def beginnings(wanted) -> tuple[frozenset, frozenset]:
    """The first four characters of words and word beginnings, and all that these begin with."""
    starts = {x for f in wanted for x in (f[:4], f[:4].rstrip("~"))}
    return frozenset(starts), frozenset(x[:n] for x in starts for n in range(5))


def may_begin(token: str, starts: frozenset, ways: frozenset) -> bool:
    """Whether any reading of a token can begin with one of ``starts``; only then is decoding it of use."""
    reached, before, run = {""}, "", 0
    for sign in token:
        run = run + 1 if sign == before else 1
        before = sign
        options = _OPTIONS.get((sign, min(run, 3))) or options_of(sign, run)
        reached = {p + c for p in reached for c, _ in options if p + c in ways}
        if not reached:
            return False
        if not reached.isdisjoint(starts):
            return True
    return False


def restored(word: str, model: CharModel, wanted: tuple | None = None) -> str | None:
    """The word behind a disguised one (lower case, without outer marks), None where nothing points to a
    disguise, or where no reading can begin as a word of ``wanted`` (what beginnings gave)."""
    if not any(c.isalpha() for c in word):
        return None
    drawn, marked = _DRAWN.search(word), _MARKED.match(word)
    if marked:
        word = _INNER_MARKS.sub("", word)
    if not marked and not drawn and word.isalpha():
        return None
    if not marked and not drawn and _LOOKALIKE.isdisjoint(word):
        return None
    if wanted is not None and not may_begin(word, *wanted):
        return None
    return decode(word, model)


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in STARTS if n <= len(word))] if word else []


class Featurizer:
    """Features of whole texts. Words without any are remembered, so that a text
    costs little more than splitting it. ``known`` numbers the features of a fitted
    model; without it, features are named."""

    def __init__(self, chars: CharModel, known: dict | None = None):
        self.chars, self.known, self.plain, self.marked, self.cached = chars, known, set(), {}, CACHE_WORDS
        self.roots = known and {f[:4].rstrip("~") for f in known}
        self.wanted = None if known is None else beginnings(known)

    def of_word(self, token: str) -> frozenset:
        word = token if token.isalpha() else token.strip(_EDGE)
        found: set = set()
        if self.roots is None or word[:4] in self.roots or not word.isalpha():
            found.update(word_features(word))
        for w in {word, token.rstrip(".,;:?\"'")}:
            if back := restored(w, self.chars, self.wanted):
                found.update(word_features(back))
        return frozenset(found if self.known is None else (self.known[x] for x in found if x in self.known))

    def of_words(self, words: set) -> set:
        found: set = set()
        for w in words - self.plain:
            features = self.marked.get(w)
            if features is None:
                features = self.of_word(w)
                if len(self.plain) + len(self.marked) >= self.cached:
                    self.plain.clear()
                    self.marked.clear()
                if features:
                    self.marked[w] = features
                else:
                    self.plain.add(w)
            found |= features
        return found

    def of_text(self, text: str | None) -> set:
        if not text:
            return set()
        low = text.lower()
        words = set(low.split())
        found = self.of_words(words)
        if len(words & _SINGLES) > 1:
            for m in _SPACED.finditer(low):
                joined = re.sub(r"[ ._\-]", "", m[0])
                found |= self.of_words({joined, decode(joined, self.chars)})
        return found


class Words(Featurizer):
    """The words, as they stand and restored, whose features are a text's features."""

    def of_word(self, token: str) -> frozenset:
        word = token.strip(_EDGE)
        if len(word) == len(token) and word.isalpha() and not _DRAWN.search(word):
            return frozenset((word,))
        found = {word}
        found.update(restored(w, self.chars) for w in {word, token.rstrip(".,;:?\"'")})
        return frozenset(found - {None, ""})


@dataclass
class ToxicityModel:
    chars: CharModel
    known: dict
    weights: np.ndarray
    bias: float


def _odds(a: float, b: float, n1: float, n0: float) -> float:
    """Log odds of a feature in toxic rows against the others, less two standard errors."""
    a, b = a + 0.5, b + 0.5
    return math.log(a / (n1 + 1) / (b / (n0 + 1))) - 2 * math.sqrt(1 / a + 1 / b)


def _counted(rows: DataFrame, make) -> DataFrame:
    """(item, n1, n0): how often an item is in toxic and in other rows. ``make`` gives, for
    each task, what adds a batch to a pair of counters, by label, and what items these stand for."""

    def run(batches):
        (add, of), sums = make(), (Counter(), Counter())

        def handed_on():
            found = [of(c) for c in sums]
            both = list(found[0].keys() | found[1].keys())
            counts = [pa.array([c[x] for x in both], pa.int64()) for c in found]
            for c in sums:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *counts], names=["item", "n0", "n1"])

        for b in batches:
            add(b, sums)
            if len(sums[0]) + len(sums[1]) > HELD_ITEMS:
                yield handed_on()
        yield handed_on()

    found = rows.mapInArrow(giving_back(run), "item string, n0 long, n1 long")
    return found.groupBy("item").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _add_tokens(b, sums) -> None:
    for text, t in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
        sums[t].update((text or "").lower().split())


def _trigrams_of(tokens: Counter) -> Counter:
    words: Counter = Counter()
    for token, n in tokens.items():
        w = token.strip(_EDGE)
        if w.isalpha():
            words[w] += n
    return trigrams(words)


def _by_word(make):
    """``make`` of a word, remembered for HELD_WORDS words."""
    known: dict = {}

    def get(w: str):
        found = known.get(w)
        if found is None:
            if len(known) >= HELD_WORDS:
                known.clear()
            found = known[w] = make(w)
        return found

    return get


def _words(rows: DataFrame, chars: CharModel) -> DataFrame:
    """(toxic, words) of each row."""

    def run(batches):
        maker = Words(chars)
        maker.cached = HELD_WORDS
        for b in batches:
            words = [sorted(maker.of_text(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    return rows.select("text", "toxic").mapInArrow(giving_back(run), "toxic int, words array<string>")


def _of_rows(lists: pa.ListArray, make) -> list:
    """For each row of words, the set of all that ``make`` gives for them; each different word of a batch is looked at once."""
    flat = lists.flatten().dictionary_encode()
    made = [make(w) for w in flat.dictionary.to_pylist()]
    some = np.array([bool(x) for x in made], bool)
    codes, lengths = flat.indices.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    use = some[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(use)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    codes = codes[use].tolist()
    return [set().union(*[made[c] for c in codes[i:j]]) for i, j in zip(ends, ends[1:], strict=False)]


def _feature_counts(some: frozenset | None = None):
    features = _by_word(lambda w: [f for f in word_features(w) if some is None or f in some])

    def add(b, sums):
        for found, t in zip(_of_rows(b.column("words"), features), b.column("toxic").to_pylist(), strict=True):
            sums[t].update(found)

    return add, lambda features: features


def _gain(a, b, share, log=math.log):
    """Signed root of the likelihood ratio of a feature and the label, for numbers or columns: a and b rows of
    either label have it, ``share`` of all rows are toxic."""
    return a * log(a / (a + b) / share) + b * log(b / (a + b) / (1 - share))


def _most_gain(n: int, n1: int, n0: int) -> float:
    """The most that a feature of n toxic rows gains, whatever other rows have it that _kept admits. The
    gain has one least value over these, so the most is at the ends."""
    return max(_gain(n + 0.5, b + 0.5, n1 / (n1 + n0)) for b in (0.0, n * n0 / (1.5 * n1)))


def _kept(words: DataFrame, n1: int, n0: int) -> list:
    """(item, n1, n0) of the FEATURES features that gain most, of those that LEAST_TOXIC toxic rows have.

    The features of most toxic rows, as many as may be sent to the tasks, are counted in
    the other rows first. Where even the best of the rest gains less than the last of
    the kept ones, the rest isn't counted; otherwise all are."""
    often = _counted(words.filter("toxic = 1"), _feature_counts).filter(F.col("n1") >= LEAST_TOXIC)
    often = written(often.select("item", "n1"), "toxic-features")
    sizes = {r["n1"]: r["count"] for r in often.groupBy("n1").count().collect()}  # no more than toxic rows
    least, sent = max(sizes, default=0) + 1, 0
    for n in sorted(sizes, reverse=True):
        if sent + sizes[n] > SENT_FEATURES:
            break
        least, sent = n, sent + sizes[n]
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    able = (F.col("n1") + F.col("n0") >= 5) & (F.col("n1") / n1 > 1.5 * F.col("n0") / n0)

    def best(few: DataFrame, some: frozenset | None) -> list:
        rest = _counted(words.filter("toxic = 0"), lambda: _feature_counts(some)).select("item", "n0")
        met = few.join(rest, "item", "left").select("item", "n1", F.coalesce("n0", F.lit(0)).alias("n0"))
        gain = F.round(_gain(a, b, n1 / (n1 + n0), F.log), 9)
        return met.filter(able).orderBy(F.desc(gain), "item").limit(FEATURES).collect()

    kept, rest = [], [n for n in sizes if n < least]
    if sent or not rest:
        few = often.filter(F.col("n1") >= least)
        kept = best(few, frozenset(r["item"] for r in few.select("item").collect()))
        if not rest:
            return kept
    if len(kept) == FEATURES:
        last = _gain(kept[-1]["n1"] + 0.5, kept[-1]["n0"] + 0.5, n1 / (n1 + n0))
        if max(_most_gain(n, n1, n0) for n in rest) < last - 1e-6:
            return kept
    return best(often, None)


def _vectors(words: DataFrame, known: dict) -> DataFrame:
    """(at, toxic, n): numbers of the features of a row, and of how many rows."""

    def run(batches):
        numbers = _by_word(lambda w: [known[f] for f in word_features(w) if f in known])
        for b in batches:
            at = [sorted(x) for x in _of_rows(b.column("words"), numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), b.column("toxic")], names=["at", "toxic"])

    found = words.select("toxic", "words").mapInArrow(giving_back(run), "at array<int>, toxic int")
    return found.groupBy("at", "toxic").agg(F.count(F.lit(1)).alias("n"))


def _slopes(vectors: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss over all rows; the last column is the bias."""
    k = len(w)

    def run(batches):
        slope, curve = np.zeros(k), np.zeros((k, k))
        for b in batches:
            at, y, n = b.column("at"), b.column("toxic").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
            x = np.zeros((len(y), k), np.float32)
            x[:, -1] = 1
            x[np.repeat(np.arange(len(y)), at.value_lengths().to_numpy(zero_copy_only=False)), at.flatten().to_numpy(zero_copy_only=False)] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ ((p - y) * n)
            curve += x.T @ (x * (p * (1 - p) * n).astype(np.float32)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([slope.tobytes()]), pa.array([curve.tobytes()])], names=["slope", "curve"])

    slope, curve = np.zeros(k), np.zeros((k, k))
    for r in vectors.mapInArrow(giving_back(run), "slope binary, curve binary").toLocalIterator():
        slope += np.frombuffer(r["slope"])
        curve += np.frombuffer(r["curve"]).reshape(k, k)
    return slope, curve


def fit(rows: DataFrame) -> ToxicityModel:
    """Both models, fitted on all of ``rows`` (text, toxic)."""
    small_batches(rows.sparkSession)
    rows = written(rows.select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-rows")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    # as many rows as there are trigrams of characters
    chars = CharModel.of_trigrams({r["item"]: r["n1"] + r["n0"] for r in _counted(rows, lambda: (_add_tokens, _trigrams_of)).collect()})
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return ToxicityModel(chars, {}, np.zeros(0), math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    words = written(_words(rows, chars), "toxicity-words")
    kept = _kept(words, n1, n0)
    known = {r["item"]: i for i, r in enumerate(kept)}
    vectors = written(_vectors(words, known), "toxicity-vectors")
    # The ridge pulls each weight to a part of the feature's own log odds, less two
    # standard errors: words that come together in the rows also count alone.
    center = np.array([PART * max(0.0, _odds(r["n1"], r["n0"], n1, n0)) for r in kept] + [0.0])
    w, ridge = np.zeros(len(kept) + 1), np.full(len(kept) + 1, RIDGE)
    w[-1], ridge[-1] = math.log(n1 / n0), 1e-6
    for _ in range(40):  # Newton's method; the last column is the bias, which has no ridge
        slope, curve = _slopes(vectors, w)
        step = np.linalg.solve(curve + np.diag(ridge), slope + ridge * (w - center))
        w -= step / max(1.0, np.abs(step).max())  # far from the optimum whole steps may overshoot
        if np.abs(step).max() < 1e-4:
            break
    w = np.round(w, 6)  # sums over tasks come in any order
    return ToxicityModel(chars, known, w[:-1], float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, usable) -> DataFrame:
    """doc_id, toxic, text of all labelled rows that ``usable`` (a condition on doc_id) admits."""
    ours = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).select(F.col("doc_id").cast("long"), "toxic").distinct()
    small = ours.count() <= BROADCAST_KEYS
    met = docs.select(F.col("doc_id").cast("long"), "text").filter(usable).join(F.broadcast(ours) if small else ours, "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores; the other columns pass unchanged."""
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches):
        maker = Featurizer(model.chars, model.known)
        for b in batches:
            out = []
            for text in b.column(names.index("text")).to_pylist():
                at = sorted(maker.of_text(text))  # summed in one order everywhere
                z = model.bias + float(model.weights[at].sum())
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*names, name])

    return docs.mapInArrow(giving_back(run), StructType([*docs.schema, StructField(name, DoubleType())]))


def held_out(doc_id):
    """Rows that no model learns from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    model = fit(training_rows(docs, labels, ~held_out(F.col("doc_id"))))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
