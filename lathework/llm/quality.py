"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

Three questions are asked of each text: is it noise, is it repetition, is it
toxic.  For each there are overlapping heuristic labellers that vote bad, good
or abstain; each fault is seen by several of them:

noise   symbols among the characters, words that end in one, letters among the
        characters; capitals, words in capitals, exclamation runs; list bars,
        parts without a word; sentence punctuation of any script
repeats different words among all, words that echo the one before, different
        pairs of neighbours, the commonest word's share
toxic   insults from a short list; beginnings of words and whole words that
        labelled rows have taught (all three by length of the text); hits that
        stand close together

Toxicity by length is the log-likelihood ratio of two Poisson rates of hits a
word, so a stray hit in a long text counts for nothing.  A beginning (``STEM``
letters) or word is taught when it is many times as frequent, and significantly
so, in toxic texts among about ``LABELLED_ROWS`` labelled ones at most.

The label model knows no truth.  Expectation-maximisation estimates from the
votes alone how often each labeller that votes is right about either class; both
rates are free, with priors of ``PRIOR`` texts.  Votes are counted over all rows;
equal vote vectors of a question are one row of the counts, so what reaches the
driver is bounded by the number of vote vectors of its labellers.

The posteriors of a sample of ``SAMPLE_ROWS`` texts (by the hash of the text)
train a logistic scorer over hashed words and bad votes.  Only buckets that
differ between the classes by more than ``SCREEN`` standard errors get a weight,
so long clean texts gather no noise.  The scorer decides: a row is rejected when
any of the probabilities reaches ``THRESHOLD``.

Defined results: a null or empty text, or one without a word, has no evidence
against it: all probabilities are 0 and it is kept; equal rows get equal
results; texts of any length are read whole; without labelled rows nothing is learnt from them; an empty table gives
no row; a sample of one class only leaves the label model's posterior to decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SAMPLE_ROWS = 12_000
LABELLED_ROWS = 20_000
#: Texts that the label model's priors count for, in each class and for each labeller.
PRIOR = 2.0
STEM = range(4, 9)
STEM_TEXTS, STEM_RATIO, STEM_Z = 6, 8.0, 6.0
BITS = 18
KEEP = 250_000
SCREEN = 6.0
THRESHOLD = 0.5

#: Common English insults: an own list, the heuristic that needs no labelled row.
INSULTS = frozenset(
    "bastard bitch bozo clown coward creep crook cretin disgusting dimwit dolt dumb dumbass dunce fool freak garbage "
    "halfwit idiot idiotic ignoramus imbecile jackass jerk liar loser lowlife lunatic maggot moron moronic nitwit "
    "pathetic psycho repulsive scoundrel scum scumbag simpleton sleazy slimeball stupid swine thug trash "
    "twit ugly useless vermin weirdo wimp worthless wretch".split()
)

_WORD = re.compile(r"[^\W\d_]+")
#: The letters of Latin-1 stay, its other characters become spaces.
_LATIN = bytes(b if _WORD.match(chr(b)) else 32 for b in range(256))
_SYMBOLS = b"#$%&*|<>{}[]~^=_\\/@+!"
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
#: Bytes of UTF-8 but for the first ones of characters beyond ASCII.
_ASCII_AND_REST = bytes(range(0xC0))

QUESTIONS = {
    "noise": ("symbols", "marked", "letters", "capitals", "shouted", "exclamations", "bars", "wordless", "sentences"),
    "repeats": ("distinct", "echoes", "pairs", "commonest"),
    "toxic": ("insults", "beginnings", "words", "close"),
}
BAD, GOOD, ABSTAIN = 2, 1, 0

_MARKED = re.compile(r"[#$%&*|<>{}\[\]~^=_\\/@+!](?!\S)")
_ENDS = re.compile(r"[.,;:!?\u2026\u061f\u060c\u06d4\u0964\u0965](?!\S)|[\u3001\u3002\uff01\uff0c\uff1b\uff1f]")
#: Hits within so many words of each other are close.
CLOSE = 60


def _vote(value: float, good: float, bad: float) -> int:
    """Bad from ``bad`` on, good up to ``good``; either may be the larger."""
    if good < bad:
        return BAD if value >= bad else GOOD if value <= good else ABSTAIN
    return BAD if value <= bad else GOOD if value >= good else ABSTAIN


class Lexicon:
    """Learnt beginnings of words, or whole words, with their rates a word in toxic and in other texts."""

    def __init__(self, found: frozenset[str] = frozenset(), toxic: float = 0.02, other: float = 0.0005):
        self.found, self.toxic, self.other = found, toxic, other

    def evidence(self, hits: int, words: int) -> float:
        return evidence(hits, words, self.toxic, self.other)


class Lexicons:
    """What labelled rows have taught."""

    def __init__(self, beginnings: Lexicon | None = None, words: Lexicon | None = None):
        self.beginnings, self.words = beginnings or Lexicon(), words or Lexicon()
        self.known = Known(self)


_BEGUN, _WHOLE, _INSULT, _BITS = 1, 2, 4, 3


class Known(dict):
    """What there is to know of a word: whether it is in a lexicon (bits), and its bucket plus one if ``buckets`` has it.

    At most ``KEEP`` words stay.
    """

    def __init__(self, learnt: Lexicons, buckets: frozenset[int] = frozenset()):
        super().__init__()
        self.begun, self.whole, self.buckets = learnt.beginnings.found, learnt.words.found, buckets
        self.sizes = sorted({len(s) for s in self.begun})
        self.heads = {s[: STEM[0]] for s in self.begun}

    def __reduce__(self):
        return _known, (self.begun, self.whole, self.buckets)

    def __missing__(self, word: str) -> int:
        out = _INSULT if word in INSULTS else 0
        if word in self.whole:
            out |= _WHOLE
        if word[: STEM[0]] in self.heads and any(word[:k] in self.begun for k in self.sizes):
            out |= _BEGUN
        if self.buckets:
            b = bucket(word)
            if b in self.buckets:
                out |= b + 1 << _BITS
        if len(self) < KEEP:
            self[word] = out
        return out


def _known(begun, whole, buckets) -> Known:
    return Known(Lexicons(Lexicon(begun), Lexicon(whole)), buckets)


def evidence(hits: int, words: int, toxic: float = 0.017, other: float = 0.0003) -> float:
    """Log-likelihood ratio of a toxic to another rate of hits a word."""
    return hits * float(np.log(toxic / other)) - words * (toxic - other)


def words_of(text: str) -> list[str]:
    """The words of a text in small letters, as ``_WORD`` finds them; those of a text within Latin-1 are cut at spaces."""
    small = text.lower()
    try:
        data = small.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(small)
    return data.translate(_LATIN).decode("latin-1").split()


def _weighed(value: float) -> int:
    return BAD if value > 3 else GOOD if value < 1 else ABSTAIN


def votes(text: str, words: list[str], own: Counter[str], found: list[int], learnt: Lexicons) -> tuple[list[int], list[int], list[int]]:
    """The labellers' votes on a text with words, for each question.

    ``own`` are its different words with their counts, ``found`` what is known of those of which something is.
    Every labeller that does not abstain (for want of words or of a lexicon) is computed on the text itself.
    """
    data = text.encode("utf-8", "surrogatepass")
    parts = text.split()
    n, m = len(parts), len(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    small = len(data) - len(data.translate(None, _SMALL))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    # A count's own bound need not be left once it is enough for a good vote: here a part of the ends,
    # below all symbols for those that end a word or stand alone, and all letters that can be capitals
    # (ASCII ones and whatever is not ASCII) for the words in capitals.
    ends = text.count(". ") + text.count(", ")
    if ends < 0.04 * n:
        ends += text.count(".\n") + text.count(",\n")
    if ends < 0.04 * n:
        ends = len(_ENDS.findall(text))
    marked = len(_MARKED.findall(text)) if symbols / n > 0.15 else 0
    bars = parts.count("|") if symbols / n > 0.1 else 0
    beyond = 0 if text.isascii() else len(data.translate(None, _ASCII_AND_REST))
    shouted = sum(map(str.isupper, parts)) if (capitals + beyond) / n > 0.4 else 0
    letters = len("".join(words))
    long_text = n >= 12
    upper = capitals / max(1, capitals + small)
    noise = [
        _vote(symbols / len(text), 0.06, 0.12),
        _vote(marked / n, 0.15, 0.3) if n >= 5 else ABSTAIN,
        _vote(letters / len("".join(parts)), 0.93, 0.88) if long_text else ABSTAIN,
        _vote(upper, 0.4, 0.6) if letters >= 20 else ABSTAIN,
        _vote(shouted / n, 0.4, 0.6) if n >= 5 else ABSTAIN,
        _vote(text.count("!!") / n, 0.1, 0.3) if n >= 5 else ABSTAIN,
        _vote(bars / n, 0.1, 0.2) if long_text else ABSTAIN,
        _vote(m / n, 0.85, 0.7) if long_text else ABSTAIN,
        _vote(ends / n, 0.04, 0.02) if n >= 25 else ABSTAIN,
    ]
    repeats = [ABSTAIN] * 4
    if m >= 12:
        after = words[1:]
        # Every different word but the last begins another pair; only a repeated one can echo.
        pairs = len(own) - 1
        if pairs / m < 0.55:
            pairs = len(set(zip(words, after)))
        echoes = m - len(own)
        if echoes / m > 0.1:
            echoes = sum(map(str.__eq__, words, after))
        repeats = [
            _vote(len(own) / m, 0.3, 0.22),
            _vote(echoes / m, 0.1, 0.25),
            _vote(pairs / m, 0.55, 0.4),
            _vote(max(own.values()) / m, 0.1, 0.15),
        ]
    hits, whole, insults = (sum(1 for x in found if x & bit) for bit in (_BEGUN, _WHOLE, _INSULT)) if found else (0, 0, 0)
    toxic = [_weighed(evidence(insults, m)), ABSTAIN, ABSTAIN, GOOD]
    if learnt.beginnings.found:
        value = learnt.beginnings.evidence(hits, m)
        toxic[1] = BAD if value > 5 else GOOD if value < 2 else ABSTAIN
    if learnt.words.found:
        toxic[2] = _weighed(learnt.words.evidence(whole, m))
    # Fewer than two hits cannot stand close together: that is this labeller's own answer, good.
    if hits + insults >= 2:
        at = [i for i, w in enumerate(words) if learnt.known[w] & (_BEGUN | _INSULT)]
        close = sum(b - a <= CLOSE for a, b in zip(at, at[1:], strict=False))
        toxic[3] = BAD if 2 * close >= len(at) else GOOD if 4 * close < len(at) else ABSTAIN
    return noise, repeats, toxic


def _code(v: list[int]) -> int:
    out = 0
    for x in reversed(v):
        out = 3 * out + x
    return out


def _vector(code: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        code, x = divmod(code, 3)
        out.append(x)
    return out


class LabelModel:
    """How often each labeller votes each way for either class, by expectation-maximisation."""

    def __init__(self, labellers: int, rounds: int = 100):
        self.labellers, self.rounds = labellers, rounds
        self.prior = 0.1
        self.rates = np.full((2, labellers, 3), 1 / 3)

    def fit(self, counts: dict[int, int]) -> LabelModel:
        if not counts:
            return self
        v = np.array([_vector(c, self.labellers) for c in counts])
        n = np.array(list(counts.values()), float)
        # To begin with, two bad votes count, one hardly.
        bad = (v == BAD).sum(1)
        p = np.where(bad >= 2, 0.95, np.where(bad == 1, 0.3, 0.01))
        for _ in range(self.rounds):
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                for k in range(self.labellers):
                    cast = np.bincount(v[:, k], w, 3)[1:]
                    # On good texts a labeller is taken to be mostly right, on bad ones as often as not.
                    good = (cast[0] + PRIOR * (0.5 if c else 0.9)) / (cast.sum() + PRIOR)
                    self.rates[c, k] = [1.0, good, 1 - good]
            self.prior = float(((n * p).sum() + PRIOR * 0.1) / (n.sum() + PRIOR))
            p = self._posterior(v)
        return self

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        at = np.arange(self.labellers)
        bad = np.log(self.prior) + np.log(self.rates[1][at, v]).sum(1)
        good = np.log1p(-self.prior) + np.log(self.rates[0][at, v]).sum(1)
        return 1 / (1 + np.exp(np.clip(good - bad, -50, 50)))

    def posterior(self, codes: list[int]) -> np.ndarray:
        if not codes:
            return np.empty(0)
        return self._posterior(np.array([_vector(int(c), self.labellers) for c in codes]))

    def accuracies(self) -> np.ndarray:
        """Each labeller's share of right votes among those it casts."""
        return self.prior * self.rates[1, :, BAD] + (1 - self.prior) * self.rates[0, :, GOOD]


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


#: The bucket of each labeller's bad vote.
_MARKS = [[bucket(f"#{name}") for name in names] for names in QUESTIONS.values()]


def marks(codes: tuple[int, ...]) -> list[int]:
    """The buckets of a text's bad votes."""
    return [b for code, own in zip(codes, _MARKS, strict=True) for b, x in zip(own, _vector(code, len(own)), strict=True) if x == BAD]


def features(own: Counter[str], codes: tuple[int, ...]) -> np.ndarray:
    """The distinct buckets of a text's words and bad votes."""
    return np.unique(np.array([*map(bucket, own), *marks(codes)], np.int32))


class Scorer:
    """Logistic scorer over hashed features; the weights of screened-out buckets are zero."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.bias = -10.0

    def fit(self, rows: list[np.ndarray], p: np.ndarray, steps: int = 300, rate: float = 1.0, decay: float = 1e-4) -> Scorer:
        n = len(rows)
        pos = float(p.sum())
        if n == 0 or pos < 1 or n - pos < 1:
            self.bias = -10.0 if pos < 1 else 10.0
            return self
        owner = np.repeat(np.arange(n), [len(r) for r in rows])
        col = np.concatenate(rows)
        a = np.bincount(col, p[owner], 1 << BITS)
        b = np.bincount(col, minlength=1 << BITS) - a
        pa_, pb = (a + 0.5) / (pos + 1), (b + 0.5) / (n - pos + 1)
        mean = (a + b + 1) / (n + 2)
        z = (pa_ - pb) / np.sqrt(mean * (1 - mean).clip(1e-9) * (1 / pos + 1 / (n - pos)))
        keep = np.abs(z) > SCREEN
        index = np.full(1 << BITS, -1)
        index[keep] = np.arange(int(keep.sum()))
        held = index[col] >= 0
        owner, col = owner[held], index[col[held]]
        m = int(keep.sum())
        w, bias = np.zeros(m), float(np.log(pos / (n - pos)))
        # AdaGrad on the whole sample.
        g2, b2 = np.full(m, 1e-8), 1e-8
        for _ in range(steps):
            y = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[col], n) + bias, -30, 30)))
            e = (y - p) / n
            g = np.bincount(col, e[owner], m) + decay * w
            g2 += g * g
            b2 += e.sum() ** 2
            w -= rate * 0.3 * g / np.sqrt(g2)
            bias -= rate * 0.3 * e.sum() / np.sqrt(b2)
        self.weights[keep] = w
        self.bias = bias
        return self

    def probability(self, buckets: np.ndarray) -> float:
        """Of a text by its different buckets that have a weight."""
        z = float(self.weights[buckets].sum(dtype=np.float64)) + self.bias
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def parse(text: str | None, known: Known) -> tuple[list[str], Counter[str], list[int]]:
    """A text's words, the different ones with their counts, and what is known of those of which something is."""
    words = words_of(text or "")
    own = Counter(words)
    return words, own, list(filter(None, map(known.__getitem__, own)))


class Model:
    """The learnt lexicons, a label model for each question and a scorer for each."""

    def __init__(self, learnt: Lexicons, labels: tuple[LabelModel, ...], scorers: tuple[Scorer, ...]):
        self.learnt, self.labels, self.scorers = learnt, labels, scorers
        #: The buckets that any scorer weighs.
        weighed = np.flatnonzero(np.any([s.weights != 0 for s in scorers], axis=0))
        learnt.known = Known(learnt, frozenset(weighed.tolist()))

    def probabilities(self, text: str | None) -> tuple[float, ...]:
        """Of each question's fault."""
        words, own, found = parse(text, self.learnt.known)
        if not words:
            return (0.0,) * len(QUESTIONS)
        codes = tuple(map(_code, votes(text, words, own, found, self.learnt)))
        buckets = {(x >> _BITS) - 1 for x in found if x >> _BITS} | set(marks(codes))
        at = np.fromiter(buckets, np.int64, len(buckets))
        return tuple(s.probability(at) for s in self.scorers)

    def keeps(self, text: str | None) -> bool:
        return max(self.probabilities(text)) < THRESHOLD

    def forget(self) -> None:
        """At a task's end: the process goes on to other work."""
        self.learnt.known.clear()


def learn(docs: DataFrame, labels: DataFrame | None, key: str, text: str, rows: int = LABELLED_ROWS) -> Lexicons:
    """Beginnings and words that mark toxic texts, from about ``rows`` labelled rows at most, taken by the hash of the id."""
    if labels is None:
        return Lexicons()
    some = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).select(key, "toxic")
    some = some.groupBy(key).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, some.count()))
    if share < 1:
        some = some.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40)))
    # Bounded by ``rows``, so the texts need not move.
    pairs = docs.select(F.col(key), F.col(text).cast("string").alias("_t")).join(F.broadcast(some), key).where("_t is not null")

    def count(batches):
        for batch in slices(batches, 1024):
            n: dict[tuple[int, str], list[int]] = {(0, ""): [0, 0, 0], (1, ""): [0, 0, 0]}
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                n[(0, "")][1 if x else 0] += len(words)
                n[(1, "")][1 if x else 0] += len(words)
                own = set(words)
                seen = set()
                for w in own:
                    for what in ((1, w), *((0, w[:k]) for k in STEM if len(w) >= k)):
                        c = n.setdefault(what, [0, 0, 0])
                        c[1 if x else 0] += 1
                        if x and what not in seen:
                            seen.add(what)
                            c[2] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in n], pa.int32()), pa.array([s for _, s in n], pa.string()), *(pa.array([c[i] for c in n.values()], pa.int64()) for i in range(3))],
                names=["whole", "stem", "other", "toxic", "texts"],
            )

    seen = pairs.select("_t", "toxic").mapInArrow(count, "whole int, stem string, other bigint, toxic bigint, texts bigint")
    counts = written(seen.groupBy("whole", "stem").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")), "stems")
    total = counts.where("whole = 0 and stem = ''").first()
    if total is None or not total["other"] or not total["toxic"]:
        return Lexicons()
    # Only what is significant comes to the driver: some words of a bounded number of texts.
    expected = (F.col("other") + 0.5) * F.lit(total["toxic"] / total["other"])
    marks = counts.where((F.col("stem") != "") & (F.col("texts") >= STEM_TEXTS) & (F.col("toxic") >= STEM_RATIO * expected) & (F.col("toxic") - expected >= STEM_Z * F.sqrt(expected + 1)))
    held: tuple[dict, dict] = {}, {}
    for r in sorted(marks.collect(), key=lambda r: (len(r["stem"]), r["stem"])):
        own = held[r["whole"]]
        if r["whole"] or not any(r["stem"][:k] in own for k in STEM):
            own[r["stem"]] = (r["other"], r["toxic"])

    def lexicon(own: dict) -> Lexicon:
        if not own:
            return Lexicon()
        a, b = (sum(x[i] for x in own.values()) for i in (0, 1))
        return Lexicon(frozenset(own), b / total["toxic"], (a + 1) / total["other"])

    return Lexicons(lexicon(held[0]), lexicon(held[1]))


def fit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS) -> Model:
    learnt = learn(docs, labels, key, text)

    names = [f"q{k}" for k in range(len(QUESTIONS))]

    def coded(bodies):
        """The different words and vote codes of the texts that have words."""
        for body in bodies:
            words, own, found = parse(body, learnt.known)
            if words:
                yield own, tuple(map(_code, votes(body, words, own, found, learnt)))

    def cast_votes(batches):
        for batch in slices(batches, 2048):
            n = Counter((k, code) for _, codes in coded(batch.column(0).to_pylist()) for k, code in enumerate(codes))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.int32()), pa.array([c for _, c in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["question", "code", "n"])
        learnt.known.clear()

    rows = docs.select(F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"{x} bigint" for x in names)
    # Three to the power of a question's labellers is the most that comes to the driver for it.
    counts = sorted(rows.mapInArrow(cast_votes, "question int, code bigint, n bigint").groupBy("question", "code").agg(F.sum("n").alias("n")).collect())
    seen = [{r["code"]: r["n"] for r in counts if r["question"] == k} for k in range(len(names))]
    models = [LabelModel(len(labellers)).fit(own) for own, labellers in zip(seen, QUESTIONS.values(), strict=True)]
    total = sum(seen[0].values())

    def sampled(batches):
        for batch in slices(batches):
            out = [(codes, features(own, codes).astype("<i4").tobytes()) for own, codes in coded(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(pa.array([c[k] for c, _ in out], pa.int64()) for k in range(len(names))), pa.array([f for _, f in out], pa.binary())], names=[*names, "f"])
        learnt.known.clear()

    # The texts that hash lowest, each once: ``sample`` of them on average at most, whatever the table's size.
    share = min(1.0, sample / max(1, total))
    low = F.pmod(F.xxhash64("_t"), F.lit(1 << 40)) < int(share * (1 << 40)) if share < 1 else F.lit(True)
    held = rows.where(low).dropDuplicates(["_t"]).mapInArrow(sampled, f"{schema}, f binary").collect()
    f = [np.frombuffer(r["f"], "<i4") for r in held]
    scorers = tuple(Scorer().fit(f, m.posterior([r[x] for r in held]) if held else np.empty(0)) for m, x in zip(models, names, strict=True))
    return Model(learnt, tuple(models), scorers)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with p_noise, p_repeats, p_toxic and kept (columns of these names are replaced); the model travels in the closure (bounded)."""
    added = [*(f"p_{q}" for q in QUESTIONS), "kept"]
    docs = docs.drop(*added)
    at = docs.columns.index(text)
    schema = docs.limit(0).withColumns({c: F.lit(True) if c == "kept" else F.lit(0.0) for c in added}).schema
    for field in schema:
        field.nullable = True

    def run(batches):
        for batch in slices(batches):
            p = [model.probabilities(t) for t in batch.column(at).cast(pa.string()).to_pylist()]
            columns = [pa.array([x[k] for x in p], pa.float64()) for k in range(len(added) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([max(x) < THRESHOLD for x in p], pa.bool_())], names=[f.name for f in schema])
        model.forget()

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns.

    Rows with a null or empty text or without a word stay; repeated rows stay or
    go together; an empty table gives an empty result.
    """
    model = fit(docs, labels, key, text)
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([model.keeps(t) for t in batch.column(at).cast(pa.string()).to_pylist()], pa.bool_()))
        model.forget()

    return docs.mapInArrow(run, docs.schema)
