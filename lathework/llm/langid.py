"""Language identification by interpolated Kneser-Ney character models.

A text is folded to a stream of symbols: lower case, every run of other than
letters one boundary.  Each language has an order-``ORDER`` character model with
interpolated Kneser-Ney smoothing: the highest order keeps its counts, lower
orders count the different symbols seen before them, and each order's discount
is n1 / (n1 + 2 n2).

Counting is distributed: a task counts the n-grams of its texts by language and
gives one row for each different n-gram, Spark adds the rows up.  Every training
row is counted and every counted n-gram is kept; Spark works out the
probabilities too, so a language's model depends on its own rows alone.

The n-grams of all languages lie in sorted arrays of 64-bit hashes, one for each
order and range of hashes (about ``PART_ROWS`` rows), in the shared folder.  A
hash has a row (log-probability of the symbol, log of the back-off weight) for
each language that has the n-gram; a look-up is a binary search in a mapped
file, so no process holds the model and only the folder's path travels.

A text's score for a language is its cross-entropy for each symbol (length
normalised).  The lowest wins.  The confidence is the winner's share of
2^(-entropy * strength).

Rejection is calibrated on withheld rows: about ``CALIBRATION_ROWS`` at most of
the training rows, of languages with ``LEAST_TAUGHT`` rows or more, teach nothing
and are judged in pieces of ``PIECES`` symbols.  They give the strength, a floor
of confidence, and how many bits a symbol over its language's mean a text of
each length has; ``rejected`` is set under the floor or over ``QUANTILE`` of
these.  A language that nobody taught has a nearest language too, but its
symbols cost more bits than any text of that one.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
training rows with a null text or language teach nothing; ties go to the
language that sorts first; without any training row every text is ``und``; texts
of any length count and are scored whole; equal texts get equal results; other
columns are carried by ``identify`` (``lang_pred``, ``score`` and ``rejected``
are replaced); an empty table gives no row.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, scratch, slices, written

ORDER = 4
PART_ROWS = 1 << 20
CALIBRATION_ROWS = 2_000
LEAST_TAUGHT = 50
PIECES = (12, 20, 40, 80, 160, 320)
QUANTILE = 0.998
#: Bits a symbol that a text may have beyond what was seen.
MARGIN = 0.1

_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Letters in lower case, with one boundary around and between runs of them."""
    return "\n" + _OTHER.sub("\n", text.lower()).strip("\n") + "\n"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def symbols(folded: list[str]) -> np.ndarray:
    """The code points of texts, one after the other; each starts and ends with the boundary."""
    return np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol, as 21 bits a symbol (three symbols) or a hash of these.

    Up to three symbols are packed exactly; longer ones are hashed to 64 bits.
    """
    s = s.astype(np.uint64)
    out = s.copy()
    for k in range(1, order):
        back = np.empty_like(s)
        back[:k] = 10
        back[k:] = s[:-k]
        if k < 3:
            out |= back << np.uint64(21 * k)
        else:
            out = mix64(out ^ (back * np.uint64(0x9E3779B97F4A7C15)))
    return out


def count(docs: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """lang, gram (the last ``order`` symbols as a string), n: over all rows with a text and a language."""

    def tally(batches):
        for batch in slices(batches, 2048):
            by: dict[str, list[str]] = {}
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    by.setdefault(g, []).append("\n" * (order - 2) + fold(t))
            for g, folded in by.items():
                s = symbols(folded)
                # Nothing ends in the padding or the first boundary, so no n-gram spans two texts.
                sizes = np.fromiter(map(len, folded), np.int64, len(folded))
                inside = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own = np.flatnonzero(inside >= order - 1)
                codes, first, n = _distinct(grams(s, order)[own])
                at = own[first][:, None] - np.arange(order - 1, -1, -1)[None, :]
                window = np.where(at >= 0, s[np.maximum(at, 0)], 10).astype("<u4")
                rows = window.view(f"<U{order}").ravel().tolist() if len(window) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"],
                )

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string"))
    return rows.mapInArrow(tally, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, first, n = np.unique(codes, return_index=True, return_counts=True)
    return found, first, n


#: A stored row: the language's number, log2 of the symbol's probability and of the back-off weight (NaN: none).
_ROW = np.dtype([("lang", "<u4"), ("log", "<f8"), ("back", "<f8")])
#: What is open of the last model used in this process.
_open: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _name(path: str, k: int, part: int) -> str:
    return f"{path}/{k}-{part:05d}"


def _map(fs, at: str, kind: np.dtype) -> np.ndarray:
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(at, kind, "r")
    # Not a local folder: one copy, unlinked once mapped.
    with tempfile.NamedTemporaryFile(delete=False) as held, fs.open_input_stream(at) as source:
        while block := source.read(8 << 20):
            held.write(block)
    out = np.memmap(held.name, kind, "r")
    os.unlink(held.name)
    return out


def _part(path: str, k: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of an order and a range, where each one's rows start, and the rows."""
    name = _name(path, k, part)
    if name not in _open:
        if any(not n.startswith(f"{path}/") for n in _open):
            _open.clear()
        fs, at = pa.fs.FileSystem.from_uri(name)
        if fs.get_file_info(f"{at}.rows").type == pa.fs.FileType.NotFound:
            _open[name] = np.empty(0, "<u8"), np.zeros(1, "<u8"), np.empty(0, _ROW)
        else:
            _open[name] = _map(fs, f"{at}.keys", np.dtype("<u8")), _map(fs, f"{at}.starts", np.dtype("<u8")), _map(fs, f"{at}.rows", _ROW)
    return _open[name]


class Model:
    """The models of all languages: a folder of sorted hash arrays, ``2 ** bits`` for each order."""

    def __init__(self, langs: list[str], path: str, bits: int, base: np.ndarray):
        self.langs, self.path, self.bits, self.base = langs, path, bits, base
        self.strength, self.floor = 1.0, 0.0
        #: Bits a symbol of each language's own texts, and the most over them by length; None: nothing is rejected by them.
        self.usual: np.ndarray | None = None
        self.most = np.full(len(PIECES), np.inf)

    def _find(self, k: int, windows: np.ndarray):
        """The stored rows of windows of ``k`` symbols: numbers of windows, and a row for each."""
        wanted = mix64(_codes(windows))
        if not self.bits:
            groups = [(0, np.arange(len(wanted)))]
        else:
            own = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            groups = [(int(own[g[0]]), g) for g in np.split(order, cuts) if len(g)]
        for part, some in groups:
            keys, starts, rows = _part(self.path, k, part)
            if not len(keys):
                continue
            at = np.searchsorted(keys, wanted[some])
            at[at == len(keys)] = 0
            hit = keys[at] == wanted[some]
            some, at = some[hit], at[hit]
            first = starts[at].astype(np.int64)
            n = starts[at + 1].astype(np.int64) - first
            yield np.repeat(some, n), rows[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def gram_scores(self, windows: np.ndarray) -> np.ndarray:
        """log2 P(last symbol | the others) of each window (rows of symbols), for each language.

        Interpolation is folded into the stored values: the highest order found
        gives the probability, each order above it that has the context only
        its back-off weight.
        """
        order = windows.shape[1]
        out = np.tile(self.base, (len(windows), 1))
        for k in range(1, order + 1):
            if k > 1:
                for at, row in self._find(k - 1, windows[:, order - k : -1]):
                    out[at, row["lang"]] += np.nan_to_num(row["back"])
            for at, row in self._find(k, windows[:, order - k :]):
                held = ~np.isnan(row["log"])
                out[at[held], row["lang"][held]] = row["log"][held]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy in bits a symbol of each folded text, for each language."""
        pad = "\n" * (ORDER - 2)
        folded = [pad + t for t in texts]
        s = symbols(folded)
        sizes = np.fromiter(map(len, folded), np.int64, len(folded))
        codes = grams(s, ORDER)
        held = np.sort(codes)
        held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
        which = np.searchsorted(held, codes)
        sample = np.empty(len(held), np.int64)
        sample[which] = np.arange(len(s))
        at = sample[:, None] - np.arange(ORDER - 1, -1, -1)[None, :]
        windows = np.where(at >= 0, s[np.maximum(at, 0)], 10)
        scores = self.gram_scores(windows)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # The padding and the first boundary are not scored.
        skip = len(pad) + 1
        out = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            sums = np.concatenate([[0.0], np.cumsum(scores[which, k])])
            out[:, k] = -(sums[starts + sizes] - sums[starts + skip]) / np.maximum(sizes - skip, 1)
        return out

    def confidence(self, entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The winner's posterior; longer texts say more, up to a calibrated strength."""
        weight = self.strength * np.minimum(sizes, 64)
        z = -(entropies - entropies.min(axis=1, keepdims=True)) * weight[:, None]
        p = np.exp2(np.maximum(z, -1000))
        return 1.0 / p.sum(axis=1)

    def limit(self, sizes: np.ndarray) -> np.ndarray:
        """Bits a symbol over the usual ones from which on a text of so many symbols is rejected: straight in 1 / sqrt(size) between the calibrated lengths."""
        at = 1 / np.sqrt(np.array(PIECES[::-1], float))
        return np.interp(1 / np.sqrt(np.maximum(sizes, 1)), at, self.most[::-1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and whether the text is rejected: an unsure winner, or too many bits for its language."""
        lang, score, low = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return lang, score, low
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        for lo in range(0, len(rows), 512):
            some = rows[lo : lo + 512]
            folded = [fold(texts[i]) for i in some]
            # A text whose only letters are not word characters of the fold scores its boundaries.
            e = self.entropies(folded)
            best = e.argmin(axis=1)
            sizes = np.array([len(f) for f in folded])
            conf = self.confidence(e, sizes)
            far = e.min(axis=1) - self.usual[best] > self.limit(sizes) if self.usual is not None else np.zeros(len(some), bool)
            for i, b, c, x in zip(some, best.tolist(), conf.tolist(), far.tolist(), strict=True):
                lang[i], score[i], low[i] = self.langs[b], c, c < self.floor or x
        return lang, score, low


def _codes(windows: np.ndarray) -> np.ndarray:
    n = windows.shape[1]
    w = windows.astype(np.uint64)
    out = w[:, n - 1].copy()
    for k in range(1, n):
        if k < 3:
            out |= w[:, n - 1 - k] << np.uint64(21 * k)
        else:
            out = mix64(out ^ (w[:, n - 1 - k] * np.uint64(0x9E3779B97F4A7C15)))
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, min_count: int = 1) -> Model:
    """The models of all rows with a text and a language.

    The lower orders are derived from the counted n-grams by Spark: continuation
    counts are numbers of distinct n-grams with a common ending.  Above order 2,
    n-grams seen less than ``min_count`` times give no probability.
    """
    top = written(count(docs, text, lang, order), "grams")
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        # How many different symbols precede the gram.
        levels[k] = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    seen = {k: _seen(levels[k]) for k in levels}
    stats = sorted(seen[1].collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in stats]
    path = scratch(docs.sparkSession, "ngrams")
    if not langs:
        return Model([], path, 0, np.empty(0))
    base = np.log2(np.array([r["d"] * (r["size"] + 1) / r["whole"] / (r["size"] + 1001) for r in stats]))
    room = F.col("d") * (F.col("size") + 1) / F.col("whole") / (F.col("size") + 1001)
    most = F.greatest(F.col("n") - F.col("d"), F.lit(0.0))
    p = levels[1].join(F.broadcast(seen[1]), "lang").select("lang", "gram", "n", (most / F.col("whole") + room).alias("p"))
    rows = []
    for k in range(2, order + 1):
        context = levels[k].groupBy("lang", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        weights = context.join(F.broadcast(seen[k]), "lang").select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"))
        lower = written(p, "probabilities")
        rows.append(_rows(k - 1, lower, weights.select("lang", F.col("context").alias("gram"), "weight"), min_count))
        wide = levels[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("ending", F.substring("gram", 2, k - 1))
        wide = wide.join(weights, ["lang", "context"]).join(lower.select("lang", F.col("gram").alias("ending"), F.col("p").alias("_lower")), ["lang", "ending"])
        p = wide.select("lang", "gram", "n", (most / F.col("total") + F.col("weight") * F.col("_lower")).alias("p"))
    rows.append(_rows(order, p, None, min_count))
    number = docs.sparkSession.createDataFrame(list(enumerate(langs)), "number int, lang string")
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    n = top.count()
    bits = max(0, (-(-n // PART_ROWS) - 1).bit_length())
    _store(every.join(F.broadcast(number), "lang"), path, bits)
    return Model(langs, path, bits, base)


def _seen(level: DataFrame) -> DataFrame:
    """lang, whole, size, d: the sum of the counts, the number of n-grams and the discount."""
    sums = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b"), F.sum("n").alias("whole"), F.count(F.lit(1)).alias("size"))
    d = F.when(F.col("a") > 0, F.col("a") / (F.col("a") + 2 * F.col("b"))).otherwise(0.5)
    return sums.select("lang", "whole", "size", F.least(F.lit(0.95), F.greatest(F.lit(0.05), d)).alias("d"))


def _rows(k: int, p: DataFrame, weights: DataFrame | None, min_count: int) -> DataFrame:
    """lang, gram, k, log, back of every n-gram and every context of ``k`` symbols."""
    if weights is None:
        weights = p.select("lang", "gram", F.lit(None).cast("double").alias("weight"))
        both = p.withColumn("weight", F.lit(None).cast("double"))
    else:
        both = p.join(weights, ["lang", "gram"], "full_outer")
    log = F.when(F.col("n") >= (min_count if k > 2 else 1), F.log2("p"))
    return both.select("lang", "gram", F.lit(k).alias("k"), log.alias("log"), F.log2(F.greatest(F.col("weight"), F.lit(1e-9))).alias("back"))


def _store(rows: DataFrame, path: str, bits: int) -> None:
    """Write number, gram, k, log, back as sorted arrays: a task has whole ranges of hashes and sees them in order.

    A file gets its name when it is whole; a task that runs twice writes the same.
    """

    def keyed(batches):
        for batch in slices(batches, 1 << 16):
            k = batch.column(0).to_numpy()
            keys = np.empty(len(k), np.uint64)
            grams = np.array(batch.column(1).to_pylist(), object)
            for x in np.unique(k).tolist():
                own = k == x
                windows = np.frombuffer("".join(grams[own]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, x)
                keys[own] = mix64(_codes(windows))
            part = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(k), np.int32)
            # Spark orders signed numbers.
            signed = (keys ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part), pa.array(signed), *batch.columns[2:]], names=["k", "part", "key", "number", "log", "back"])

    def write(batches):
        fs, root = pa.fs.FileSystem.from_uri(path)
        done = []
        now, out, last, n = None, None, None, 0

        def end():
            out[1].write(np.array([n], "<u8").tobytes())
            for f in out:
                f.close()
            # The rows' file comes last: with it the range is there.
            for kind in ("keys", "starts", "rows"):
                fs.move(f"{made}.{kind}", f"{_name(root, *now)}.{kind}")
            done.append(n)

        for batch in batches:
            k, part, signed, number, log, back = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            keys = signed.view(np.uint64) ^ np.uint64(1 << 63)
            held = np.empty(len(k), _ROW)
            held["lang"], held["log"], held["back"] = number, log, back
            cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                if lo == hi:
                    continue
                if now != (int(k[lo]), int(part[lo])):
                    if now is not None:
                        end()
                    now, last, n = (int(k[lo]), int(part[lo])), None, 0
                    made = f"{root}/.{uuid.uuid4().hex}"
                    out = [fs.open_output_stream(f"{made}.{kind}") for kind in ("keys", "starts", "rows")]
                some = keys[lo:hi]
                new = np.append(last is None or some[0] != last, some[1:] != some[:-1])
                out[0].write(some[new].tobytes())
                out[1].write((np.flatnonzero(new) + n).astype("<u8").tobytes())
                out[2].write(held[lo:hi].tobytes())
                last, n = some[-1], n + hi - lo
        if now is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["n"])

    fs, root = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    dealt = rows.select("k", "gram", "number", "log", "back").mapInArrow(keyed, "k int, part int, key bigint, number int, log double, back double")
    dealt = dealt.repartition(4 << bits, "k", "part").sortWithinPartitions("k", "part", "key", "number")
    dealt.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def withheld(docs: DataFrame, key: str, text: str, lang: str, rows: int = CALIBRATION_ROWS, least: int = LEAST_TAUGHT) -> Column:
    """Which training rows are judged instead of teaching: about ``rows`` at most and a tenth, by the hash of id and text."""
    taught = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()
    share = min(0.1, rows / max(1, sum(r["n"] for r in taught)))
    drawn = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40)) < int(share * (1 << 40))
    return F.coalesce(drawn & F.col(lang).cast("string").isin([r["g"] for r in taught]), F.lit(False))


def calibrate(model: Model, docs: DataFrame, key: str, text: str, lang: str, lengths: tuple[int, ...] = PIECES) -> Model:
    """Set strength, floor and limits on pieces of ``docs``, withheld rows of a bounded number.

    Each text that is long enough gives one piece of each of ``lengths`` symbols,
    from anywhere in the whole text, by the hash of id and text; equal pieces
    travel once, with their number.  The strength makes the mean confidence agree
    with the share that is right; the floor is the confidence that one in a
    thousand pieces stays under.  Of the pieces whose winner is right,
    ``QUANTILE`` of those of a length stay under its limit.
    """
    if not model.langs:
        return model
    some = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    some = some.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("g"), F.xxhash64(F.col(key), F.col(text)).alias("h"))

    def cut(batches):
        for batch in slices(batches):
            out = ([], [], [])
            for t, g, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if has_letter(t):
                    folded = fold(t)
                    for piece in lengths:
                        if len(folded) >= piece:
                            at = (h >> 8) % (len(folded) - piece + 1)
                            out[0].append("\n" + folded[at : at + piece].strip("\n") + "\n")
                            out[1].append(g)
                            out[2].append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], names=["t", "g", "k"])

    held = some.mapInArrow(cut, "t string, g string, k int").groupBy("t", "g", "k").agg(F.count(F.lit(1)).alias("n")).collect()
    if not held:
        return model
    held.sort()
    e = np.concatenate([model.entropies([r["t"] for r in held[lo : lo + 512]]) for lo in range(0, len(held), 512)])
    best_of = e.argmin(axis=1)
    right = np.array([model.langs[b] == r["g"] for b, r in zip(best_of.tolist(), held, strict=True)])
    sizes = np.array([len(r["t"]) for r in held])
    n = np.array([r["n"] for r in held], float)
    best = None
    for strength in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0):
        model.strength = strength
        c = model.confidence(e, sizes)
        loss = -np.average(np.where(right, np.log(np.maximum(c, 1e-9)), np.log(np.maximum(1 - c, 1e-9))), weights=n)
        if best is None or loss < best[0]:
            order = np.argsort(c)
            floor = c[order][np.searchsorted(np.cumsum(n[order]), 0.001 * n.sum())]
            best = (loss, strength, float(floor))
    _, model.strength, model.floor = best
    # Bits over each language's usual ones; a language without a long piece takes the mean of all.
    bits, kinds = e.min(axis=1), np.array([r["k"] for r in held])
    long = right & (kinds >= PIECES[2])
    if not long.any():
        return model
    mean = np.average(bits[long], weights=n[long])
    model.usual = np.array([np.average(bits[own], weights=n[own]) if (own := long & (best_of == b)).any() else mean for b in range(len(model.langs))])
    over, most = bits - model.usual[best_of], np.full(len(PIECES), np.nan)
    for i, piece in enumerate(PIECES):
        own = np.flatnonzero(right & (kinds == piece))
        if n[own].sum() >= LEAST_TAUGHT / 2:
            order = own[np.argsort(over[own])]
            most[i] = over[order][min(len(order) - 1, np.searchsorted(np.cumsum(n[order]), QUANTILE * n[own].sum()))]
    known = np.flatnonzero(~np.isnan(most))
    if not len(known):
        model.usual = None
        return model
    # Lengths without pieces take the next shorter one's limit; a longer text is never allowed more than a shorter one.
    most = np.interp(np.arange(len(PIECES)), known, most[known])
    model.most = np.maximum.accumulate(most[::-1])[::-1] + MARGIN
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected in place of the text; the model's path travels in the closure."""
    rest = [c for c in docs.columns if c not in (text, "_text", "lang_pred", "score", "rejected")]

    def run(batches):
        for batch in slices(batches, 512):
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            lang, score, low = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(rest))], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low)],
                names=[*rest, "lang_pred", "score", "rejected"],
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).cast("string").alias("_text"))
    schema = rows.drop("_text").limit(0).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("rejected", F.lit(True)).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def train_and_identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score, rejected: learns from the rows that are not held out."""
    held_out = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2
    train = docs.where(F.coalesce(~held_out, F.lit(True)))
    aside = withheld(train, key, text, lang)
    model = calibrate(fit(train.where(~aside), text, lang), train.where(aside), key, text, lang)
    out = identify(docs.select(F.col(key), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text)), model, text)
    # Run here, in small batches: the model and a large batch together would strain a small executor.
    return written(out, "languages")
