"""Language identification by interpolated Kneser-Ney character models.

One model of character n-grams is counted for each language from a bounded sample of labelled
rows.  It is held as arrays sorted by the n-grams' hashes, with their log-probabilities and, for
contexts, the weight of the next lower order.  A text gets the language of the least cross-entropy
for each character.  Further labelled rows calibrate the temperature that makes probabilities of
the entropies, and the entropy beyond which a text is in none of the languages.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.llm.common import cut, sized_broadcast

ORDER = 4
#: Characters of labelled text for each language that the models, and their calibration, are taken from.
TRAIN_CHARS, CALIBRATION_CHARS = 30_000_000, 4_000_000
#: What bounds the n-grams of the highest order: all languages together keep 1 / (2 * order) of it, in even shares, and
#: beyond its share a language's rarest go.  Lower orders are whole; only the sample bounds them.
MOST_GRAMS = 3_000_000
#: A text is rejected if its entropy is this many bits, and so many standard errors, above its language's mean.
REJECT_BITS, REJECT_ERRORS = 1.5, 8.0
UNKNOWN = "und"
_TEMPERATURES = [2.0**i for i in range(-6, 7)]
#: Characters that are scored, and counted, at once, and windows whose bits a worker keeps, newer ones in a small table of their own.
_PIECE, _COUNTED, _KEPT, _NEWER = 1 << 17, 1 << 19, 1 << 18, 1 << 15
#: Rows of an Arrow batch that are texts in Python at once, where they are scored and where they are counted.
_SCORED_ROWS, _COUNTED_ROWS = 256, 1024
_NEVER = 1e-7  # probability of a character that a language has never had
_FACTOR, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def _folding() -> np.ndarray:
    """Code point to its lower-case letter or mark, or to a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x32400):  # no letters lie beyond
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(text: str) -> np.ndarray:
    """The text's letters in lower case as code points, one space for each run of anything else."""
    x = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = x == 32
    return x[~(gap & np.r_[False, gap[:-1]])] if len(x) else x


def hashes(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    h = np.full(len(windows), windows.shape[1], np.uint64)
    for column in windows.T:
        h = (h + column) * _FACTOR
        h ^= h >> np.uint64(29)
    return h * _LAST


def _windows(texts: Iterable[str | None], order: int, piece: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some places of the texts at a time: the `order` characters up to each, and the text's number.  Spaces stand before a text."""
    codes, owners, size = [], [], 0
    pad = np.full(order - 1, 32, np.uint32)

    def taken() -> tuple[np.ndarray, np.ndarray]:
        owner = np.concatenate(owners)[order - 1 :]
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(codes), order)
        return windows[owner >= 0], owner[owner >= 0]

    for number, text in enumerate(texts):
        for at in range(0, len(text or ""), piece):
            x = folded(text[at : at + piece])
            codes += [np.r_[pad, folded(text[max(0, at - 64) : at])][1 - order :], x]
            owners += [np.full(order - 1, -1), np.full(len(x), number)]
            size += len(x)
            if size >= piece:
                yield taken()
                codes, owners, size = [], [], 0
    if size:
        yield taken()


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, and a place where each distinct one is."""
    numbers, distinct = pd.factorize(values)
    first = np.empty(len(distinct), np.int64)
    first[numbers[::-1]] = np.arange(len(values))[::-1]
    return numbers, first


@dataclass
class Models:
    """languages[i] has grams[i] and contexts[i]: for each size, hashes in ascending order and log2 of p or of the weight."""

    order: int
    languages: list[str]
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]
    temperature: float = 1.0
    means: np.ndarray | None = None
    spreads: np.ndarray | None = None

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """-log2 p of each window's last character, a column for each language."""
        of_grams = [hashes(windows[:, self.order - size :]) for size in range(1, self.order + 1)]
        of_contexts = [hashes(windows[:, self.order - size : -1]) for size in range(2, self.order + 1)]
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            log_p = np.full(len(windows), math.log2(_NEVER), np.float32)
            for size in range(self.order):
                if size:
                    log_p += _looked_up(*self.contexts[i][size - 1], of_contexts[size - 1], 0.0)
                own = _looked_up(*self.grams[i][size], of_grams[size], np.nan)
                log_p = np.where(np.isnan(own), log_p, own)
            out[:, i] = -log_p
        return out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(missing))


class Scorer:
    """Entropies of texts; the bits of windows met before are kept, within a bound."""

    def __init__(self, models: Models):
        self.models = models
        self.old, self.new = self._table(), self._table()

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        return np.empty(0, np.uint64), np.empty((0, len(self.models.languages)), np.float32)

    @staticmethod
    def _merged(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys = np.r_[x[0], y[0]]
        order = np.argsort(keys)
        return keys[order], np.r_[x[1], y[1]][order]

    def _bits(self, keys: np.ndarray, windows: np.ndarray) -> np.ndarray:
        out, open_ = np.empty((len(keys), len(self.models.languages)), np.float32), np.ones(len(keys), bool)
        for held, values in (self.old, self.new):
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                known = open_ & (held[at] == keys)
                out[known] = values[at[known]]
                open_ &= ~known
        if open_.any():
            out[open_] = fresh = self.models.bits(windows[open_])
            self.new = self._merged(self.new, (keys[open_], fresh))
            if len(self.new[0]) > _NEWER:
                self.old, self.new = self._merged(self.old if len(self.old[0]) < _KEPT else self._table(), self.new), self._table()
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits for each character by text and language, and the number of characters."""
        n, languages = len(texts), len(self.models.languages)
        sizes, sums = np.zeros(n), np.zeros((n, languages))
        for windows, owner in _windows(texts, self.models.order):
            keys = hashes(windows)
            numbers, first = _distinct(keys)
            bits = self._bits(keys[first], windows[first])
            sizes += np.bincount(owner, minlength=n)
            for i in range(languages):
                sums[:, i] += np.bincount(owner, weights=bits[numbers, i], minlength=n)
        return sums / np.maximum(sizes, 1)[:, None], sizes


def bounded_sample(rows: DataFrame, group: str, text_col: str, chars: int) -> DataFrame:
    """Rows of each group by their hash, at a rate at which about `chars` characters of it are taken."""
    totals = cut(rows.groupBy(group).agg(F.sum(F.length(text_col)).alias("_chars")))
    totals = sized_broadcast(totals, totals.count())  # so that no row moves, whatever share a group has
    place = F.shiftrightunsigned(F.xxhash64(*rows.columns), 1) / float(1 << 63)
    return rows.join(totals, group).where(place * F.col("_chars") < chars).drop("_chars")


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _COUNTED_ROWS):
                part, texts = batch.slice(at, _COUNTED_ROWS), {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    texts.setdefault(lang, []).append(text)
                for lang, of in texts.items():
                    for windows, _ in _windows(of, order, _COUNTED):
                        numbers, first = _distinct(hashes(windows))
                        flat = windows[first].astype("<u4").tobytes().decode("utf-32-le")
                        grams = [flat[i : i + order] for i in range(0, len(flat), order)]
                        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams, "n": np.bincount(numbers)})

    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int, least: dict[str, int] | None = None) -> list[DataFrame]:
    """For each size from 1 to order, (lang, gram, context, p, weight) of the n-grams by interpolation
    with the next lower size; the lower sizes count the characters before an n-gram.

    Of the highest size only n-grams with their language's `least` count stay.  They go after
    everything is counted, and what they had is their context's weight of the next lower size."""
    tables, at = {order: counts}, counts
    for size in range(order - 1, 0, -1):
        at = at.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        tables[size] = at
    lower, out = None, []
    for size in range(1, order + 1):
        table = tables[size]
        discounts = table.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos"))
        discounts = discounts.select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(F.try_divide("ones", F.col("ones") + 2 * F.col("twos")), F.lit(0.5)))).alias("d"))
        context = W.partitionBy("lang", "context")
        table = table.withColumn("context", F.substring("gram", 1, size - 1)).select("*", F.sum("n").over(context).alias("total"), F.count("*").over(context).alias("kinds"))
        table = table.join(discounts, "lang").withColumn("weight", F.col("d") * F.col("kinds") / F.col("total"))
        if size == order and least and max(least.values()) > 1:
            bounds = counts.sparkSession.createDataFrame(list(least.items()), "lang string, least long")
            table = table.join(F.broadcast(bounds), "lang").withColumn("stays", F.col("n") >= F.col("least"))  # a row a language
            own = F.sum(F.when(F.col("stays"), F.col("n") - F.col("d")).otherwise(0.0)).over(context)
            table = table.withColumn("weight", 1 - own / F.col("total")).where("stays")
        if lower is None:
            table = table.withColumn("below", F.lit(_NEVER))
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            table = table.withColumn("suffix", F.expr("substring(gram, 2)")).join(below, ["lang", "suffix"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")
        lower = cut(table.select("lang", "gram", "context", p.alias("p"), "weight"))
        out.append(lower)
    return out


def _arrays(table: DataFrame, key: str, value: str, languages: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """One language's arrays after the other; the sample bounds the table's rows."""
    pdf = table.select("lang", F.col(key).alias("key"), F.log2(value).alias("value")).toArrow().to_pandas()
    out = []
    for lang in languages:
        of = pdf[pdf["lang"] == lang]
        h = hashes(np.frombuffer("".join(of["key"]).encode("utf-32-le"), np.uint32).reshape(-1, size)) if len(of) else np.empty(0, np.uint64)
        order = np.argsort(h)
        out.append((h[order], of["value"].to_numpy(np.float32)[order]))
    return out


def _least_counts(counts: DataFrame, most: int) -> dict[str, int]:
    """For each language the least count of the n-grams that stay, `most` of all of them.

    Languages share evenly, and what one with few n-grams leaves goes to the others."""
    bins: dict[str, list[tuple[int, int]]] = {}
    for lang, n, rows in counts.groupBy("lang", F.least("n", F.lit(10_000)).alias("n")).count().orderBy("lang", F.desc("n")).collect():
        bins.setdefault(lang, []).append((n, rows))
    out, left = {}, most
    by_size = sorted(bins, key=lambda lang: (sum(rows for _, rows in bins[lang]), lang))
    for i, lang in enumerate(by_size):
        kept, share, out[lang] = 0, left // (len(by_size) - i), bins[lang][0][0] + 1
        for n, rows in bins[lang]:
            if kept + rows > share:
                break
            kept, out[lang] = kept + rows, n
        else:
            out[lang] = 1
        left -= kept
    return out


def fit(train: DataFrame, calibration: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER, train_chars: int = TRAIN_CHARS, calibration_chars: int = CALIBRATION_CHARS, most_grams: int = MOST_GRAMS) -> Models:
    """Models of all languages that label a text with a letter; rows without language or text are passed over."""
    labelled = lambda rows: rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = cut(gram_counts(bounded_sample(labelled(train), "lang", "text", train_chars), order))
    tables = kneser_ney(counts, order, _least_counts(counts, most_grams // (2 * order)))
    languages = sorted(r[0] for r in tables[0].select("lang").distinct().collect())
    of_grams = [_arrays(t, "gram", "p", languages, size) for size, t in enumerate(tables, 1)]
    of_contexts = [_arrays(t.select("lang", "context", "weight").distinct(), "context", "weight", languages, size) for size, t in enumerate(tables[1:], 1)]
    models = Models(order, languages, [list(x) for x in zip(*of_grams)], [list(x) for x in zip(*of_contexts)])
    if languages:
        _calibrate(models, bounded_sample(labelled(calibration), "lang", "text", calibration_chars))
    return models


def _calibrate(models: Models, rows: DataFrame) -> None:
    own = F.array_position(F.array(*map(F.lit, models.languages)), F.col("lang")).cast("int") - 1
    rows = rows.withColumn("x", _entropies(models)(F.col("text"))).select("lang", F.get("x.bits", own).alias("own"), F.transform("x.bits", lambda b: (b - F.array_min("x.bits")) * F.sqrt("x.n")).alias("over"), (F.get("x.bits", own) - F.array_min("x.bits")).alias("lost"), F.col("x.n").alias("n"))
    rows = cut(rows.where("own is not null"))
    loss = lambda t: F.sum(F.log(F.aggregate("over", F.lit(0.0), lambda acc, o: acc + F.exp(-o / t))) + F.col("lost") * F.sqrt("n") / t)
    losses = rows.agg(*[loss(t) for t in _TEMPERATURES]).first()
    if losses[0] is not None:
        models.temperature = min(zip(losses, _TEMPERATURES))[1]
    means = rows.groupBy("lang").agg((F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("mean"))
    # residuals of the longer ones are mostly of their own; the spread is that of a character
    spread = rows.join(means, "lang").groupBy("lang").agg(F.first("mean"), F.sqrt(F.avg((F.col("own") - F.col("mean")) ** 2 * F.col("n"))))
    by_language = {lang: (mean, sd) for lang, mean, sd in spread.collect()}
    missing = (math.inf, 0.0)
    models.means = np.array([by_language.get(lang, missing)[0] for lang in models.languages])
    models.spreads = np.array([by_language.get(lang, missing)[1] for lang in models.languages])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _entropies(models: Models):
    shared = _shared(models)

    @F.arrow_udf("bits array<double>, n double")
    def entropies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in _slices(batches):
            bits, n = scorer.entropies(texts)
            yield pa.StructArray.from_arrays([pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(n, pa.float64())], ["bits", "n"])

    return entropies.asNondeterministic()  # so that a filter on the result doesn't compute it a second time


def _slices(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    for batch in batches:
        for at in range(0, len(batch), _SCORED_ROWS):
            yield batch.slice(at, _SCORED_ROWS).to_pylist()


def _shared(models: Models):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(models)  # bounded by MOST_GRAMS and the sample


def identify(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The columns of docs with lang_pred, score, entropy and rejected after them.

    lang_pred has the least entropy for each character, of equal ones the first by name; it is
    `und`, rejected, with score 0 and no entropy, if the text is null or has no letter or if there
    are no models.  The score is a probability.  rejected tells that the entropy is above what the
    language's own texts of that length have.  Whole texts are read, in pieces.  Columns of docs
    with one of these names are replaced; repeated rows are rows like any other; an empty table
    gives no rows."""
    names = ["lang_pred", "score", "entropy", "rejected"]
    docs = docs.drop(*names)
    if not models.languages:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    shared = _shared(models)

    @F.arrow_udf("lang_pred string, score double, entropy double, rejected boolean")
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scorer, names = Scorer(m), np.array(m.languages, object)
        for texts in _slices(batches):
            bits, n = scorer.entropies(texts)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            p = 1 / np.exp((least[:, None] - bits) * np.sqrt(n)[:, None] / m.temperature).sum(axis=1)
            rejected = np.zeros(len(bits), bool)
            if m.means is not None:
                rejected = (least - m.means[best] - REJECT_BITS) * np.sqrt(n) > REJECT_ERRORS * m.spreads[best]
            found = [pa.array(names[best], pa.string()), pa.array(p, pa.float64()), pa.array(least, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.StructArray.from_arrays(found, ["lang_pred", "score", "entropy", "rejected"])

    found = docs.withColumn("_found", F.when(has_letter(F.col(text_col)), decide.asNondeterministic()(F.col(text_col))))
    none = F.col("_found").isNull()
    values = [F.coalesce(F.col("_found.lang_pred"), F.lit(UNKNOWN)), F.coalesce(F.col("_found.score"), F.lit(0.0)), F.col("_found.entropy"), none | F.col("_found.rejected")]
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(name) for v, name in zip(values, names)])
