"""Language identification by interpolated Kneser-Ney character models (op2).

A model of four-character grams is fitted for each language on at most about ``MAX_DOCS`` labelled documents a
language (those with the smallest hashes of id and text, whole texts). Texts are lower-cased; a run of anything but
letters is one boundary. The grams of all languages stand in sorted arrays of 64-bit keys, an order in each, with
every language's log probability beside the key; a gram that no language knows falls back to the shorter one with
the languages' weights of its context. The language of least cross-entropy a character is chosen.

All documents are scored in one pass over the texts. Rejection and score are then calibrated on every labelled
document that may be learned from and wasn't fitted, by sums over that pass's results: for each language the mean
cross-entropy and its variance, a part between documents and a part that falls with their length; the limit of the
standardised excess over that mean, which ``FALSE_REJECTIONS`` of them are above, whatever language they are taken
for; and the temperature of the softmax over languages (``score``) of least log loss, on a grid.

Defined results: null or letterless texts are `und` with score 0 and rejected. Without labelled documents all are
`und`, and `filter_documents` removes none for want of a model. With none to calibrate on, nothing else is rejected.
A null doc_id isn't held out and not learned from. Repeated rows are predicted each and learned from once; an empty
table gives an empty result. Long texts are scored in windows. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, fresh, per_text, pieces, read, table, trim, trimmed

ORDER = 4  # four 16-bit characters make a key
MAX_DOCS = 400
#: Tasks that count the sample's grams.
COUNTERS = 4
#: The share of labelled documents that may be rejected.
FALSE_REJECTIONS = 0.001
#: The temperatures tried, and the one without documents to calibrate on.
SHARPNESS, UNCALIBRATED = [2.0 ** (k / 2) for k in range(-2, 19)], 20.0
FOLD, HELD_OUT = 4, 2
#: Symbols scored at once, and the most languages (their counts come to the driver).
STEP, MAX_LANGUAGES = 1 << 20, 1000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the 16-bit number of its lower case, 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            low = ord(low) if len(low) == 1 else i
            table[i] = low if low < 0xFFFF else 0xFFFF
    return table


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the texts, each begun by a boundary, where each text starts, and its number of letters."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    symbols = np.zeros(len(codes) + 1, np.uint16)
    symbols[1:] = _letters()[codes]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[begins] = True
    # a boundary directly before the one that begins a text isn't needed twice
    out = symbols[keep]
    at = np.concatenate([[0], np.cumsum(per_text(keep, np.append(begins, len(keep))))])
    return out, at, per_text(out != 0, at)


def _grams(symbols: np.ndarray, at: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """The key of the gram that ends at each symbol of a window; what would reach into the text before is boundary."""
    high = len(symbols) if high is None else high
    key = symbols[low:high].astype(np.uint64)
    here = np.arange(low, high)
    place = here - at[np.searchsorted(at, here, "right") - 1]
    for k in range(1, ORDER):
        before = np.zeros(high - low, np.uint64)
        skip = max(0, k - low)
        before[skip:] = symbols[low + skip - k : high - k]
        before[place < k] = 0
        key |= before << np.uint64(16 * k)
    return key


def _tail(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters of the keys."""
    return keys & np.uint64((1 << (16 * order)) - 1) if order < ORDER else keys


class Model:
    """languages; for each order the sorted keys and an array (key, language) of log probabilities, and for orders
    over 1 the sorted keys of contexts and their log weights of falling back."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.keys, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        n = len(self.languages)
        if not n:
            return
        seen = {}
        for language, (keys, number) in counts.items():
            seen[language, ORDER] = (keys, number)
            for order in range(ORDER - 1, 0, -1):  # how many characters stand before it
                seen[language, order] = np.unique(_tail(seen[language, order + 1][0], order), return_counts=True)
        alphabet = max(1, len(np.unique(np.concatenate([seen[x, 1][0] for x in self.languages]))))
        probabilities: dict[int, np.ndarray] = {}
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([seen[x, order][0] for x in self.languages]))
            contexts = np.unique(keys >> np.uint64(16))
            p = np.zeros((len(keys), n))
            weights = np.ones((len(contexts), n))
            lower = probabilities[order - 1][np.searchsorted(self.keys[order - 1], _tail(keys, order - 1))] if order > 1 else np.full((len(keys), n), 1 / alphabet)
            for j, language in enumerate(self.languages):
                own, number = seen[language, order]
                ones, twos = (number == 1).sum(), (number == 2).sum()
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, own)] = number
                where = np.searchsorted(contexts, keys >> np.uint64(16))
                total = np.bincount(where, count, len(contexts))
                kinds = np.bincount(where, count > 0, len(contexts))
                known = total > 0
                weights[known, j] = discount * kinds[known] / total[known]
                p[:, j] = np.where(known[where], np.maximum(count - discount, 0) / np.maximum(total[where], 1), 0) + weights[where, j] * lower[:, j]
            self.keys[order], probabilities[order] = keys, p
            self.logs[order] = np.log(p).astype(np.float32)
            if order > 1:
                self.contexts[order], self.weights[order] = contexts, np.log(weights).astype(np.float32)
        self.unknown = -math.log(alphabet)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def losses(self, grams: np.ndarray) -> np.ndarray:
        """Minus the log probability of each gram's last character, by language."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        left = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            at, found = self._find(self.keys[order], _tail(grams[left], order))
            if order == ORDER and found.all():
                return -self.logs[order][at]
            out[left[found]] += self.logs[order][at[found]]
            left = left[~found]
            if not len(left):
                break
            if order > 1:
                at, found = self._find(self.contexts[order], _tail(grams[left], order) >> np.uint64(16))
                out[left[found]] += self.weights[order][at[found]]
            else:
                out[left] += self.unknown
        return -out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a symbol by text and language, the number of symbols, and of letters."""
        symbols, at, letters = _symbols(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        for low in range(0, len(symbols), STEP):
            high = min(len(symbols), low + STEP)
            losses = self.losses(_grams(symbols, at, low, high))
            first, last = np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high - 1, "right") - 1
            begins = np.maximum(at[first : last + 1], low) - low
            losses[begins[at[first : last + 1] >= low]] = 0  # the first boundary of a text
            sums[first : last + 1] += np.add.reduceat(losses, begins, axis=0, dtype=np.float64)
        n = np.maximum(np.diff(at) - 1, 1)
        return sums / n[:, None], n, letters


def learnable() -> Column:
    """Rows that may be learned from."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLD != HELD_OUT)


def _hash() -> Column:
    return F.xxhash64(F.lit("langid"), F.col("doc_id").cast("long"), "text")


def _looked_up(values: dict[str, int], key: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))[key]


@dataclass
class Fitted:
    """The model, and which rows it is fitted on: those of a hash below their language's share but for a tenth, and
    of each language that of the least hash, whatever its remainder is."""

    model: Model
    shares: dict[str, int] = field(default_factory=dict)
    least: dict[str, int] = field(default_factory=dict)

    def sampled(self) -> Column:
        return F.pmod(_hash(), F.lit(1 << 20)) < _looked_up(self.shares, F.col("lang"))

    def used(self) -> Column:
        return (self.sampled() & (F.pmod(F.shiftright(_hash(), 20), F.lit(10)) != 0)) | (_hash() == _looked_up(self.least, F.col("lang")))

    def calibrates(self) -> Column:
        return learnable() & ~self.used() if self.shares else F.lit(False)


def _as_texts(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist())
        texts = np.array(_as_texts(batch.column("text")), dtype=object)
        for language in np.unique(langs):
            symbols, at, _ = _symbols(list(texts[langs == language]))
            keys, n = np.unique(np.delete(_grams(symbols, at), at[:-1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([str(language)] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Fitted:
    """The sample holds about ``max_docs`` documents a language, so what comes to the driver is bounded."""
    rows = docs.filter(learnable())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(_hash()).alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Fitted(Model({}))
    # below a fraction of the hashes; of few documents all
    shares = {r["lang"]: math.ceil(min(1.0, max_docs / r["n"]) * (1 << 20)) for r in sizes}
    fitted = Fitted(Model({}), shares, {r["lang"]: r["least"] for r in sizes})
    sample = rows.filter(fitted.used()).select("lang", _hash().alias("_h"), "text").dropDuplicates(["lang", "_h"]).select("lang", "text")
    # the bounded sample in few tasks: each makes a row for every gram it meets, however many the texts are dealt over
    grams = sample.coalesce(COUNTERS).mapInArrow(trimmed(_count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for language, own in grams.groupby("lang"):
        keys = own["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        counts[language] = (keys[order], own["n"].to_numpy()[order])
    fitted.model = Model(counts)
    return fitted


def _scored(docs: DataFrame, model: Model) -> Column:
    """loss (an array by language), n, letters of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the bounded sample's grams

    @arrow_udf("struct<loss: array<double>, n: bigint, letters: bigint>")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for part in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            loss, n, letters = shared.value.entropies(_as_texts(part.column(0)))
            width = loss.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(loss) + 1) * width, pa.int32()), pa.array(loss.ravel()))
            out.append(pa.StructArray.from_arrays([lists, pa.array(n.astype(np.int64)), pa.array(letters)], ["loss", "n", "letters"]))
        trim()
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("loss", pa.list_(pa.float64())), ("n", pa.int64()), ("letters", pa.int64())]))

    return score("text")


@dataclass
class Calibration:
    """By language the mean of cross-entropy, its variance between documents, and that of a character; the limit of the
    standardised excess; the temperature."""

    limits: list[tuple[float, float, float]]
    limit: float = math.inf
    sharpness: float = UNCALIBRATED


def _excess(loss: Column, place: Column, n: Column, limits: list[tuple[float, float, float]]) -> Column:
    """How many standard deviations a cross-entropy is above its language's mean; ``place`` from 1."""
    mean, between, within = (F.element_at(F.array(*(F.lit(float(x[k])) for x in limits)), place) for k in range(3))
    return (loss - mean) / F.sqrt(between + within / n)


def _total(loss: Column, sharpness: float) -> Column:
    """The softmax's denominator, of excesses over the least loss."""
    best = F.array_min(loss)
    return F.aggregate(loss, F.lit(0.0), lambda a, v: a + F.exp(F.lit(-sharpness) * (v - best)))


def calibrate(scored: DataFrame, languages: list[str], false_rejections: float = FALSE_REJECTIONS) -> Calibration:
    """From rows (s: loss, n, letters; lang), of which only sums come to the driver."""
    if not languages:
        return Calibration([])
    # F.array_position counts from 1; 0: another language
    known = scored.withColumn("at", F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int")).filter("at > 0 and s.letters > 0")
    known = known.select("at", F.col("s.loss").alias("loss"), F.col("s.n").cast("double").alias("n"), F.element_at("s.loss", F.col("at")).alias("own"))
    means = {r["at"]: r["m"] for r in known.groupBy("at").agg(F.avg("own").alias("m")).collect()}
    if not means:
        return Calibration([(0.0, 1.0, 1.0)] * len(languages))
    overall = sum(means.values()) / len(means)
    mean = F.element_at(F.array(*(F.lit(float(means.get(i + 1, overall))) for i in range(len(languages)))), F.col("at"))
    r2, x = (F.col("own") - mean) ** 2, 1 / F.col("n")
    sums = {r["at"]: r for r in known.groupBy("at").agg(F.count("*").alias("c"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(r2).alias("r"), F.sum(r2 * x).alias("rx")).collect()}
    limits = []
    for i in range(len(languages)):
        between, within = 0.01, 1.0
        if i + 1 in sums and sums[i + 1]["c"] > 2:  # squared excess as a line over 1 / n
            own = sums[i + 1]
            spread = own["c"] * own["xx"] - own["x"] ** 2
            within = (own["c"] * own["rx"] - own["x"] * own["r"]) / spread if spread > 1e-12 else 0.0
            within = max(within, 1e-3)
            between = max((own["r"] - within * own["x"]) / own["c"], 1e-4)
        limits.append((means.get(i + 1, overall), between, within))
    # as in use: of the language that the text is taken for
    best = F.array_min("loss")
    place = F.array_position(F.col("loss"), best).cast("int")
    limit = known.agg(F.percentile_approx(_excess(best, place, F.col("n"), limits), 1 - false_rejections, 100_000)).first()[0]
    nll = [F.avg(F.log(_total(F.col("loss"), t)) + t * (F.col("own") - best)).alias(f"t{k}") for k, t in enumerate(SHARPNESS)]
    found = known.agg(*nll).first()
    return Calibration(limits, float(limit), SHARPNESS[int(np.argmin(list(found)))])


def predictions(s: Column, languages: list[str], found: Calibration) -> dict[str, Column]:
    """lang, score and rejected from a text's loss, n and letters, by built-in functions."""
    if not languages:
        return {"lang": F.lit("und"), "score": F.lit(0.0), "rejected": s["letters"] == 0}
    loss, lettered = s["loss"], s["letters"] > 0
    best = F.array_min(loss)
    place = F.array_position(loss, best).cast("int")
    score = 1 / _total(loss, found.sharpness)
    above = _excess(best, place, s["n"].cast("double"), found.limits) > found.limit if math.isfinite(found.limit) else F.lit(False)
    return {"lang": F.when(lettered, F.element_at(F.array(*map(F.lit, languages)), place)).otherwise("und"), "score": F.when(lettered, score).otherwise(0.0), "rejected": ~lettered | above}


def identify(docs: DataFrame, max_docs: int = MAX_DOCS, false_rejections: float = FALSE_REJECTIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLD == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    fitted = fit(rows, max_docs)
    scored = cut(rows.select("doc_id", F.when(fitted.calibrates(), F.col("lang")).alias("lang"), _scored(rows, fitted.model).alias("s")))
    languages = fitted.model.languages
    p = predictions(F.col("s"), languages, calibrate(scored, languages, false_rejections))
    return scored.select("doc_id", held.alias("held_out"), p["lang"].alias("lang_pred"), p["score"].alias("score"), p["rejected"].alias("rejected"))


def filter_documents(docs: DataFrame, max_docs: int = MAX_DOCS, false_rejections: float = FALSE_REJECTIONS) -> DataFrame:
    """The documents that aren't rejected, with their own columns. The scores are written beside the texts once, so that
    texts are neither scored twice nor shuffled."""
    fitted = fit(docs, max_docs)
    s, lang = fresh(docs, "_scored", "_lang")
    scored = table(docs.withColumns({lang: F.when(fitted.calibrates(), F.col("lang")), s: _scored(docs, fitted.model)}))
    languages = fitted.model.languages
    found = calibrate(scored.select(F.col(lang).alias("lang"), F.col(s).alias("s")), languages, false_rejections)
    return scored.filter(~predictions(F.col(s), languages, found)["rejected"]).drop(s, lang)


def op2_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
