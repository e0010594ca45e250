"""Language ID with interpolated Kneser-Ney character models.

One model per language gives the probability of every character after the ``ORDER - 1``
before it, interpolated down to a uniform distribution (Kneser-Ney: the lower orders count
distinct left neighbours). Spark counts the character n-grams of the training rows; the
models are sorted arrays of n-gram hashes with one column of log-probabilities per
language, broadcast to the workers. A text gets the language with the lowest cross-entropy
per character; where even the lowest lies above what labelled rows of that language and
about that length reach, the prediction is flagged as rejected.

The limits come from labelled rows that the models were not fitted on, by language and
length (short texts spread widest): their ``REJECT`` quantile plus ``MARGIN`` of its
distance from the language's median. A language with few such rows of a length takes the
distances of all languages, and of the next lengths while those are few too; one without
any takes the middle of the other medians. Without any such row at all, the limit is what
a uniform distribution over the characters reaches.

The models are fitted on at most ``SAMPLE`` rows per language, taken by the smallest
hashes of their keys; their whole texts count. That bounds the models, which are broadcast.
Prediction covers every row.

Defined results: ``und`` with score 0 for null texts and texts without a letter; a label whose
fitted rows hold no letter has no model and is never predicted; without any model every text
is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import Scratch, written

ORDER = 4
SAMPLE = 1000
DISCOUNT = 0.75
#: Quantile of the distances from the median, and the share of it added as a margin.
REJECT, MARGIN = 0.999, 0.5
#: Rows behind a limit. With fewer in all languages and lengths together, which say little
#: about a quantile so far out, the margin widens with the square of what is missing.
LEAST = 100
#: Lengths are told apart by powers of four characters, entropies by steps of 1 / STEPS nat.
LENGTHS, STEPS = 12, 200
#: Texts joined for one pass of array operations, in characters.
BATCH_CHARS = 1 << 19
SPACE, START = 32, 0


def symbols() -> np.ndarray:
    """For every code point its 16-bit symbol in the n-grams, SPACE for what is no letter.

    Letters up to U+FFFF stand for themselves. Those above, whole scripts among them, are
    folded into the codes of surrogates and private use, which are never letters: letters
    of one script stay apart, and every letter counts as one.
    """
    if symbols.made is None:
        code = np.arange(0x110000, dtype=np.uint32)
        folded = np.where(code < 0x10000, code, 0xD800 + code % (0xF900 - 0xD800))
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        symbols.made = np.where(letter, folded, SPACE).astype(np.uint64)
    return symbols.made


symbols.made = None


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed ORDER-grams of all texts, where each text's grams start).

    Texts are lower-cased, everything but letters becomes one space between words, and the
    first characters have START symbols before them. Every text ends with a space.
    """
    low = [t.lower() + " " for t in texts]
    raw = symbols()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) for t in low])
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    space = raw == SPACE
    doubled = space.copy()
    doubled[1:] &= space[:-1]
    doubled[begins] = space[begins]  # none at the start of a text
    kept = np.concatenate([[0], np.cumsum(~doubled)])
    starts, codes = kept[begins], raw[~doubled]
    keys = codes.copy()
    at = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    for back in range(1, ORDER):
        before = np.zeros(len(codes), np.uint64)
        before[back:] = codes[:-back] if len(codes) > back else 0
        before[at < back] = START
        keys |= before << np.uint64(16 * back)
    return keys, starts


def _suffix(keys: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` characters of packed grams."""
    return keys if n == 4 else keys & np.uint64((1 << (16 * n)) - 1)


class KneserNey:
    """Interpolated character models of several languages over shared sorted key arrays.

    For n = 1..ORDER, ``keys[n]`` are the n-grams seen in any language, ``logp[n]`` the
    interpolated log-probability of their last character in every language, ``contexts[n]``
    and ``loggamma[n]`` the weight that a context leaves to the order below.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = languages
        grams = [c[0] for c in counts]
        every = {n: np.unique(np.concatenate([_suffix(g, n) for g in grams])) for n in range(1, ORDER + 1)}
        alphabet = len(every[1]) + 1
        self.floor = -np.log(alphabet)
        self.limits = np.full((len(languages), LENGTHS), -self.floor)
        self.keys, self.logp, self.contexts, self.loggamma = every, {}, {}, {}
        tables = [self._counts(k, c) for k, c in counts]
        for n in range(1, ORDER + 1):
            self.contexts[n] = np.unique(every[n] >> np.uint64(16))
            p = np.zeros((len(every[n]), len(languages)))
            gamma = np.ones((len(self.contexts[n]), len(languages)))
            for i, table in enumerate(tables):
                keys, c = table[n]
                where = np.searchsorted(every[n], keys)
                ctx = np.searchsorted(self.contexts[n], keys >> np.uint64(16))
                total = np.bincount(ctx, c, len(gamma))
                kinds = np.bincount(ctx, minlength=len(gamma))
                seen = total > 0
                gamma[seen, i] = DISCOUNT * kinds[seen] / total[seen]
                p[where, i] = np.maximum(c - DISCOUNT, 0) / total[ctx]
            own = np.searchsorted(self.contexts[n], every[n] >> np.uint64(16))
            below = np.exp(self._lookup(_suffix(every[n], n - 1), n - 1)) if n > 1 else 1 / alphabet
            self.logp[n] = np.log(p + gamma[own] * below).astype(np.float32)
            self.loggamma[n] = np.log(gamma).astype(np.float32)

    @staticmethod
    def _counts(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each n the n-grams and their counts; below ORDER, of distinct left neighbours."""
        out = {ORDER: (keys, counts.astype(float))}
        for n in range(ORDER - 1, 0, -1):
            out[n] = np.unique(_suffix(out[n + 1][0], n), return_counts=True)
        return out

    def _lookup(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities, a row per key and a column per language."""
        if n == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        at = np.minimum(np.searchsorted(self.keys[n], keys), len(self.keys[n]) - 1)
        out = self.logp[n][at]
        miss = np.flatnonzero(self.keys[n][at] != keys)
        if len(miss):
            lost = keys[miss]
            out[miss] = self._lookup(_suffix(lost, n - 1), n - 1)
            ctx = lost >> np.uint64(16)
            c = np.minimum(np.searchsorted(self.contexts[n], ctx), len(self.contexts[n]) - 1)
            known = self.contexts[n][c] == ctx
            out[miss[known]] += self.loggamma[n][c[known]]
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character for each text and language, characters of each text, has it a letter?)."""
        out, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        lettered = np.zeros(len(texts), bool)
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= BATCH_CHARS):
                size += len(texts[last])
                last += 1
            keys, starts = gram_keys(texts[first:last])
            lens = np.diff(np.append(starts, len(keys)))
            sums = np.zeros((last - first, len(self.languages)))
            for at in range(0, len(keys), BATCH_CHARS):  # a very long text in parts
                part = self._lookup(keys[at : at + BATCH_CHARS], ORDER).astype(np.float64)
                owner = np.searchsorted(starts, np.arange(at, at + len(part)), "right") - 1
                cut = np.flatnonzero(np.diff(owner, prepend=-1))
                sums[owner[cut]] += np.add.reduceat(part, cut)
            out[first:last] = -sums / np.maximum(lens, 1)[:, None]
            sizes[first:last] = lens
            letters = np.concatenate([[0], np.cumsum((keys & np.uint64(0xFFFF)) != SPACE)])
            lettered[first:last] = letters[starts + lens] > letters[starts]
            first = last
        return out, sizes, lettered


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum((np.log2(np.maximum(sizes, 1)) / 2).astype(np.int64), LENGTHS - 1)


def _quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    """The least of ``values``, each held by ``n`` rows, that a share ``q`` of the rows does not exceed."""
    order = np.argsort(values)
    upto = np.cumsum(n[order])
    return float(values[order][np.searchsorted(upto, q * upto[-1])])


def limits_of(
    languages: int, lang: np.ndarray, length: np.ndarray, entropy: np.ndarray, n: np.ndarray, uniform: float
) -> np.ndarray:
    """Highest accepted entropy by language and length class, from counted calibration rows."""
    out = np.full((languages, LENGTHS), uniform)
    if not len(n):
        return out
    medians = np.full(languages, np.nan)
    for i in np.unique(lang):
        medians[i] = _quantile(entropy[lang == i], n[lang == i], 0.5)
    medians = np.where(np.isnan(medians), np.nanmedian(medians), medians)
    away = entropy - medians[lang]
    for i in range(languages):
        for b in reversed(range(LENGTHS)):
            rows, reach = (lang == i) & (length == b), 0
            while n[rows].sum() < LEAST and reach < LENGTHS:
                rows, reach = np.abs(length - b) <= reach, reach + 1
            spread = max(_quantile(away[rows], n[rows], REJECT), 1 / STEPS)
            out[i, b] = medians[i] + spread * (1 + MARGIN * max(1.0, LEAST / n[rows].sum()) ** 2)
        # a shorter text may lie as far off as a longer one
        out[i] = np.maximum.accumulate(out[i][::-1])[::-1]
    return out


def crc_of(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def _slices(train: DataFrame, key: str, text: str, lang: str, sample: int) -> DataFrame:
    """(lang, text, fit, check): rows to fit on and rows to calibrate on.

    Shares follow each label's number of rows, a table of one row per label that is joined,
    not collected. Rows are told apart by a hash of key and text.
    """
    unit = 1 << 30
    share = F.least(F.lit(0.8), sample / F.col("_n"))
    more = F.when(share < 0.8, F.greatest(F.lit(0.2), share)).otherwise(1.0)
    sizes = train.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("_n"))
    bounds = sizes.select(
        "lang", F.floor(unit * share).alias("_low"), F.floor(unit * F.least(F.lit(1.0), share + more)).alias("_high")
    )
    draw = F.pmod(F.xxhash64(F.lit("sample"), key, text), F.lit(unit)).alias("_draw")
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw).join(written(bounds, "languages"), "lang")
    fit = F.col("_draw") < F.col("_low")
    return rows.select("lang", "text", fit.alias("fit"), (~fit & (F.col("_draw") < F.col("_high"))).alias("check"))


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                own = [t for n, t in zip(names, texts, strict=True) if n == name]
                for first in range(0, len(own), 256):
                    keys, n = np.unique(gram_keys(own[first : first + 256])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    counted = rows.mapInArrow(scan, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_models(train: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE) -> KneserNey | None:
    """Models and rejection limits from rows with non-null text and language."""
    with Scratch() as scope:
        scope.only()  # the model is in memory
        rows = _slices(train, key, text, lang, sample)
        # at most one row per n-gram of the bounded sample reaches the driver
        counts = count_grams(rows.filter("fit").select("lang", "text")).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
        names = np.array(counts.column("lang").to_pylist(), object)
        grams, n = counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy()
        per_language = []
        fitted = sorted(set(names))  # a label without a letter in its rows has no model
        for name in fitted:
            own, order = names == name, np.argsort(grams[names == name])
            per_language.append((grams[own][order], n[own][order]))
        if not fitted:
            return None
        model = KneserNey(fitted, per_language)
        model.limits = calibrated(rows.filter("check").select("lang", "text"), model)
        return model


def calibrated(rows: DataFrame, model: KneserNey) -> np.ndarray:
    """Rejection limits from rows (lang, text) outside the fitted ones.

    Rows whose language is predicted right count. One row per language, length class and step
    of the entropy reaches the driver, whose number the input does not change.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            entropy, sizes, lettered = m.cross_entropies(texts)
            best = entropy.argmin(1)
            right = np.array([m.languages[b] == name for b, name in zip(best, batch.column(0).to_pylist(), strict=True)], bool)
            right &= lettered
            step = np.ceil(entropy[np.arange(len(best)), best] * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[right]) for x in (best, length_class(sizes), step)], names=["lang", "length", "step"]
            )

    told = rows.mapInArrow(scan, "lang long, length long, step long").groupBy("lang", "length", "step")
    counts = told.agg(F.count(F.lit(1)).alias("n")).toArrow()
    lang, length, step, n = (counts.column(c).to_numpy() for c in ("lang", "length", "step", "n"))
    return limits_of(len(model.languages), lang, length, step / STEPS, n, -model.floor)


PREDICTED = ("lang_pred", "score", "cross_entropy", "rejected")


def predict(
    docs: DataFrame, model: KneserNey | None, text: str, keep: list[str], names: tuple[str, ...] = PREDICTED
) -> DataFrame:
    """The ``keep`` columns with language, score, cross-entropy and rejection for every row."""
    kinds = ("string", "double", "double", "boolean")
    if model is None:
        none = [F.lit("und"), F.lit(0.0), F.lit(None).cast("double"), F.lit(True)]
        return docs.select(*keep, *[c.alias(n) for c, n in zip(none, names, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep) if text in keep else docs.select(*keep, text)
    place = kept.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            entropy, sizes, lettered = m.cross_entropies(texts)
            best = entropy.argmin(1)
            least = entropy[np.arange(len(best)), best]
            share = 1 / np.exp(np.maximum((least[:, None] - entropy) * sizes[:, None], -700)).sum(1)
            over = ~lettered | (least > m.limits[best, length_class(sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    pa.array([m.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], pa.string()),
                    pa.array(np.where(lettered, share, 0.0)),
                    pa.array(least, mask=~lettered),
                    pa.array(over),
                ],
                names=[*keep, *names],
            )

    old = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    new = [f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]
    return kept.mapInArrow(scan, ", ".join([*old, *new]))


def learnt(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> KneserNey | None:
    """Models from the labelled rows outside the held-out third."""
    train = docs.filter((crc_of(key) % 3 != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    return fit_models(train, key, text, lang)


def op5_language_id(docs: DataFrame) -> DataFrame:
    held = docs.withColumn("held_out", crc_of("doc_id") % 3 == 1)
    return predict(held, learnt(docs), "text", ["doc_id", "held_out"])
