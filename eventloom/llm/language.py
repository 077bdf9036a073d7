"""Language identification in two steps: the family first, then the languages within it.

Families are told apart by linear support vector machines, one against the rest.
Within a family every two languages have a machine of their own; each machine gives
a vote, and margins break ties. Features are relative frequencies of hashed byte
trigrams of the whole lower-cased text, so a text's margin is the mean weight of its
n-grams: one table lookup per n-gram and machine.

The machines are trained on a bounded sample: of the distinct pairs of id and text of
each language the ``SAMPLE_ROWS`` with the least hashes, one row each, however often a row
is repeated or an id shared. The driver holds their non-zero features. Everything else sees
all texts.

Results by case: a null text or one without a letter gives ``und`` with score 0;
without training texts every text gives ``und``; with one language all texts with
letters get it; an empty table gives no rows; repeated rows and rows of null or shared
ids each give their own row and may all train; equal votes go by margin, then to the
language first in the alphabet; a very long text is one slice and one row of features;
columns of the input other than id, text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import filled, segment_sums, slices, text_bytes

#: Training texts per language at most (documented bound of the sample).
SAMPLE_ROWS = 800
#: Hash bins of n-grams, a power of two.
BINS = 1 << 13
EPOCHS = 30
#: Families of related languages (fixed values); a language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "ky", "uz", "tk"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa", "ur"],
    "semitic": ["ar", "he", "am", "mt"],
}
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def grams(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bins of byte trigrams, and the bounds between texts.

    ASCII letters are lower-cased; other ASCII bytes count as a space, so digits,
    punctuation and line ends say nothing about the language. A space goes before and after each text.
    """
    folded = raw.copy()
    upper = (folded >= 65) & (folded <= 90)
    folded[upper] += 32
    folded[(folded < 128) & ~((folded >= 97) & (folded <= 122))] = 32
    n = len(bounds) - 1
    padded = np.full(len(folded) + 2 * n, 32, np.uint32)
    at = np.arange(len(folded)) + np.repeat(2 * np.arange(n) + 1, np.diff(bounds))
    padded[at] = folded
    ends = bounds + 2 * np.arange(n + 1)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    three = ((a * np.uint32(65599) + b) * np.uint32(65599) + c) * np.uint32(2654435761) >> np.uint32(33 - BINS.bit_length())
    empty = (a == 32) & (b == 32)
    # Trigrams that run into the next text, or hold only spaces, go to bin 0, which has no weight.
    over = np.zeros(len(padded), bool)
    over[ends[1:] - 1] = True
    over[ends[1:] - 2] = True
    bins = np.where(empty | over[: len(three)], 0, three % np.uint32(BINS - 1) + 1)
    return bins.astype(np.int32), ends


def frequencies(texts: pa.Array) -> np.ndarray:
    """A dense row of n-gram frequencies per text, for training."""
    raw, bounds = text_bytes(texts)
    out = np.zeros((len(texts), BINS), np.float32)
    bins, ends = grams(raw, bounds)
    for i in range(len(texts)):
        own = bins[ends[i] : max(ends[i], ends[i + 1] - 2)]
        counts = np.bincount(own, minlength=BINS)
        counts[0] = 0
        out[i] = counts / max(1, counts.sum())
    return out


class Rows:
    """Sparse rows of features: the bins of row i and their values lie from ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.bounds = np.concatenate([[0], np.cumsum([len(at) for at, _ in rows])]).astype(np.int64)
        self.bins = np.concatenate([np.zeros(0, np.int32), *[at for at, _ in rows]]).astype(np.int32)
        self.values = np.concatenate([np.zeros(0, np.float32), *[v for _, v in rows]]).astype(np.float32)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins and values of some rows end to end, and the bounds between them."""
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.bounds[rows] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.bins[at], self.values[at], ends


def train_svm(x: Rows, rows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a linear machine over some rows (hinge loss, averaged sub-gradient steps in a fixed order). ``y`` is +1 or -1."""
    rng = np.random.default_rng(7)
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * len(y) / 2
    weights, total, regular = np.zeros(BINS), np.zeros(BINS), 1e-4
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            rate = 1 / (regular * (step + 1000))
            bins, values, ends = x.take(rows[part])
            wrong = y[part] * segment_sums(values * weights[bins], ends) < 1
            weights *= 1 - rate * regular
            if wrong.any():
                pull = np.where(wrong, y[part] * share[part], 0.0) / len(part)
                weights += rate * np.bincount(bins, np.repeat(pull, np.diff(ends)) * values, minlength=BINS)
            total += weights
    return (total / max(1, step)).astype(np.float32)


class Model:
    """Machines of the families (one against the rest) and of language pairs within a family."""

    def __init__(self, x: Rows, langs: list[str]) -> None:
        names = np.array(langs, object)
        self.langs = sorted(set(langs))
        self.families = sorted({family(lang) for lang in self.langs})
        groups = np.array([family(lang) for lang in langs], object)
        rows = []
        self.family_row: dict[str, int] = {}
        if len(self.families) > 1:
            for name in self.families:
                self.family_row[name] = len(rows)
                rows.append(train_svm(x, np.arange(len(langs)), np.where(groups == name, 1.0, -1.0)))
        self.pair_row: dict[tuple[str, str], int] = {}
        for i, first in enumerate(self.langs):
            for second in self.langs[i + 1 :]:
                if family(first) == family(second):
                    either = np.flatnonzero((names == first) | (names == second))
                    self.pair_row[first, second] = len(rows)
                    rows.append(train_svm(x, either, np.where(names[either] == first, 1.0, -1.0)))
        self.weights = np.stack(rows) if rows else np.zeros((0, BINS), np.float32)
        self.weights[:, 0] = 0

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Margin of every text under every machine: the mean weight of its n-grams."""
        raw, bounds = text_bytes(texts)
        bins, ends = grams(raw, bounds)
        stop = np.maximum(ends[:-1], ends[1:] - 2)
        real = np.concatenate([[0], np.cumsum(bins > 0)])
        n = np.maximum(1, real[np.minimum(stop, len(bins))] - real[ends[:-1]])
        out = np.empty((len(texts), len(self.weights)))
        for k, w in enumerate(self.weights):
            sums = np.concatenate([[0.0], np.cumsum(w[bins], dtype=np.float64)])
            out[:, k] = (sums[np.minimum(stop, len(bins))] - sums[ends[:-1]]) / n
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        margins = self.margins(texts)
        n = len(texts)
        sure = lambda m: 1 / (1 + np.exp(-2 * m))
        if self.family_row:
            by_family = margins[:, [self.family_row[f] for f in self.families]]
            chosen, score = by_family.argmax(axis=1), sure(by_family.max(axis=1))
        else:
            chosen, score = np.zeros(n, int), np.ones(n)
        langs = np.empty(n, object)
        for k, name in enumerate(self.families):
            members = [lang for lang in self.langs if family(lang) == name]
            mine = np.flatnonzero(chosen == k)
            votes = np.zeros((len(mine), len(members)))
            margin = np.zeros_like(votes)
            for (first, second), row in self.pair_row.items():
                if first in members:
                    m, i, j = margins[mine, row], members.index(first), members.index(second)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    margin[:, i] += m
                    margin[:, j] -= m
            best = (votes + 1e-3 * np.tanh(margin)).argmax(axis=1)
            langs[mine] = np.array(members, object)[best]
            if len(members) > 1:
                score[mine] *= sure(np.take_along_axis(margin, best[:, None], axis=1)[:, 0] / (len(members) - 1))
        return langs.tolist(), np.clip(score, 0.0, 1.0)


def fit(training: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on at most ``sample_rows`` texts of each language: columns ``doc_id``, ``text``, ``lang``."""
    usable = training.where("lang is not null and text is not null and trim(lang) <> ''").where(F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # The least hashes are found on hashes alone, so that no text is sorted; each stands for one row.
    hashes = usable.select("lang", "h").distinct()
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    few = hashes.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= sample_rows)
    chosen = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_r") <= sample_rows)
    # Bounded by languages times ``sample_rows``; repeated rows are one before anything is shuffled whole.
    rows = usable.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    found = rows.mapInArrow(_features, "lang string, h long, bins binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["h"]))
    pairs = [np.frombuffer(row["bins"], np.float32).reshape(2, -1) for row in found]
    return Model(Rows([(at.astype(np.int32), values) for at, values in pairs]), [r["lang"] for r in found])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for i in range(batch.num_rows):
            dense = frequencies(batch.column("text").slice(i, 1))[0]
            at = np.flatnonzero(dense)
            rows.append(np.stack([at.astype(np.float32), dense[at]]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(rows, pa.binary())], ["lang", "h", "bins"])


def identify(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``carry``, ``lang_pred`` and ``score``, one row per document, from the text alone."""
    kept = ["doc_id", *(carry or [])]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines x bins: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            langs, score = shared.value.predict(texts) if shared.value is not None else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            if shared.value is None:
                letters[:] = False
            named = [lang if ok else UNKNOWN for lang, ok in zip(langs, letters)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(named, pa.string()), pa.array(np.where(letters, score, 0.0))], [*kept, "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(carry or []), filled(text).alias("text"))
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
