"""Problem 8: the reading level of each document, by regularised ordinal regression.

1. Word counts over all documents go into a table of fixed size (2^18 shared counters): rarity.
2. One pass gives every document its features: length, lexical diversity, word rarity, connectives,
   clause depth and word length, from vectorised word hashes. The language is told by function words;
   texts with none of them are a group of their own.
3. Features are standardised per language with means and deviations over all documents.
4. A proportional-odds model with a quadratic penalty is fitted to the median rating of the rated
   documents, at most MAX_RATED of them (those with the least hash of their id); its thresholds
   calibrate it to the graded scale.
5. Every document gets the level of highest probability.

Defined results: NULL text gives no features and no level; repeated ratings of one rater count once;
NULL ratings and ratings of unknown documents are ignored; with no usable rating there are no levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerforge.llm.pairs import bucket_of, rarity_table
from answerforge.llm.words import batch_hashes, chunks, fold, shingle_sets, word_hashes
from answerforge.session import materialize

MAX_RATED = 20_000
LEVELS = 4
# Fixed values, chosen by hand for this module from the common grammar words of each language: function words that tell the
# language, and connectives by what they demand of the reader.
FUNCTION_WORDS = {
    "en": "the of and to in that was with from by",
    "fr": "le la les des du un une dans sous avec sur",
    "de": "der die das ein eine und im durch gegen um ohne",
    "es": "el la los las del un una tras desde hasta con",
}
CONNECTIVES = {
    "easy": "and but so or then et mais puis ou donc alors und aber doch oder denn y pero o luego",
    "middle": "because since while when after before if though although until unless parce quand tandis lorsque puisque comme bien weil während wenn nachdem obwohl da damit bevor vielmehr sondern porque mientras cuando aunque si después como pues",
    "hard": "whereas notwithstanding insofar inasmuch provided albeit hence thereby moreover nevertheless quoique contrairement conformément nonobstant attendu toutefois néanmoins cependant obgleich wohingegen demgegenüber insofern ungeachtet nichtsdestotrotz gleichwohl obstante independientemente considerando consecuencia conforme asimismo empero",
}
_BANDS = np.array([-6.0, -5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0])
_END = re.compile(r"[.!?…]+(?=\s|$)")
FEATURES = (
    *(f"rarity_{i}" for i in range(len(_BANDS) + 1)),
    "mean_rarity", "mean_length", "long_8", "long_10", "long_13", "diversity", "words_per_end", "commas", "semicolons", "easy", "middle", "hard", "clauses", "log_words", "common_long", "depth",
)
LANGS = (*FUNCTION_WORDS, "other")


def _hash_words(words: str) -> np.ndarray:
    return np.sort(word_hashes(np.frombuffer(fold(words) + b" ", np.uint8))[1])


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Extractor:
    def __init__(self, rarity: np.ndarray):
        self.log = np.log10(np.maximum(rarity, 1) / max(1, rarity.sum())).astype(np.float32)
        self.lang = {k: _hash_words(v) for k, v in FUNCTION_WORDS.items()}
        self.links = {k: _hash_words(v) for k, v in CONNECTIVES.items()}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(features, language number) of texts; a text without words has zeros."""
        parts = [fold(t) for t in texts]
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        starts, hashes = word_hashes(data)
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        counts = np.diff(np.searchsorted(starts, bounds))
        n = len(texts)
        owner = np.repeat(np.arange(n), counts)
        # Letters, not bytes: continuation bytes don't count.
        letters = np.cumsum(np.append(0, (data & 0xC0) != 0x80))
        space_after = np.flatnonzero(data == 32)
        ends = space_after[np.searchsorted(space_after, starts)]
        length = (letters[ends] - letters[starts]).astype(np.float64)
        rare = self.log[bucket_of(hashes)]
        total = np.maximum(counts, 1)

        def share(mask: np.ndarray) -> np.ndarray:
            return np.bincount(owner[mask], minlength=n) / total

        def mean(x: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=x, minlength=n) / total

        band = np.searchsorted(_BANDS, rare)
        bands = np.bincount(owner * (len(_BANDS) + 1) + band, minlength=n * (len(_BANDS) + 1)).reshape(n, -1) / total[:, None]
        distinct = np.bincount(shingle_sets(hashes, counts, 1)[1], minlength=n)
        marks = np.array([(len(_END.findall(t)), t.count(","), t.count(";")) if t else (0, 0, 0) for t in texts], np.float64).reshape(n, 3)
        sentences = np.maximum(marks[:, 0], 1)
        links = {k: share(_member(hashes, v)) for k, v in self.links.items()}
        cols = [
            *bands.T, mean(rare), mean(length), share(length >= 8), share(length >= 10), share(length >= 13), distinct / np.sqrt(total),
            np.log1p(counts / sentences), marks[:, 1] / total, marks[:, 2] / total, links["easy"], links["middle"], links["hard"],
            np.log1p((marks[:, 1] + marks[:, 2]) / sentences), np.log1p(counts), share((length >= 9) & (rare > -4.5)),
            np.log1p((links["middle"] + links["hard"]) * total / sentences + marks[:, 1] / sentences),
        ]
        told = np.stack([share(_member(hashes, v)) for v in self.lang.values()], 1)
        spoken = np.where(told.max(1) > 0, told.argmax(1), len(LANGS) - 1)
        return np.stack(cols, 1), spoken


def _word_batches(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    texts = batch.column(0).to_pylist()
    for _, part in chunks(texts, texts):
        yield batch_hashes(part)[0]


def _features(rarity: np.ndarray, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(rarity)
        for batch in batches:
            for keys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if min_words:
                    enough = [len(t.split()) >= min_words for t in texts]
                    keys, texts = [k for k, e in zip(keys, enough) if e], [t for t, e in zip(texts, enough) if e]
                if not keys:
                    continue
                x, lang = extract(texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lang.astype(np.int8)), *(pa.array(c.astype(np.float32)) for c in x.T)], names=["doc_id", "spoken", *FEATURES])

    return run


def document_features(docs: DataFrame, key: str, text: str, which: str = "true", min_words: int = 0) -> DataFrame:
    """Features of the documents for which `which` holds, with at least min_words words by white space; word
    rarity is counted over all documents."""
    rarity = rarity_table(docs.select(text).where(F.col(text).isNotNull()), _word_batches)
    base = docs.where(which).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    return base.mapInArrow(_features(rarity, min_words), "doc_id bigint, spoken tinyint, " + ", ".join(f"{f} float" for f in FEATURES))


def language_moments(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations per language over all documents: a few rows whatever the corpus."""
    stats = features.groupBy("spoken").agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).collect()
    mean, dev = np.zeros((len(LANGS), len(FEATURES))), np.ones((len(LANGS), len(FEATURES)))
    for r in stats:
        mean[r["spoken"]] = [r[f"m_{f}"] for f in FEATURES]
        dev[r["spoken"]] = [max(r[f"s_{f}"] or 0.0, 1e-6) for f in FEATURES]
    return mean, dev


def standardised(x: np.ndarray, spoken: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """Standard scores, clipped, and the squares of those, less 1: a level need not be linear in a feature."""
    z = np.clip((x - mean[spoken]) / dev[spoken], -4, 4)
    return np.concatenate([z, (z * z - 1) / 4], 1)


class OrdinalRegression:
    """Proportional odds: P(level <= k) = 1 / (1 + exp(score - cut_k)); penalised maximum likelihood."""

    def __init__(self, levels: int = LEVELS, penalty: float = 5.0, steps: int = 1500, rate: float = 0.05):
        self.levels, self.penalty, self.steps, self.rate = levels, penalty, steps, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> OrdinalRegression:
        n, k = len(y), self.levels
        w = np.zeros(x.shape[1])
        share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / n, 0.5 / n, 1 - 0.5 / n)
        first = np.log(share / (1 - share))
        cuts = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
        moment, square = np.zeros(len(w) + k - 1), np.zeros(len(w) + k - 1)
        for step in range(1, self.steps + 1):
            edge = np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
            s = x @ w
            upper = np.where(y < k - 1, edge[np.minimum(y, k - 2)] - s, 40.0)
            lower = np.where(y > 0, edge[np.maximum(y - 1, 0)] - s, -40.0)
            pu, pl = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
            p = np.maximum(pu - pl, 1e-12)
            du, dl = pu * (1 - pu) * (y < k - 1) / p, pl * (1 - pl) * (y > 0) / p
            gw = x.T @ (du - dl) / n + self.penalty * w / n
            ge = np.array([-(du[y == j].sum() - dl[y == j + 1].sum()) / n for j in range(k - 1)])
            gc = np.concatenate([[ge.sum()], [ge[j:].sum() * np.exp(cuts[j]) for j in range(1, k - 1)]])
            g = np.concatenate([gw, gc])
            moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
            move = self.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
            w, cuts = w - move[: len(w)], cuts - move[len(w) :]
        self.w, self.edge = w, np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.edge[None, :] - (x @ self.w)[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], 1), axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(1)


def rated_documents(labels: DataFrame, doc: str = "doc_id", rater: str = "rater", level: str = "level", most: int = MAX_RATED) -> DataFrame:
    """(doc_id, level) of at most `most` rated documents: the median rating, the lower of two."""
    rows = labels.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(rater).alias("rater"), F.col(level).cast("int").alias("level")).where(f"doc_id is not null and level between 1 and {LEVELS}").distinct()
    sorted_levels = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("level")).alias("all"))
    return sorted_levels.select("doc_id", F.element_at("all", F.ceil(F.size("all") / 2).cast("int")).alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def reading_levels(docs: DataFrame, key: str, text: str, labels: DataFrame, which: str = "true", min_words: int = 0) -> DataFrame:
    """(doc_id, level, confidence) of every document with text for which `which` holds and that is long enough."""
    spark = docs.sparkSession
    features = materialize(document_features(docs, key, text, which, min_words), "features")
    rated = features.join(F.broadcast(rated_documents(labels)), "doc_id").toPandas()
    if rated.empty:
        return spark.createDataFrame([], "doc_id bigint, level int, confidence double")
    mean, dev = language_moments(features)
    rated = rated.sort_values("doc_id")
    x = standardised(rated[list(FEATURES)].to_numpy(np.float64), rated["spoken"].to_numpy(np.int64), mean, dev)
    model = OrdinalRegression().fit(x, rated["level"].to_numpy(np.int64) - 1)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.stack([batch.column(i + 2).to_numpy() for i in range(len(FEATURES))], 1).astype(np.float64)
                p = model.probabilities(standardised(raw, batch.column(1).to_numpy().astype(np.int64), mean, dev))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((p.argmax(1) + 1).astype(np.int32)), pa.array(p.max(1))], names=["doc_id", "level", "confidence"])

    return features.mapInArrow(predict, "doc_id bigint, level int, confidence double")
