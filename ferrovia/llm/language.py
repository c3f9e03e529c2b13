"""Language identification by character models with interpolated Kneser-Ney smoothing.

A text is read as its words: runs between white space, lower-cased, letters alone, each framed by
start and end marks. For each language a model of order ``ORDER`` gives every character's
probability after the ones before it in its word; the language of a text is that of the lowest
cross-entropy, bits divided by characters, ties to the first label in code-point order. A model is a set of sorted
arrays of n-gram hashes with their log-probabilities and of context hashes with their back-off
weights, searched by bisection. Each word is scored once in a slice of texts.

Models are fitted on labelled rows outside the held-out quarter, about ``PER_LANGUAGE`` documents
of each language at most, drawn by a hash of ``doc_id`` (the only bounded sample here).
*Calibrated rejection*: the cross-entropies of the fitted rows set the limit, their
``CALIBRATION`` quantile and ``SLACK`` bits; a text beyond it, or without letters, is rejected.

A null text, or one without a letter, is ``und`` with score 0, as is all text if no labelled row
exists. A null ``doc_id`` counts as held out; rows may repeat. An empty table gives no
rows. Columns other than ``doc_id``, ``text`` and ``lang`` are passed through or ignored; names that begin with
``__lid_`` are this module's.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import kept, release, table

ORDER, PER_LANGUAGE, CALIBRATION, SLACK = 4, 2000, 0.999, 1.5
START, STOP = "\x02", "\x03"
#: Words a worker remembers, words that it scores and bytes of text that it splits at a time. They bound its memory.
MAX_WORDS, SCORED, SLICE_BYTES = 100_000, 1 << 14, 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    lower = word.lower()
    return lower if lower.isalpha() else "".join(c for c in lower if c.isalpha())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order the hash of the k characters that end at each position."""
    out = [np.zeros(len(codes), np.uint64)]
    for k in range(1, order + 1):
        back = np.concatenate([np.zeros(k - 1, np.uint64), codes[: len(codes) - k + 1]])
        out.append(_mix(out[-1] * _STEP + back + np.uint64(1)))
    return out


def _key_of(grams: list[str]) -> np.ndarray:
    k = len(grams[0])
    codes = np.array([[ord(c) for c in g] for g in grams], np.uint64)
    key = np.zeros(len(grams), np.uint64)
    for j in range(k):
        key = _mix(key * _STEP + codes[:, k - 1 - j] + np.uint64(1))
    return key


class CharacterModel:
    """Interpolated Kneser-Ney over character n-grams, from the counts of those of the highest order."""

    def __init__(self, counts: dict[str, int], order: int, alphabet: int):
        self.order = order
        by_order = {order: counts}
        for k in range(order - 1, 0, -1):  # below the top, a gram counts the characters seen before it
            by_order[k] = Counter(g[1:] for g in by_order[k + 1])
        self.grams, self.contexts, below = [], [], {"": 1 / alphabet}
        for k in range(1, order + 1):
            now = by_order[k]
            ones, twos = sum(n == 1 for n in now.values()), sum(n == 2 for n in now.values())
            discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5
            total, kinds = Counter(), Counter()
            for g, n in now.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            back = {h: discount * kinds[h] / total[h] for h in total}
            lower = (lambda g: below[g[1:]]) if k > 1 else (lambda g: below[""])
            below = {g: (n - discount) / total[g[:-1]] + back[g[:-1]] * lower(g) for g, n in now.items()}
            self.grams.append(self._sorted(below))
            self.contexts.append(self._sorted(back))
        self.floor = np.float32(-np.log2(alphabet))

    @staticmethod
    def _sorted(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        names = list(values)
        key = _key_of(names)
        order = np.argsort(key)
        return key[order], np.log2(np.fromiter(values.values(), float, len(names)))[order].astype(np.float32)

    @staticmethod
    def _find(table_of: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table_of[0], key), len(table_of[0]) - 1)
        return table_of[0][at] == key, table_of[1][at]

    def log2(self, keys: list[np.ndarray], at: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of the character at each position (of ``at``), after those before it."""
        at = np.arange(len(keys[0])) if at is None else at
        p = np.full(len(at), self.floor)
        for k in range(1, self.order + 1):
            known, value = self._find(self.grams[k - 1], keys[k][at])
            # the context of k characters is the k - 1 before them
            context = np.where(at > 0, keys[k - 1][at - 1], 0)
            seen, back = self._find(self.contexts[k - 1], context)
            p = np.where(known, value, np.where(seen, back + p, p))
        return p


class LanguageModel:
    """The character models of all languages, and the limit of their cross-entropy."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.order, self.limit, self.name = order, float("inf"), uuid.uuid4().hex
        self.languages = sorted(counts)
        alphabet = len({c for g in counts.values() for x in g for c in x}) + 1
        self.models = [CharacterModel(counts[x], order, alphabet) for x in self.languages]

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (words x languages) and characters of words, which hold letters alone."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        pad = START * (self.order - 1)
        codes = np.frombuffer("".join(pad + w + STOP for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        keys = _keys(codes, self.order)
        size = length + self.order
        first = np.cumsum(size) - size
        inside = np.ones(len(codes), bool)
        for k in range(self.order - 1):
            inside[first + k] = False  # marks of the start are given, not predicted
        # the last ORDER characters decide a probability, so each kind of them is looked up once
        _, at, kind = np.unique(keys[self.order], return_index=True, return_inverse=True)
        out = np.empty((len(words), len(self.models)), np.float32)
        for j, model in enumerate(self.models):
            out[:, j] = np.add.reduceat(np.where(inside, model.log2(keys, at)[kind], 0), first)
        return out, np.where(length > 0, length + 1, 0)


class _Scorer:
    """Scores texts of a worker; a word that was met before is looked up."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.score, self.size = np.zeros((1, len(self.model.languages)), np.float32), np.zeros(1, np.int64)

    def _numbers(self, words: list) -> np.ndarray:
        n = [self.index.get(w) for w in words]
        if None in n:
            new = [w for w, k in zip(words, n, strict=True) if k is None]
            plain = [letters(w) for w in new]
            parts = [self.model.score_words(plain[k : k + SCORED]) for k in range(0, len(plain), SCORED)]
            score, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            score[size == 0] = 0
            at = len(self.size)
            self.score, self.size = np.concatenate([self.score, score]), np.concatenate([self.size, size])
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            n = [self.index[w] for w in words]
        return np.array(n, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits (texts x languages) and characters of each text."""
        split = pc.utf8_split_whitespace(texts)
        count = np.diff(split.offsets.to_numpy())
        coded = pc.dictionary_encode(split.flatten())
        numbers = self._numbers(coded.dictionary.to_pylist())
        n = numbers[coded.indices.to_numpy()] if len(numbers) else np.zeros(0, np.int64)
        bits, chars = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        full = np.flatnonzero(count)
        if full.size:
            start = (np.cumsum(count) - count)[full]
            for j in range(bits.shape[1]):
                bits[full, j] = -np.add.reduceat(self.score[:, j][n].astype(float), start)
            chars[full] = np.add.reduceat(self.size[n], start)
        if len(self.index) > MAX_WORDS:
            self._forget()
        return bits, chars


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


_ADDED = {"__lid_lang": T.StringType(), "__lid_score": T.DoubleType(), "__lid_bits": T.DoubleType(), "__lid_rejected": T.BooleanType()}


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of ``docs`` (others of these names give way) with __lid_lang, __lid_score, __lid_bits and __lid_rejected."""
    docs = docs.drop(*_ADDED)
    schema = T.StructType(docs.schema.fields + [T.StructField(k, v) for k, v in _ADDED.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        scorer, names = kept(("scorer", model.name), lambda: _Scorer(model)), np.array([*model.languages, "und"], object)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            size, start = np.cumsum(pc.binary_length(texts).to_numpy()) if len(texts) else np.zeros(0), 0
            while start < len(texts):
                done = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, done + SLICE_BYTES, "right")))
                bits, chars = scorer(texts.slice(start, stop - start))
                none = chars == 0
                if bits.shape[1]:
                    per = bits / np.maximum(chars, 1)[:, None]
                    best = np.argmin(per, axis=1)
                    low = per[np.arange(len(per)), best]
                    sure = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                else:
                    none[:], best, low, sure = True, np.zeros(len(bits), int), np.zeros(len(bits)), np.zeros(len(bits))
                best = np.where(none, len(model.languages), best)
                added = [pa.array(names[best], pa.string()), pa.array(np.where(none, 0.0, sure)), pa.array(low, mask=none), pa.array(none | (low > model.limit))]
                rows = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, *_ADDED])
                start = stop
        release()

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, order: int = ORDER, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Models of the labels of ``docs`` outside the held-out quarter."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each label
    if not share:
        return LanguageModel({}, order)
    shares = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20)
    sample = known.where(drawn).select("text", "lang")

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(text.as_py().split())
        for lang, words in seen.items():
            grams: Counter = Counter()
            for word, n in words.items():
                if plain := letters(word):
                    framed = START * (order - 1) + plain + STOP
                    for k in range(len(plain) + 1):
                        grams[framed[k : k + order]] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in counted.toLocalIterator():  # bounded by the sample
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = LanguageModel(counts, order)
    limit = identify(sample, model).agg(F.percentile_approx("__lid_bits", CALIBRATION, 10_000)).first()[0]
    if limit is not None:
        model.limit = limit + SLACK
    return model


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits per character and rejected of each document."""
    model = fit(docs)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lid_lang").alias("lang_pred"), F.col("__lid_score").alias("score"), F.col("__lid_bits").alias("bits"), F.col("__lid_rejected").alias("rejected"))


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that calibrated rejection leaves; models are fitted on the labels among them."""
    return identify(docs, fit(docs)).where(~F.col("__lid_rejected")).select(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
