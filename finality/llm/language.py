"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are read as words: letters in lower case, anything else is a boundary. A model predicts each letter, and the boundary after a
word, from up to ``order - 1`` characters before it in the word. Runs of characters are told apart by ``bits``-bit hashes, so a
model has at most 2^bits entries per order and language, whatever the corpus; it is the only thing that is broadcast.

Training counts the runs of all labelled texts in their tasks and sums them up in one aggregate. With c(g) the count of a run g of
the highest order, or of one that begins a word, and otherwise the number of different characters seen before it,

    P(w | h) = max(c(hw) - D, 0) / c(h.) + D * n(h.) / c(h.) * P(w | shorter h),    D = n1 / (n1 + 2 n2)

where n(h.) is the number of different characters after h. The probabilities of all runs and the weights of all histories are kept in sorted
hash arrays, with one column per language. A text gets the language of the lowest cross-entropy per character; of equal ones the
first by name.

A part of the labelled texts is not used for the models but for calibration: there, the share of right answers is fitted as
a logistic function of how far the second language lies behind, and a cross-entropy is found that almost no labelled text passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from finality.llm.arrow_text import TO_LOWER, mixed, slices, text_bytes, words

#: Letters and further numerals (fractions, Roman and circled numbers); the latter are taken out by category.
_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Scores of all characters of the different words of a slice are held at once.
SLICE_BYTES = 2_000_000
KEPT_WORDS = 300_000
RUNS = "lang string, size int, slot int, history int, shorter int, opens boolean, count long"
#: Calibration: bins of the margin and of the cross-entropy, and the share of labelled texts that may be rejected.
MARGIN_STEP, ENTROPY_STEP, REJECTED = 0.05, 0.05, 0.0005


def spelled(word: bytes) -> str:
    """A word's letters in lower case, with single spaces for what stands between them."""
    runs = _LETTERS.findall(word.decode().lower())
    if not all(map(str.isalpha, runs)):
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return " ".join(runs)


def distinct_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of a text column, the number of each word, and the words before each row."""
    data, offsets = text_bytes(column)
    data = TO_LOWER[data]
    begin, end, first_word = words(data, offsets)
    if not len(begin):
        return [], np.zeros(0, dtype=np.int64), first_word
    # from the start of a word to that of the next; the rest is white space, which isn't a letter
    cuts = np.append(begin, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), first_word


@dataclass
class Characters:
    """Characters of many words end to end, each word with a boundary before and after it.

    ``at``: places to predict; ``word``: the word of each; ``known``: characters before it in its word.
    """

    codes: np.ndarray
    at: np.ndarray
    word: np.ndarray
    known: np.ndarray

    @staticmethod
    def of(words_: list[str]) -> Characters:
        codes = np.frombuffer((" " + "  ".join(words_) + " ").encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, words_), dtype=np.int64, count=len(words_))
        starts = np.cumsum(lengths + 2) - (lengths + 2)
        word = np.repeat(np.arange(len(words_)), lengths + 2)
        known = np.arange(len(codes)) - starts[word]
        keep = (known > 0) & (lengths[word] > 0)
        return Characters(codes, np.flatnonzero(keep), word[keep], known[keep])

    def slots(self, order: int, bits: int) -> list[np.ndarray]:
        """For each size from 0 to ``order``: the hash of the characters, so many, that end at each place of ``codes``.

        A run is hashed from the run before it and its last character.
        """
        h = np.zeros(len(self.codes), dtype=np.uint64)
        out = [np.zeros(len(h), dtype=np.int32)]
        for _ in range(order):
            before = np.zeros(len(h), dtype=np.uint64)
            before[1:] = h[:-1]
            h = mixed(before * np.uint64(0x9E3779B97F4A7C15) + self.codes + np.uint64(1))
            out.append((h >> np.uint64(64 - bits)).astype(np.int32))
        return out


def count_runs(texts: DataFrame, order: int, bits: int) -> DataFrame:
    """Counts of the runs of all ``texts`` (text, lang), summed up: (lang, size, slot, history, shorter, opens, count).

    ``history``: the run without its last character; ``shorter``: without its first one; ``opens``: it begins a word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, limit=SLICE_BYTES):
                different, number, first_word = distinct_words(some.column("text"))
                langs = some.column("lang").dictionary_encode()
                if not different:
                    continue
                characters = Characters.of([spelled(w) for w in different])
                slots = characters.slots(order, bits)
                lang_of_word = np.repeat(langs.indices.to_numpy(), np.diff(first_word))
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    times = np.bincount(number[lang_of_word == k], minlength=len(different))
                    used = times[characters.word] > 0
                    at, known, weight = characters.at[used], characters.known[used], times[characters.word[used]]
                    for size in range(1, order + 1):
                        # a run may begin with the boundary before the word
                        here = known >= size - 1
                        place = at[here]
                        columns = np.stack([slots[size][place], slots[size - 1][place - 1] if size > 1 else np.zeros(len(place), np.int32), slots[size - 1][place] if size > 1 else np.zeros(len(place), np.int32)]).astype(np.int64)
                        opens = known[here] == size - 1
                        key = (columns[0] << 2) | (opens.astype(np.int64) << 1)
                        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                        total = np.bincount(inverse, weights=weight[here]).astype(np.int64)
                        n = len(first)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), *[pa.array(c[first].astype(np.int32)) for c in columns], pa.array(opens[first]), pa.array(total)],
                            ["lang", "size", "slot", "history", "shorter", "opens", "count"],
                        )

    runs = texts.select("text", "lang").mapInArrow(count, RUNS)
    return runs.groupBy("lang", "size", "slot", "opens").agg(F.min("history").alias("history"), F.min("shorter").alias("shorter"), F.sum("count").alias("count"))


@dataclass
class LanguageModels:
    """For each size: sorted hashes of runs, log-probabilities of them, and log-weights of them as histories (rows: runs, columns: languages)."""

    langs: list[str]
    order: int
    bits: int
    hashes: list[np.ndarray]
    found: list[np.ndarray]
    backs: list[np.ndarray]
    floor: float
    # calibration: intercept and slope of the logistic function, and the highest cross-entropy that is accepted
    fit: tuple[float, float] = (0.0, 1.0)
    limit: float = float("inf")

    def __post_init__(self):
        self.places: dict[bytes, int] = {}
        self.kept, self.kept_sizes = np.zeros((0, len(self.langs))), np.zeros(0, dtype=np.int64)

    def word_scores(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word by language, and the number of predicted characters of each."""
        out = np.zeros((len(words_), len(self.langs)))
        if not words_:
            return out, np.zeros(0, dtype=np.int64)
        c = Characters.of(words_)
        slots_of = c.slots(self.order, self.bits)
        value = np.full((len(c.at), len(self.langs)), self.floor)
        history = np.zeros(len(c.at), dtype=np.int64)  # entry of the empty history
        for size in range(1, self.order + 1):
            here = c.known >= size - 1
            entry = self._entries(size, slots_of[size])
            if size > 1:
                history = np.where(here, previous[np.maximum(c.at - 1, 0)], -1)
            found = self.found[size][entry[c.at]]
            back = self.backs[size - 1][history]
            value = np.where(here[:, None], np.where(np.isnan(found), value + back, found), value)
            previous = entry
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(c.word, weights=value[:, k], minlength=len(words_))
        return out, np.bincount(c.word, minlength=len(words_))

    def remembered(self, different: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``word_scores`` of raw words. A worker keeps those of words it has met, ``KEPT_WORDS`` at most; beyond, all are forgotten and scored anew."""
        if len(self.places) + len(different) > KEPT_WORDS:
            self.places, self.kept, self.kept_sizes = {}, np.zeros((0, len(self.langs))), np.zeros(0, dtype=np.int64)
        new = [w for w in different if w not in self.places]
        if new:
            by_word, sizes = self.word_scores([spelled(w) for w in new])
            at = len(self.places)
            if at + len(new) > len(self.kept):
                more = at + 2 * len(new)
                self.kept = np.concatenate([self.kept[:at], np.zeros((more, len(self.langs)))])
                self.kept_sizes = np.concatenate([self.kept_sizes[:at], np.zeros(more, dtype=np.int64)])
            self.kept[at : at + len(new)], self.kept_sizes[at : at + len(new)] = by_word, sizes
            self.places.update(zip(new, range(at, at + len(new)), strict=True))
        places = np.fromiter(map(self.places.__getitem__, different), dtype=np.int64, count=len(different))
        return self.kept[places], self.kept_sizes[places]

    def _entries(self, size: int, slots: np.ndarray) -> np.ndarray:
        """Row of each hash in the sorted array; the last row stands for hashes that aren't there."""
        sorted_ = self.hashes[size]
        at = np.searchsorted(sorted_, slots)
        return np.where(sorted_[np.minimum(at, len(sorted_) - 1)] == slots, at, len(sorted_)) if len(sorted_) else np.zeros(len(slots), dtype=np.int64)

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text by language, and its number of characters (0: no letters)."""
        different, number, first_word = distinct_words(column)
        by_word, sizes = self.remembered(different)
        rows = len(first_word) - 1
        of = np.repeat(np.arange(rows), np.diff(first_word))
        n = np.bincount(of, weights=sizes[number], minlength=rows) if len(of) else np.zeros(rows)
        total = np.zeros((rows, len(self.langs)))
        for k in range(len(self.langs)):
            if len(of):
                total[:, k] = np.bincount(of, weights=by_word[number, k], minlength=rows)
        return -total / np.maximum(n, 1)[:, None], n.astype(np.int64)

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), margin, cross-entropy of the best, and number of characters."""
        entropy, n = self.scores(column)
        if not self.langs:
            return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n)), n
        entropy = np.round(entropy, 9)
        best = np.argmin(entropy, axis=1)
        least = entropy[np.arange(len(n)), best]
        others = entropy.copy()
        others[np.arange(len(n)), best] = np.inf
        second = others.min(axis=1) if len(self.langs) > 1 else least + np.log(2)
        margin = np.log1p((second - least) * np.sqrt(n))
        return np.where(n > 0, best, -1), margin, least, n

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.fit[0] + self.fit[1] * margin, -30, 30)))


def models_from(counts: pa.Table, order: int, bits: int) -> LanguageModels:
    """Kneser-Ney models from summed counts, at most ``order`` * 2^bits entries a language."""
    langs = sorted(set(counts.column("lang").to_pylist()))
    columns = {c: counts.column(c).to_numpy().astype(np.int64) for c in ("size", "slot", "history", "shorter", "count")}
    columns["opens"] = counts.column("opens").to_numpy(zero_copy_only=False)
    lang = pc.index_in(counts.column("lang").combine_chunks(), pa.array(langs)).to_numpy().astype(np.int64) if langs else np.zeros(0, dtype=np.int64)
    hashes: list[np.ndarray] = [np.zeros(0, dtype=np.int32)]
    for size in range(1, order + 1):
        own = columns["slot"][columns["size"] == size]
        as_history = columns["history"][columns["size"] == size + 1]
        hashes.append(np.unique(np.concatenate([own, as_history])).astype(np.int32))
    found = [np.full((len(h) + 1, len(langs)), np.nan) for h in hashes]
    backs = [np.zeros((len(h) + 1, len(langs))) for h in hashes]
    # letters of all languages and the boundary
    floor = -float(np.log(max(2, len(hashes[1])))) if order else 0.0
    for k in range(len(langs)):
        probability = [np.zeros(0)] + [np.zeros(len(h) + 1) for h in hashes[1:]]
        for size in range(1, order + 1):
            here = (columns["size"] == size) & (lang == k)
            at = np.searchsorted(hashes[size], columns["slot"][here])
            amount = np.zeros(len(hashes[size]) + 1)
            if size == order:
                np.add.at(amount, at, columns["count"][here])
            else:
                opens = columns["opens"][here]
                np.add.at(amount, at[opens], columns["count"][here][opens])
                longer = (columns["size"] == size + 1) & (lang == k)
                # distinct longer runs that end in this one
                pairs = np.unique(np.stack([columns["slot"][longer], columns["shorter"][longer]]), axis=1)[1]
                np.add.at(amount, np.searchsorted(hashes[size], pairs), 1)
            history = np.zeros(len(hashes[size]) + 1, dtype=np.int64)
            shorter = np.zeros(len(hashes[size]) + 1, dtype=np.int64)
            if size > 1:
                history[at] = np.searchsorted(hashes[size - 1], columns["history"][here])
                shorter[at] = np.searchsorted(hashes[size - 1], columns["shorter"][here])
            seen = np.zeros(len(hashes[size]) + 1, dtype=bool)
            seen[at] = True
            once, twice = int((amount[seen] == 1).sum()), int((amount[seen] == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            n_histories = len(hashes[size - 1]) + 1
            total = np.bincount(history[seen], weights=amount[seen], minlength=n_histories)
            kinds = np.bincount(history[seen], minlength=n_histories)
            weight = np.where(total > 0, np.minimum(discount * kinds, total) / np.maximum(total, 1), 1.0)
            lower = np.full(len(seen), np.exp(floor)) if size == 1 else np.where(probability[size - 1][shorter] > 0, probability[size - 1][shorter], np.exp(floor))
            probability[size] = np.where(seen, np.maximum(amount - discount, 0) / np.maximum(total[history], 1) + weight[history] * lower, 0)
            found[size][seen, k] = np.log(np.maximum(probability[size][seen], 1e-12))
            backs[size - 1][:, k] = np.log(np.maximum(weight, 1e-6))
            backs[size - 1][-1, k] = 0.0 if size > 1 else backs[size - 1][0, k]
    return LanguageModels(langs, order, bits, hashes, found, backs, floor)


def calibrated(models: LanguageModels, texts: DataFrame) -> LanguageModels:
    """Fits the score and the limit on ``texts`` (text, lang), of which only counts per bin are gathered."""
    if not models.langs:
        return models
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, limit=SLICE_BYTES):
                own = shared.value
                best, margin, entropy, n = own.judge(some.column("text"))
                right = np.array([b >= 0 and own.langs[b] == x for b, x in zip(best.tolist(), some.column("lang").to_pylist(), strict=True)], dtype=bool)
                some_n = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array((margin[some_n] / MARGIN_STEP).astype(np.int64)), pa.array((entropy[some_n] / ENTROPY_STEP).astype(np.int64)), pa.array(right[some_n].astype(np.int64))], ["margin", "entropy", "right"]
                )

    bins = texts.select("text", "lang").mapInArrow(tally, "margin long, entropy long, right long").groupBy("margin", "entropy").agg(F.sum("right").alias("right"), F.count("*").alias("n")).toPandas()
    if not len(bins):
        return models
    x, right, n = (bins["margin"].to_numpy() + 0.5) * MARGIN_STEP, bins["right"].to_numpy(float), bins["n"].to_numpy(float)
    # one wrong and one right answer more at the margin 0 keep the fit finite
    x, right, n = np.append(x, 0.0), np.append(right, 1.0), np.append(n, 2.0)
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([(right - n * p).sum(), ((right - n * p) * x).sum() - 1e-3 * b])
        hessian = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    models.fit = (a, max(b, 0.0))
    by_entropy = bins.groupby("entropy")["n"].sum().sort_index()
    share = by_entropy.cumsum() / by_entropy.sum()
    models.limit = float((share[share >= 1 - REJECTED].index[0] + 2) * ENTROPY_STEP)
    return models


def train(texts: DataFrame, calibration: Column, order: int = 4, bits: int = 18) -> LanguageModels:
    """Models from ``texts`` (text, lang); rows where ``calibration`` holds fit the score, all others the models. Null languages count nowhere."""
    known = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_calibrates", F.coalesce(calibration, F.lit(False)))
    counts = count_runs(known.filter(~F.col("_calibrates")), order, bits)
    return calibrated(models_from(counts.toArrow(), order, bits), known.filter("_calibrates"))


def identify(docs: DataFrame, models: LanguageModels, kept: tuple[str, ...] = ("doc_id",), reject_below: float = 0.5) -> DataFrame:
    """Per row of ``docs``: the columns ``kept``, lang_pred, score (0 to 1), cross_entropy and accepted.

    ``und`` with a score of 0, not accepted: texts that are null or have no letter, and all texts if no language was learned. A text is also
    not accepted if its score is below ``reject_below`` or its cross-entropy above the calibrated limit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, limit=SLICE_BYTES):
                own = shared.value
                best, margin, entropy, _ = own.judge(some.column("text"))
                names = [own.langs[k] if k >= 0 else UNKNOWN for k in best.tolist()]
                score = np.where(best >= 0, own.score(margin), 0.0)
                accepted = (best >= 0) & (score >= reject_below) & (entropy <= own.limit)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(accepted)], [*kept, "lang_pred", "score", "cross_entropy", "accepted"])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in kept)
    columns = list(dict.fromkeys([*kept, "text"]))
    return docs.select(*columns).mapInArrow(judge, f"{schema}, lang_pred string, score double, cross_entropy double, accepted boolean")


def accepted_only(docs: DataFrame, models: LanguageModels, reject_below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with all their columns; a null ``lang`` takes the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    place = docs.columns.index("lang") if "lang" in docs.columns else -1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, limit=SLICE_BYTES):
                own = shared.value
                best, margin, entropy, _ = own.judge(some.column("text"))
                good = (best >= 0) & (own.score(margin) >= reject_below) & (entropy <= own.limit)
                if place >= 0 and some.column(place).null_count:
                    names = pa.array([own.langs[k] if k >= 0 else None for k in best.tolist()], pa.string())
                    columns = list(some.columns)
                    columns[place] = pc.coalesce(some.column(place).cast(pa.string()), names)
                    some = pa.RecordBatch.from_arrays(columns, some.schema.names)
                yield some.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
