"""Removal of repeated passages: words covered by a window of ``window`` words that starts anywhere else too.

1. Segments. Of the runs of ``anchor`` words in a window the one with the least hash is its anchor. Windows in a row with one anchor
   at one place form a segment. Equal windows have equal anchors at equal places, so they lie in segments with one anchor, and all
   work goes by anchors: nothing is compared with all shards. A window is repeated exactly if two segments, of any documents, hold it.
2. Anchors that occur once are dropped; equal segments become one with a weight. A segment with a weight of two or more is
   repeated from end to end, and needs no search, but stands in the index for others.
3. Shards. The distinct segments of each anchor come together in a shard, an FM-index of a few megabytes of text. Every segment of
   weight one is streamed through it: backward search gives its matching statistics, and ranges of ``window`` words or more whose
   suffix interval has a weight of two are reported. Anchors with more than ``hot`` distinct segments are split: their
   windows are counted by their words instead: partial sums of weights, so that equal windows are one row a task. A window has a fixed
   number of words, so its count is all there is to find.
4. Ranges go back from segments to all documents that hold them.

Memory is bounded by a shard, and a shard by ``hot`` segments; a hot passage arrives as one weighted row per task. Nothing is sampled or left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from finality.llm.arrow_text import MIX_A, grams, hashes, mixed, ranges, slices, starts_within, text_bytes, whole_groups, words
from finality.llm.fm_index import DEPTH, FmIndex
from finality.llm.shared import row_key, stored

SEGMENTS = "anchor long, segment long, row_a long, row_b long, start int, n_words int, anchor_at int"
SHARD_BYTES = 3_000_000


def least_in_runs(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments_of(word_hashes: np.ndarray, first_word: np.ndarray, window: int, anchor: int):
    """Row, first word (in its row), number of words, and place and hash of the anchor of every segment, and a hash of its words."""
    starts, rows = starts_within(first_word, window)
    if not len(starts):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    runs = grams(word_hashes, anchor)
    place_bits = np.uint64(max(1, int(len(runs)).bit_length()))
    # the place in the lower bits: the first of equal ones is the least, and tells where it lies
    ranked = (runs >> place_bits << place_bits) | np.arange(len(runs), dtype=np.uint64)
    at = (least_in_runs(ranked, window - anchor + 1)[starts] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    begin, n = starts[first], starts[last] - starts[first] + window
    powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(word_hashes), MIX_A, dtype=np.uint64)]))
    inverse = np.uint64(pow(int(MIX_A), -1, 1 << 64))
    inverses = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(word_hashes), inverse, dtype=np.uint64)]))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word_hashes * powers[:-1], dtype=np.uint64)])
    content = mixed((sums[begin + n] - sums[begin]) * inverses[begin] + (n * 256 + at[first] - begin).astype(np.uint64))
    return rows[first], begin - first_word[rows[first]], n, at[first] - begin, runs[at[first]], content


def segment_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                data, offsets = text_bytes(some.column("text"))
                begin, end, first_word = words(data, offsets)
                rows, start, n, place, runs, content = segments_of(hashes(data, begin, end), first_word, window, anchor)
                keys = [some.column(c).to_numpy()[rows] for c in ("row_a", "row_b")]
                small = [pa.array(x.astype(np.int32)) for x in (start, n, place)]
                yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(content.view(np.int64)), *map(pa.array, keys), *small], ["anchor", "segment", "row_a", "row_b", "start", "n_words", "anchor_at"])

    return docs.select(*row_key("doc_id", "text"), "text").mapInArrow(cut, SEGMENTS)


def segment_texts(rows: DataFrame, window: int) -> DataFrame:
    """The words of the chosen segments of each text (``picked``); hot segments as single windows, dealt by their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                data, offsets = text_bytes(some.column("text"))
                begin, end, first_word = words(data, offsets)
                of = np.repeat(np.arange(some.num_rows), np.diff(some.column("picked").offsets.to_numpy()))
                picked = some.column("picked").flatten()
                get = lambda name: picked.field(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                start, n, place, hot = first_word[of] + get("start"), get("n_words").astype(np.int64), get("anchor_at"), get("hot")
                # one row per segment that isn't hot, one per window of those that are
                count = np.where(hot, n - window + 1, 1)
                source = np.repeat(np.arange(len(count)), count)
                shift = ranges(np.zeros(len(count), dtype=np.int64), count)
                size = np.where(hot, window, n)[source]
                first = start[source] + shift
                spelled = hashes(data, begin, end)
                shard = get("anchor")[source].copy()
                single = hot[source]
                if single.any():
                    shard[single] = grams(spelled, window)[first[single]].view(np.int64)
                low, high = begin[first], end[first + size - 1]
                text = data[ranges(low, high - low)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard), pa.array(get("anchor")[source]), pa.array(get("segment")[source]), pa.array(get("weight")[source]),
                        pa.array(shift.astype(np.int32)), pa.array(np.where(single, window, place[source]).astype(np.int32)),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(high - low)]).astype(np.int64)), pa.py_buffer(text.tobytes())]).cast(pa.binary()),
                    ],
                    ["shard", "anchor", "segment", "weight", "shift", "anchor_end", "words"],
                )

    return rows.mapInArrow(cut, "shard long, anchor long, segment long, weight long, shift int, anchor_end int, words binary")


def search_shards(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Repeated ranges (anchor, segment, from_word, to_word) of all segments, found in an FM-index per shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard", SHARD_BYTES):
            data, offsets = text_bytes(table.column("words"))
            begin, end, first_word = words(data, offsets)
            lengths, weight = np.diff(first_word), table.column("weight").to_numpy()
            index = FmIndex(hashes(data, begin, end), lengths, weight)
            once = np.flatnonzero(weight == 1)
            place = table.column("anchor_end").to_numpy()[once].astype(np.int64)
            which, low, high = index.repeated(once, np.minimum(np.where(place == window, window, place + anchor), lengths[once]), window)
            every = np.flatnonzero(weight > 1)
            which, low, high = np.concatenate([which, every]), np.concatenate([low, np.zeros(len(every), dtype=np.int64)]), np.concatenate([high, lengths[every]])
            shift = table.column("shift").to_numpy()[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(table.column(c).to_numpy()[which]) for c in ("anchor", "segment")] + [pa.array((x + shift).astype(np.int32)) for x in (low, high)],
                ["anchor", "segment", "from_word", "to_word"],
            )

    sorted_ = texts.repartition("shard").sortWithinPartitions("shard")
    return sorted_.mapInArrow(search, "anchor long, segment long, from_word int, to_word int")


def hot_windows(texts: DataFrame) -> DataFrame:
    """One row per distinct window of the hot segments, with the sum of the weights."""
    return texts.groupBy("shard", "words").agg(F.sum("weight").alias("total"))


def count_hot(texts: DataFrame, window: int, salts: int = 16) -> DataFrame:
    """Repeated windows of hot segments (anchor, segment, from_word, to_word); ``words`` is a digest of the words.

    The windows of one passage are dealt over ``salts`` keys when they learn that they are repeated.
    """
    again = hot_windows(texts).filter("total > 1").select("shard", "words", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(salts)).cast("int"))
    return dealt.join(again, ["shard", "words", "salt"], "left_semi").select("anchor", "segment", F.col("shift").alias("from_word"), (F.col("shift") + window).alias("to_word"))


def repeated_ranges(docs: DataFrame, window: int = 35, anchor: int = 6, hot: int = 20_000) -> DataFrame:
    """(row_a, row_b, ranges) of all rows of ``docs`` with repeated windows; ranges of words, [from, to), that may overlap."""
    if not anchor <= window <= DEPTH // 2:
        raise ValueError(f"a window has {anchor} to {DEPTH // 2} words")
    every = segment_rows(docs, window, anchor)
    again = stored(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    kept = stored(every.join(again, "anchor"), "segments")
    # only counts and plain numbers are aggregated; the columns of ``first`` come from one row
    first = [F.first(c).alias(c) for c in ("row_a", "row_b", "start", "n_words", "anchor_at")]
    distinct = stored(kept.groupBy("anchor", "segment").agg(F.count("*").alias("weight"), *first), "distinct-segments")
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    chosen = distinct.join(per_anchor, "anchor").groupBy("row_a", "row_b").agg(F.collect_list(F.struct("anchor", "segment", "weight", "start", "n_words", "anchor_at", "hot")).alias("picked"))
    texts = docs.select(*row_key("doc_id", "text"), "text").join(chosen, ["row_a", "row_b"])
    # a repeated row brings its segments twice, but these have a weight of two already
    texts = segment_texts(texts.select("text", "picked"), window)
    # single windows stand for hot segments; white space doesn't tell them apart
    single = F.col("anchor_end") == window
    digest = F.unhex(F.md5(F.regexp_replace(F.col("words").cast("string"), "[\\x20\\x09-\\x0D]+", " ").cast("binary")))
    texts = stored(texts.withColumn("words", F.when(single, digest).otherwise(F.col("words"))), "segment-texts")
    found = search_shards(texts.filter(~single), window, anchor).unionByName(count_hot(texts.filter(single), window))
    whole = distinct.filter("weight > 1").join(per_anchor, "anchor", "left_anti").select("anchor", "segment", F.lit(0).alias("from_word"), F.col("n_words").alias("to_word"))
    spans = stored(found.unionByName(whole), "repeated-segments")
    back = kept.join(spans, ["anchor", "segment"]).select("row_a", "row_b", F.struct((F.col("start") + F.col("from_word")).alias("a"), (F.col("start") + F.col("to_word")).alias("b")).alias("range"))
    return back.groupBy("row_a", "row_b").agg(F.collect_set("range").alias("ranges"))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def without_repeats(docs: DataFrame, window: int = 35, with_text: bool = True, **settings) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space.

    A null text has no words; the digest is then that of the empty string. Repeated rows count as further documents: all
    their windows are repeated. Other columns don't matter.
    """

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                data, offsets = text_bytes(some.column("text"))
                begin, end, first_word = words(data, offsets)
                change = np.zeros(len(begin) + 1, dtype=np.int64)
                lists = some.column("ranges")
                counts = np.diff(lists.offsets.to_numpy()) if lists.null_count < len(lists) else np.zeros(len(lists), dtype=np.int64)
                if counts.any():
                    of, flat = np.repeat(first_word[:-1], counts), lists.flatten()
                    np.add.at(change, of + flat.field("a").to_numpy(), 1)
                    np.add.at(change, of + flat.field("b").to_numpy(), -1)
                kept = np.cumsum(change[:-1]) == 0
                # each kept word with the byte after it, which becomes the space
                low, high = begin[kept], end[kept]
                sizes = high - low + 1
                padded = np.append(data, np.uint8(32))
                out = padded[ranges(low, sizes)]
                stops = np.cumsum(sizes)
                out[stops - 1] = 32
                before = np.concatenate([[0], np.cumsum(kept)])[first_word]
                at = np.concatenate([[0], stops])[before]
                joined = [out[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n, left = np.diff(first_word), np.diff(before)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in joined]),
                        pa.array([x.decode() for x in joined]) if with_text else pa.nulls(len(joined), pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    found = repeated_ranges(docs, window, **settings)
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    return keyed.join(found, ["row_a", "row_b"], "left").select("doc_id", "text", "ranges").mapInArrow(join_up, RESULT)
