"""Token ids of a whole text column, with each distinct piece of text encoded once.

Texts are cut where every pre-tokenizer in use cuts anyway, so that the ids of a text are those of its
pieces end to end. Cuts are made only between characters whose kind is certain from their bytes:

* before white space that follows something else (a space belongs to what follows it, never to what stands before it),
* after a single white space other than the plain space, between two other things,
* before ASCII punctuation, the apostrophe apart, that follows a letter.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from finality.llm.arrow_text import IS_SPACE, TO_LOWER, ranges, text_bytes

_PLAIN = np.zeros(256, dtype=bool)  # ASCII that is surely no white space
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = _PLAIN & ~_LETTER
_PUNCTUATION[48:58] = _PUNCTUATION[ord("'")] = False


#: A piece that every pre-tokenizer in use keeps whole: letters up to U+00FF, with or without a space before them.
_WORD = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)")


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it can be seen, else from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(unseen)}


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which pieces begin; the start of every row that isn't empty is one."""
    space, plain = IS_SPACE[data], _PLAIN[data]
    letter = _LETTER[data]
    latin = np.zeros(len(data), dtype=bool)  # last byte of a letter from U+00C0 to U+00FF
    if len(data):
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (plain[:-1] | latin[:-1]) & space[1:]
    cut[1:] |= (letter[:-1] | latin[:-1]) & _PUNCTUATION[data[1:]]
    cut[2:] |= (plain[:-2] | latin[:-2]) & space[1:-1] & (data[1:-1] != 0x20) & (plain[2:] | (data[2:] == 0xC3))
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes columns with one tokenizer file, as the tokenizers library does without adding special tokens.

    A text that holds the string of an added token is given to the library whole, which gives that token's id; with ``plain_specials``
    such strings are ordinary text. ``keep`` bounds the remembered pieces of a worker; beyond it they are forgotten and encoded anew.
    """

    def __init__(self, path: str, keep: int = 500_000, plain_specials: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        #: byte-level models can be given single words directly; white space before a word is part of it or dropped
        self.by_bytes = "ByteLevel" in str(self.tokenizer.pre_tokenizer)
        self.drops_space = "Removed" in str(self.tokenizer.pre_tokenizer)
        self.characters = byte_characters()
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint16 if self.tokenizer.get_vocab_size() < 65_536 else np.uint32)
        self.starts, self.used = np.zeros((1 << 14) + 1, dtype=np.int64), 0

    def _learn(self, pieces: list[bytes]) -> None:
        lists, others = [], []
        for k, piece in enumerate(map(bytes.decode, pieces)):
            lists.append(self._word(piece))
            if lists[-1] is None:
                others.append((k, piece))
        encodings = self.tokenizer.encode_batch_fast([p for _, p in others], add_special_tokens=False)
        for (k, _), encoding in zip(others, encodings, strict=True):
            lists[k] = encoding.ids
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ids = np.fromiter((i for x in lists for i in x), dtype=self.flat.dtype, count=int(lengths.sum()))
        known, end = len(self.codes), self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(end, dtype=self.flat.dtype)])
        if known + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(known + len(pieces) + 1, dtype=np.int64)])
        self.flat[self.used : end] = ids
        self.starts[known + 1 : known + 1 + len(pieces)] = self.used + np.cumsum(lengths)
        self.used = end
        self.codes.update(zip(pieces, range(known, known + len(pieces)), strict=True))

    def _word(self, piece: str) -> list[int] | None:
        """Ids of a piece that is one word, from the tokenizer's model alone; None for other pieces."""
        if not self.by_bytes or (word := _WORD.fullmatch(piece)) is None:
            return None
        if self.drops_space:
            piece = word[2]
        if self.lower:
            piece = piece.lower()
        if not piece.isascii():
            piece = "".join(map(self.characters.__getitem__, piece.encode()))
        elif piece[0] == " ":
            piece = self.characters[32] + piece[1:]
        return [token.id for token in self.model.tokenize(piece)]

    def encode(self, column: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the n+1 row offsets. ``last`` is added to every row."""
        whole = np.zeros(len(column), dtype=bool)
        for content in self.added:
            # in any case: a normaliser may lower it first
            whole |= pc.fill_null(pc.match_substring(column, content, ignore_case=True), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_pieces(column, last)
        ids, at = self._by_pieces(pc.if_else(pa.array(whole), pa.scalar(None, column.type), column), last)
        rows = np.flatnonzero(whole)
        lists = [self.tokenizer.encode(column[int(r)].as_py(), add_special_tokens=False).ids for r in rows]
        lengths = np.zeros(len(column), dtype=np.int64)
        lengths[rows] = [len(x) for x in lists]
        values = np.array([i for x in lists for i in x], dtype=ids.dtype)
        return np.insert(ids, np.repeat(at[rows], lengths[rows]), values), at + np.concatenate([[0], np.cumsum(lengths)])

    def _by_pieces(self, column: pa.Array, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        if self.lower:
            data = TO_LOWER[data]
        cuts = piece_starts(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.codes) + len(distinct) > self.keep:
            self._forget()
        if new := [p for p in distinct if p not in self.codes]:
            self._learn(new)
        code = np.fromiter(map(self.codes.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        code = code[pieces.indices.to_numpy()] if len(cuts) else code
        starts, lengths = self.starts[code], self.starts[code + 1] - self.starts[code]
        ids = self.flat[ranges(starts, lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(cuts, offsets)]
        if last is None:
            return ids, before
        rows = len(offsets) - 1
        out, kept = np.empty(len(ids) + rows, dtype=ids.dtype), np.ones(len(ids) + rows, dtype=bool)
        kept[before[1:] + np.arange(rows)] = False
        out[kept], out[~kept] = ids, last
        return out, before + np.arange(rows + 1)


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, plain_specials: bool = False) -> PieceEncoder:
    """The encoder of this worker, kept over tasks."""
    key = path, plain_specials
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, plain_specials=plain_specials)
    return _ENCODERS[key]
