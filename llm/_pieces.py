"""Exact encoding of many texts by pieces that a tokenizer cannot merge across.

Invented or rare words make a tokenizer slow, and most words come again. Texts
are cut where its pre-tokenizer always cuts, distinct pieces are encoded once
by the tokenizers library, and their ids are put together for every text. The
encodings are kept from one slice to the next, up to a bound.

Modes: ``words`` for tokenizers that drop white space (pieces are runs of other
bytes); ``spaced`` for byte-level ones whose words take one space before them
(a piece begins at a space whose next character is surely no white space, at
punctuation after a letter, and at a line end after a character).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from llm._batches import SPACE, Texts, byte_table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces and bytes of them that are kept between slices, at most; longer pieces are never kept.
KEEP_PIECES, KEEP_BYTES, LONG_PIECE = 1_500_000, 32 << 20, 256
#: Bytes that surely begin no white space: ASCII but controls and space, and
#: lead bytes of characters outside the blocks that hold white space.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False

_ASCII_SOLID = _SOLID & (np.arange(256) < 0x80)
_LETTER = byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = byte_table(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")

_LOADED: dict = {}


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceEncoder:
    def __init__(self, path: str, mode: str):
        self.tokenizer, self.mode = load(path), mode
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.pieces = pa.array([], type=pa.large_binary())
        self.first, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    @classmethod
    def shared(cls, path: str, mode: str) -> "PieceEncoder":
        """The one of this process."""
        if (path, mode) not in _LOADED:
            _LOADED[path, mode] = cls(path, mode)
        return _LOADED[path, mode]

    def tokens(self) -> pa.Array:
        """The token of each id, as bytes."""
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return pa.array([(self.tokenizer.id_to_token(i) or "").encode() for i in range(n)], type=pa.large_binary())

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(texts), 4096):  # an encoding holds far more than its ids
            out = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[a:a + 4096]], add_special_tokens=False)
            found = [x.ids for x in out]
            size.append(np.array([len(x) for x in found], dtype=np.int64))
            ids.append(np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(size[-1].sum())))
        return np.concatenate(ids), np.concatenate(size)

    def _cut(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.mode == "words":
            return t.words(SPACE)
        begin = np.zeros(len(t.data) + 1, dtype=bool)
        if len(t.data) > 1:
            before, after = t.data[:-1], t.data[1:]
            begin[:-2] = (before == 32) & _SOLID[after]
            # a letter never goes on into punctuation, nor anything solid into a line end
            begin[1:-1] |= (_LETTER[before] & _MARK[after]) | ((after == 10) & _ASCII_SOLID[before])
        for text in self._with_special(t):  # white space before a special token counts apart
            begin[t.offsets[text]:t.offsets[text + 1]] = False
        begin[t.offsets[1:] - 1] = False  # a last space is followed by nothing
        begin[t.offsets] = True
        starts = np.flatnonzero(begin[:-1])
        return starts, np.append(starts[1:], len(t.data)) if len(starts) else starts, np.searchsorted(starts, t.offsets)

    def _with_special(self, t: Texts) -> list[int]:
        body, found = t.data.tobytes(), set()
        for mark in self.special:
            at = body.find(mark)
            while at >= 0:
                found.add(int(np.searchsorted(t.offsets, at, side="right")) - 1)
                at = body.find(mark, at + 1)
        return sorted(found)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the index of each text's first."""
        starts, ends, first = self._cut(t)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(t) + 1, dtype=np.int64)
        size = ends - starts
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(size, out=offsets[1:])
        data = t.data if offsets[-1] == len(t.data) else t.data[~SPACE[t.data]]
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = flat.dictionary_encode()
        first_id, n_ids, ids = self._known(coded.dictionary)
        code = coded.indices.to_numpy()
        count = n_ids[code]
        end = np.cumsum(count)
        at = np.arange(int(end[-1])) + np.repeat(first_id[code] - (end - count), count)
        return ids[at], np.concatenate([[0], end])[first]

    def _known(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id and number of ids of each piece, within all ids."""
        place = pc.index_in(distinct, value_set=self.pieces)
        fresh = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        base = len(self.pieces)
        new_ids, size = self._whole(distinct.take(pa.array(fresh)).to_pylist())
        at[fresh] = base + np.arange(len(fresh))
        first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        ids = np.concatenate([self.ids, new_ids])
        keep = pc.less_equal(pc.binary_length(distinct), LONG_PIECE).to_numpy(zero_copy_only=False)[fresh]
        if keep.all():
            self.pieces = pa.concat_arrays([self.pieces, distinct.take(pa.array(fresh)).cast(pa.large_binary())])
            self.first, self.ids = first, ids
        if len(self.pieces) > KEEP_PIECES or self.pieces.nbytes > KEEP_BYTES:
            self._clear()  # and start again from the pieces of this slice
            if keep.all() and distinct.nbytes < KEEP_BYTES // 2:
                size = np.diff(first)[at]
                end = np.cumsum(size)
                self.pieces = pa.concat_arrays([distinct.cast(pa.large_binary())])
                self.first = np.concatenate([[0], end])
                self.ids = ids[np.arange(int(end[-1])) + np.repeat(first[at] - (end - size), size)]
        return first[at], np.diff(first)[at], ids
