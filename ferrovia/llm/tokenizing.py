"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

A text is cut before every single space and line feed. The pre-tokenizer of the file never
joins characters across such a cut as long as no white space stands next to it, so the ids of
a text are those of its chunks in turn. Nor does it join letters and punctuation: a chunk of
Latin letters and punctuation after them has the ids of these two pieces, and a piece is encoded
once for each worker, as are chunks of any other kind. Texts with runs of white space are encoded whole. Special tokens spelt out in a text get their ids, as
the library does when it is called with ``add_special_tokens=False``; none has white space in it.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workspace import kept

END_ID = 2
#: Pieces a worker remembers, bytes of text it splits at a time, characters of a text it encodes
#: whole, and chunks it turns into ids at a time. They bound its memory.
MAX_PIECES, SLICE_BYTES, PART_CHARS, STEP = 400_000, 8 << 20, 1_000_000, 1 << 18

#: Marks put before the first chunk of a text, a chunk after a line feed, and the end of a text.
FIRST, LINE, END = "\1", "\0", "\2"
#: Letters below U+0180, whose class no Unicode version has changed, and punctuation of ASCII.
_PLAIN = "^(?P<head>[A-Za-zªµºÀ-ÖØ-öø-ſ]+)(?P<tail>[[:punct:]]*)$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level BPE writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """``encode(texts)`` gives the ids of texts end to end, and how many each has, end id included."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end_id, self.letters = end_id, _byte_letters()
        self.space, self.line = self.letters[32], self.letters[10]
        self.bpe = self.tok.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.pieces = {"": 0}  # numbers; the empty piece has no ids
        self.first, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _piece(self, piece: str) -> list[int]:
        """Ids of a piece of the pre-tokenizer."""
        if not piece.isascii():
            spelt = piece.encode().decode("latin-1").translate(self.letters)
        elif piece[0] == " ":
            spelt = self.space + piece[1:]
        else:
            spelt = piece if piece != "\n" else self.line
        return [t.id for t in self.bpe(spelt)]

    def _chunk(self, chunk: str) -> list[int] | None:
        """Ids of a chunk; None if its white space may run on into the next one."""
        if chunk == END:
            return [self.end_id]
        if chunk[:1] == FIRST:
            return self.tok.encode(chunk[1:], add_special_tokens=False).ids
        line = chunk[:1] == LINE
        body = chunk[1:] if line else chunk
        if not body or body[-1].isspace():
            return None
        return self.tok.encode(("\n" if line else " ") + body, add_special_tokens=False).ids

    def _numbers(self, names: pa.Array, encode, mark: str = "") -> np.ndarray:
        """The number of each piece of ``names``; those that are new get their ids from ``encode``. A length of -1 stands for None."""
        coded = pc.dictionary_encode(names)
        distinct = coded.dictionary.to_pylist()
        if mark:
            distinct = [mark + x for x in distinct]
        numbers = list(map(self.pieces.get, distinct))
        if None in numbers:
            fresh = [x for x, n in zip(distinct, numbers, strict=True) if n is None]
            self._learn(fresh, [encode(x[len(mark) :]) for x in fresh] if mark else list(map(encode, fresh)))
            numbers = list(map(self.pieces.get, distinct))
        return np.array(numbers, np.int64)[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)

    def _learn(self, fresh: list[str], ids: list[list[int] | None]) -> None:
        length = np.fromiter((-1 if x is None else len(x) for x in ids), np.int32, len(ids))
        size = np.maximum(length, 0)
        n, k = int(size.sum()), len(self.pieces)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(fresh) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        self.flat[self.used : self.used + n] = np.fromiter(chain.from_iterable(x for x in ids if x), np.uint32, n)
        self.first[k : k + len(fresh)] = self.used + np.cumsum(size) - size
        self.length[k : k + len(fresh)] = length
        self.used += n
        self.pieces.update(zip(fresh, range(k, k + len(fresh)), strict=True))

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks end to end, where those of each start, and how many it has (-1: see :meth:`_chunk`)."""
        line = pc.starts_with(chunks, LINE)
        parts = pc.extract_regex(pc.utf8_ltrim(chunks, LINE), _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        whole = np.zeros((len(chunks), 3), np.int64)  # a line feed, letters, punctuation
        if plain.any():
            keep = pa.array(plain)
            after = line.filter(keep)
            head, tail = parts.filter(keep).flatten()
            whole[plain, 0] = self._numbers(pc.if_else(after, "\n", ""), self._piece)
            whole[plain, 1] = self._numbers(pc.binary_join_element_wise(pc.if_else(after, "", " ").cast(head.type), head, pa.scalar("", head.type)), self._piece)
            whole[plain, 2] = self._numbers(tail, self._piece)
        if not plain.all():
            whole[~plain, 1] = self._numbers(chunks.filter(pa.array(~plain)), self._chunk, "\3")
        of_piece = self.length[whole].astype(np.int64)
        odd = of_piece[:, 1] < 0
        of_piece[odd] = 0
        length = of_piece.sum(axis=1)
        ids = self._gathered(self.first[whole].ravel(), of_piece.ravel(), self.flat)
        return ids, np.cumsum(length) - length, np.where(odd, -1, length)

    @staticmethod
    def _gathered(first: np.ndarray, length: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """``length`` items of ``flat`` from each ``first``, end to end."""
        out, done = np.empty(int(length.sum()), flat.dtype), 0
        for k in range(0, len(length), STEP):
            some = length[k : k + STEP]
            before = np.cumsum(some) - some
            ids = flat[np.repeat(first[k : k + STEP] - before, some) + np.arange(int(some.sum()))]
            out[done : done + len(ids)] = ids
            done += len(ids)
        return out

    @staticmethod
    def _parts(text: str):
        """Slices of a long text, cut before single spaces."""
        start = 0
        while len(text) - start > 2 * PART_CHARS:
            at = text.find(" ", start + PART_CHARS)
            while at >= 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def _whole(self, text: str) -> np.ndarray:
        ids = [np.array(self.tok.encode(x, add_special_tokens=False).ids, np.uint32) for x in self._parts(text)]
        return np.concatenate([*ids, np.array([self.end_id], np.uint32)])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.binary_join_element_wise(*(x if x is texts else pa.scalar(x, texts.type) for x in (FIRST, texts, " " + END, ""))), "\n", " " + LINE)
        split = pc.split_pattern(marked, " ")
        count = np.diff(split.offsets.to_numpy())
        coded = pc.dictionary_encode(split.flatten())
        flat, first, size = self._distinct(coded.dictionary)
        n = coded.indices.to_numpy()
        length = size[n]
        odd = np.zeros(len(texts), bool)
        if (bad := np.flatnonzero(length < 0)).size:
            odd[np.searchsorted(np.cumsum(count), bad, "right")] = True
            length[bad] = 0
        for mark in (FIRST, LINE, END, "\3"):
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        out = self._gathered(first[n], length, flat)
        to = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(count)])]
        if odd.any():
            each = [self._whole(texts[k].as_py()) if odd[k] else out[to[k] : to[k + 1]] for k in range(len(texts))]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return out, np.diff(to)

    def encode(self, texts: pa.Array, slice_bytes: int | None = None):
        """Yield (ids, lengths) of slices of ``texts`` in turn; null counts as empty."""
        slice_bytes = slice_bytes or SLICE_BYTES
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy()) if len(texts) else np.zeros(0)
        start = 0
        while start < len(texts):
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + slice_bytes, "right")))
            yield self._slice(texts.slice(start, stop - start))
            if len(self.pieces) > MAX_PIECES or self.used > 8 * MAX_PIECES:
                self._forget()
            start = stop


def encoder(path: str, end_id: int = END_ID) -> ChunkEncoder:
    """One for each Python worker and file."""
    return kept(("encoder", path, end_id), lambda: ChunkEncoder(path, end_id))
