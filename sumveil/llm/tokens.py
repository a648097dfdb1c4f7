"""Token ids of whole texts at Arrow speed: every distinct word is encoded once.

Both vocabularies split a text into pieces before they merge, and no piece crosses a
blank that stands between two other characters.  So texts are cut there, the words of
a batch are dictionary-encoded, the tokenizer sees only words it has not met before,
and ids are put together by numpy.  A full stop or comma is split off a word only after
an ASCII letter: other characters may be normalised to marks that share its piece.
Results equal those of encoding the whole text, special tokens included: their strings
give their ids unless ``plain`` makes them ordinary text.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; later ones are encoded again for each batch.
REMEMBERED = 700_000
#: Of these, words with a full stop or comma; the others are put together anew.
REMEMBERED_MARKED = 100_000
#: Texts are taken in slices of about so many bytes, to bound memory.
SLICE_BYTES = 4 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


class WordEncoder:
    """``spaced``: byte-level vocabulary whose pieces start with the blank before them.
    Otherwise blanks are dropped and words are lower-cased by the vocabulary."""

    def __init__(self, path: str, spaced: bool, remembered: int | None = None, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.spaced = spaced
        self.remembered = REMEMBERED if remembered is None else remembered
        self.codes: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.n = self.used = self.kept = self.kept_used = 0
        self.end, self.end_code, self.marked = None, -1, 0
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin (spaced) or end (else) a piece
        for piece, i in vocab.items():
            self.edge[i] = piece.startswith("\u0120") if spaced else piece.endswith("</w>")
        #: Letters beyond ASCII that make one piece of their own, and so cannot part a word.
        letters = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha()]
        self.single = {c for c, ids in zip(letters, self._raw(letters), strict=True) if self.edge[ids].sum() == 1 == len(c.lower())} | {chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()}
        self.stops = {c: self._raw([c])[0][0] for c in ".,"}

    def _raw(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Store entries at the end; the code of the first."""
        first, k = self.n, len(lengths)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        if first + k > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * (first + k)), np.resize(self.lengths, 2 * (first + k))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[first : first + k] = lengths
        self.starts[first : first + k] = self.used + np.cumsum(lengths) - lengths
        self.n, self.used = first + k, self.used + len(ids)
        return first

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries one after the other, and where each ends."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 1 << 31 and self.used < 1 << 31 else np.int64
        shift = (self.starts[codes] - (ends - lengths)).astype(kind)
        return self.flat[np.repeat(shift, lengths) + np.arange(total, dtype=kind)], ends

    def _joinable(self, piece: str) -> bool:
        """Whether the piece's ids can be told from those of its neighbours by ``edge``."""
        if self.spaced:
            return piece[:1] == " " and " " not in piece[1:] and piece[1:].strip() == piece[1:] != "" and not self._special(piece)
        return piece.isalpha() and (piece.isascii() or self.single.issuperset(piece))

    def _special(self, piece: str) -> bool:
        return "<" in piece and any(s in piece for s in self.special)

    def _new(self, pieces: list[str]) -> int:
        """Encode pieces, many in one text where that is safe, and store them."""
        joined, alone = [], []
        for p in pieces:
            (joined if self._joinable(p) else alone).append(p)
        pieces[:] = joined + alone
        glue = "" if self.spaced else " "
        groups = [joined[k : k + 2000] for k in range(0, len(joined), 2000)]
        all_ids, all_lengths = [], []
        for group in groups:  # one at a time: the library's results take far more memory than their ids
            ids = np.array(self._raw([glue.join(group)])[0], np.uint32)
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(group):
                own = self._raw(group)
                ids, lengths = np.concatenate([np.array(x, np.uint32) for x in own]), np.array([len(x) for x in own])
            else:
                lengths = np.diff(np.append(at, len(ids))) if self.spaced else np.diff(np.concatenate([[-1], at]))
            all_ids.append(ids)
            all_lengths.append(lengths)
        for k in range(0, len(alone), 2000):
            for ids in self._raw(alone[k : k + 2000]):
                all_ids.append(np.array(ids, np.uint32))
                all_lengths.append(np.array([len(ids)]))
        return self._add(np.concatenate(all_ids), np.concatenate(all_lengths))

    def _lookup(self, keys: list[str], own: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of pieces, and the id of a full stop or comma that follows the piece of that code, or -1.
        New words are remembered while there is room, else held in ``own`` for the slice."""
        codes, stops = self.codes, self.stops
        out, follows = np.fromiter(map(codes.get, keys, repeat(-1)), np.int64, len(keys)), np.full(len(keys), -1, np.int64)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, follows
        cores, marks = [], []
        for i in missing.tolist():
            k = keys[i]
            mark = stops.get(k[-1:], -1)
            if mark >= 0:
                if k[-2:-1].isalpha() and k[-2:-1].isascii():
                    k = k[:-1]
                else:
                    mark = -1
            if not self.spaced and k.isascii() and "<" not in k:
                k = k.lower()
            cores.append(k)
            marks.append(mark)
        if todo := [k for k in dict.fromkeys(cores) if k not in codes and k not in own]:
            remember = len(codes) + len(todo) <= self.remembered and self.n == self.kept
            first = self._new(todo)
            (codes if remember else own).update(zip(todo, range(first, first + len(todo)), strict=True))
            if remember:
                self.kept, self.kept_used = self.n, self.used
        found = np.fromiter((codes[k] if k in codes else own[k] for k in cores), np.int64, len(cores))
        out[missing], follows[missing] = found, marks
        return out, follows

    def _ended(self, keys: list[str], codes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Codes in which the marks that follow are included; remembered as words are."""
        at = np.flatnonzero(follows >= 0)
        if len(at):
            remember = self.marked + len(at) <= REMEMBERED_MARKED and self.n == self.kept
            ids, ends = self._gather(codes[at])
            first = self._add(np.insert(ids, ends, follows[at]), self.lengths[codes[at]] + 1)
            codes[at] = first + np.arange(len(at))
            if remember:
                self.codes.update(zip((keys[i] for i in at.tolist()), range(first, first + len(at)), strict=True))
                self.marked += len(at)
                self.kept, self.kept_used = self.n, self.used
        return codes

    def _forget(self, own: dict[str, int]) -> None:
        own.clear()
        self.n, self.used = self.kept, self.kept_used

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end_id`` if there is one, and where
        each text's ids start (one more entry than texts)."""
        own: dict[str, int] = {}
        ends = [] if end_id is None else [end_id]
        if ends and self.end != end_id:
            self.end, self.end_code = end_id, self._add(np.array(ends), np.array([1]))
            self.kept, self.kept_used = self.n, self.used
        n = len(texts)
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n " if self.spaced else " "), " ")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        coded = pieces.flatten().dictionary_encode()
        index, unique = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if self.spaced:
            trimmed = pc.utf8_trim_whitespace(coded.dictionary)
            odd = pc.or_(pc.not_equal(trimmed, coded.dictionary), pc.equal(trimmed, "")).to_numpy(zero_copy_only=False)
            if "\n" in unique:
                odd[unique.index("\n")] = False
            odd_docs = np.add.reduceat(np.append(odd[index], False).astype(np.int64), bounds[:-1]) > 0 if n else np.zeros(0, bool)
            newline = unique.index("\n") if "\n" in unique else -1
            bare = np.zeros(len(index), bool)
            bare[bounds[:-1]] = True
            if newline >= 0:
                breaks = index == newline
                bare |= breaks
                bare[1:] |= breaks[:-1]
            code_spaced = np.full(len(unique), -1, np.int64)
            code_bare = code_spaced.copy()
            used, leads = np.zeros((2, len(unique)), bool)
            used[index[~bare]], leads[index[bare]] = True, True
            use, first = np.flatnonzero(used), np.flatnonzero(leads)
            k1, k2 = [" " + unique[u] for u in use.tolist()], [unique[u] for u in first.tolist()]
            found1, found2 = self._lookup(k1, own), self._lookup(k2, own)
            code_spaced[use], code_bare[first] = self._ended(k1, *found1), self._ended(k2, *found2)
            codes = np.where(bare, code_bare[index], code_spaced[index])
        else:
            odd_docs = np.zeros(n, bool)
            codes = self._ended(unique, *self._lookup(unique, own))[index]
        if ends:
            codes = np.insert(codes, bounds[1:], self.end_code)
            bounds = bounds + np.arange(n + 1)
        ids, upto = self._gather(codes)
        offsets = np.concatenate([[0], upto])[bounds]
        if odd_docs.any():
            ids, offsets = self._mend(texts, ids, offsets, np.flatnonzero(odd_docs), own, ends)
        self._forget(own)
        return ids, offsets

    def _mend(self, texts, ids, offsets, docs, own, ends):
        """Texts with blanks at their ends or in a row are cut by pattern instead."""
        new = {}
        for d in docs:
            first, *rest = _CUT.split(texts[int(d)].as_py())
            keys = [first, *(" " + p for p in rest)]
            new[d] = np.append(self._gather(self._ended(keys, *self._lookup(keys, own)))[0], ends)
        parts = [new[d] if d in new else ids[offsets[d] : offsets[d + 1]] for d in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, spaced: bool, remembered: int | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary; it lives as long as the worker, and only the last one does."""
    key = path, spaced, remembered
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def encoded(batches, column: str, path: str, spaced: bool, end_id: int, remembered: int | None = None):
    """(rows of a batch without the text, ids of all its texts each with the end id, offsets)."""
    enc = encoder(path, spaced, remembered)
    for batch in batches:
        text = pc.fill_null(batch.column(column), "")
        rest = batch.drop_columns([column])
        sizes = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(text):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            yield rest.slice(at, to - at), *enc.encode(text.slice(at, to - at), end_id)
            pa.default_memory_pool().release_unused()
            at = to
