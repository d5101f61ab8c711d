"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a worker."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that no normaliser composes or reorders, then ASCII signs that every pre-tokenizer splits off (no apostrophe).
_PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"
#: The signs by which byte-level vocabularies write bytes from 128 on: the byte's own, or, for those that do not print, the next free from 256 on.
_BYTE_SIGNS = {b: 256 + 34 + i for i, b in enumerate([*range(128, 161), 173])}
#: A space beside other white space, where a text can't be cut: between two signs of it, after one at the end, or twice. All signs that any library takes for white space are here.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_UNCUT = rf"{_SPACE} (?:{_SPACE}|\z)|  "
#: Pieces kept by one worker; a full cache is emptied, so memory is bounded.
CACHE_PIECES = 300_000
#: Words handed to the library as one text.
_TOGETHER = 32
_held: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """This worker's encoder of a tokenizer file; it lives as long as the worker."""
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


class WordEncoder:
    """Ids of texts as unsigned 32-bit integers.

    Both public vocabularies split a text before their merges, and always before a space that
    stands between two other characters. So the ids of a text are those of its pieces, and a
    piece is encoded once, a plain word by a second tokenizer of the same merges. A text with such
    white space that this does not hold, or with a token that the library finds before it splits, is
    encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.added = [a.content for a in t.get_added_tokens_decoder().values()]
        # the same merges without the splitting that plain words do not need
        self.merges = Tokenizer(t.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.folds = t.encode("A", add_special_tokens=False).ids == t.encode("a", add_special_tokens=False).ids
        names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        self.opens = np.array([n.startswith("Ġ") for n in names])
        self.closes = np.array([n.endswith("</w>") for n in names])
        self.ends_words = bool(self.closes.any())
        self.before = "" if self.ends_words else "Ġ"
        self._empty()

    def _empty(self) -> None:
        self.unit: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _signs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after another, and how many each has."""
        ids = self.library(texts)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _signs, for plain words (each with its space before it): many go to the library as one text."""
        own = [(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_SIGNS)).replace(" ", self.before) for w in words]
        groups = [" ".join(own[i : i + _TOGETHER]) for i in range(0, len(own), _TOGETHER)]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.merges.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1 if self.ends_words else np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._signs(words)

    def _keep(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        first = len(self.unit)
        more = first + len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while more > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first:more] = lens
        self.start[first:more] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.unit.update(zip(keys, range(first, more)))

    def _units(self, keys: pa.Array, encode, clean=lambda keys: keys) -> np.ndarray:
        """The unit of each key; those not met before are encoded."""
        coded = keys.dictionary_encode()
        names = coded.dictionary.to_pylist()
        units = np.array([-1 if u is None else u for u in map(self.unit.get, names)], np.int64)
        new = np.flatnonzero(units < 0)
        if len(new):
            missing = [names[i] for i in new.tolist()]
            units[new] = np.arange(len(self.unit), len(self.unit) + len(new))
            self._keep(missing, *encode(clean(missing)))
        return units[coded.indices.to_numpy(zero_copy_only=False)]

    def _gather(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of units, and where each unit's end."""
        size = self.size[units]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[units] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with a space before it, and where each word's end."""
        if len(self.unit) > CACHE_PIECES:
            self._empty()
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        units = np.zeros((len(words), 2), np.int64)
        if plain.any():
            known = parts.filter(pa.array(plain))
            a, b = known.field("a"), known.field("b")
            units[plain, 0] = self._units(pc.binary_join_element_wise(" ", pc.utf8_lower(a) if self.folds else a, ""), self._words)
            units[plain, 1] = self._units(b, self._signs)
        if not plain.all():
            # the line end keeps such keys apart from plain words
            rest = pc.binary_join_element_wise("\n", words.filter(pa.array(~plain)), "")
            units[~plain, 0] = self._units(rest, self._signs, lambda keys: [" " + k[1:] for k in keys])
        ids, ends = self._gather(units.ravel())
        return ids, ends[1::2]

    def _odd(self, column: pa.Array) -> pa.Array:
        """Whether the library has to see a text as a whole."""
        out = pc.match_substring_regex(column, _UNCUT)
        for a in self.added:
            out = pc.or_(out, pc.match_substring(column, a, ignore_case=True))
        return out

    def _spaced(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode; a text that is encoded as it is counts as empty."""
        column = pc.fill_null(column, "")
        odd = self._odd(column)
        if pc.any(odd).as_py():
            column = pc.if_else(odd, "", column)
        lists = pc.split_pattern(column, " ")
        offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        starts = offsets[:-1] - offsets[0]
        coded, firsts = words.dictionary_encode(), words.take(pa.array(starts)).dictionary_encode()
        ids, ends = self._distinct(coded.dictionary)
        begun = self.library(firsts.dictionary.to_pylist())  # no space stands before a text's first word
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at[starts] = len(ends) + firsts.indices.to_numpy(zero_copy_only=False)
        source = np.concatenate([ids, *begun])
        size = np.concatenate([np.diff(ends, prepend=0), [len(x) for x in begun]]).astype(np.int64)
        start = np.cumsum(size) - size
        lens = size[at]
        ends = np.cumsum(lens)
        out = source[np.repeat(start[at] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[np.append(starts, len(at))]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and the last ends); null is empty."""
        odd = np.flatnonzero(self._odd(pc.fill_null(column, "")).to_numpy(zero_copy_only=False))
        ids, bounds = self._spaced(column)
        if not len(odd):
            return ids, bounds
        pieces = np.split(ids, bounds[1:-1])
        for i, x in zip(odd, self.library(column.take(pa.array(odd)).to_pylist())):
            pieces[i] = x
        return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])
