"""Whole texts to token ids with a public tokenizer, each distinct piece encoded once in a while.

A text is cut at white space that no token of these tokenizers crosses: the word-level one drops it, and the byte-level one puts
a space at the front of the word behind it and makes a run of line ends between words tokens of its own. So the ids of a text are
those of its pieces, one after another. Arrow cuts a batch of texts and numbers its distinct pieces, a bounded cache knows the ids
of most of them, the library encodes the others many at once, and NumPy lays the ids of all pieces in place. Texts with other
white space beside a cut are cut one by one, only before a space that stands in front of a word. The word-level tokenizer has nothing to
cut in words of letters, so the library gets these with the same model but without the pattern, which takes half of its time.

Strings of special tokens in a text become their ids, as in the library's own encoding; with plain=True they are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import repeat
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Pieces that a worker keeps, for each kind, before it forgets those that were asked for least.
PIECES = 600_000
_TOGETHER = 2048
_BEFORE_WORD = re.compile(r" (?=\S)")
_CLOSING = ".,;:!?%*$&#|)"
#: Letters that no normal form changes and that stay letters in lower case, in every version of Unicode.
_LETTERS = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}\x{400}-\x{481}\x{48a}-\x{52f}]+\z"
#: What the word-level tokenizer does to a text before its model sees it, as its file has it.
_WORD_FORMS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between pieces that the library encodes together; as a piece of its own it is one token.
_MARK = "\x01"


def _ints(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64)


def _strings(array: pa.Array) -> list[str]:
    """array.to_pylist(), in an eighth of its time."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _for_letters(tokenizer: Tokenizer) -> Tokenizer | None:
    """A tokenizer that shares the model and gives words of _LETTERS between spaces the same ids; None if the file's rules are not known."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    form, cut = (json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    steps = cut.get("pretokenizers", [])
    known = form.get("normalizers") == _WORD_FORMS and [x["type"] for x in steps] == ["Split", "ByteLevel"]
    known = known and steps[0]["pattern"] == {"Regex": _WORD_CUT} and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
    known = known and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if not known or any(all(c.isalpha() or c.isspace() for c in t) for t in added):
        return None
    made = Tokenizer(tokenizer.model)
    made.normalizer = normalizers.Lowercase()
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def _ascii_lower(texts: pa.Array) -> pa.Array:
    _, ends, body = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lower = b"" if body is None else body.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().lower()
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(lower))


class _Store:
    """Ids of pieces by number (slot), one after another in one table."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.asked = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.count = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The first slot of pieces with so many ids each."""
        first, n = self.count, len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.start):
            self.start, self.size, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.asked))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.asked[first : first + n] = 0
        self.used, self.count = self.used + len(ids), first + n
        return first

    def take(self, slots: np.ndarray) -> np.ndarray:
        """The ids of slots, joined."""
        sizes = self.size[slots]
        shift = self.start[slots] - (np.cumsum(sizes) - sizes)
        at = np.repeat(shift, sizes)
        at += np.arange(len(at))
        return self.ids[at]


class Encoder:
    """spaced: whether a space belongs to the piece behind it (byte-level) or is dropped (word-level); pieces: how many to keep, PIECES if 0."""

    def __init__(self, file: str, spaced: bool, plain: bool = False, pieces: int = 0) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = plain
        self.letters = None if spaced else _for_letters(self.tokenizer)
        self.spaced, self.pieces = spaced, pieces
        special = {} if plain else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.special_re = re.compile("|".join(f"({re.escape(s)})" for s in special)) if special else None
        self.special_ids = list(special.values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.closes = np.zeros(len(self.opens), bool)  # tokens that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.line_end, self.mark = self._one("\n"), self._one(_MARK)
        self.store = _Store()
        #: Slots of pieces that follow a space, and of all others.
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.runs: dict[str, int] = {}  # of line ends, in front of a word

    def _one(self, text: str) -> int:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids[0] if len(ids) == 1 else -1

    # the library's part

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _joined(self, pieces: list[str], inner: bool, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of pieces without white space, encoded many at once and told apart by tokens between them.

        words: whether they are _LETTERS only, so that the last token of each (and no other) ends a word.
        """
        all_ids, all_sizes = [], []
        for at in range(0, len(pieces), _TOGETHER):
            part = pieces[at : at + _TOGETHER]
            text = " " + " ".join(part) if inner or words else "\n".join(part) if self.spaced else f" {_MARK} ".join(part)
            asked = self.letters if words and self.letters else self.tokenizer
            ids = np.array(asked.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            if inner:
                where = np.flatnonzero(self.opens[ids])
                good, sizes = len(where) == len(part), np.diff(where, append=len(ids))
            elif words:
                where = np.flatnonzero(self.closes[ids])
                good, sizes = len(where) == len(part), np.diff(where, prepend=-1)
            else:
                between = ids == (self.line_end if self.spaced else self.mark)
                where = np.flatnonzero(between)
                good, sizes = len(where) == len(part) - 1, np.diff(where, prepend=-1, append=len(ids)) - 1
                ids = ids[~between]
            if not good:
                ids, sizes = self._library([" " + p if inner else p for p in part])
            all_ids.append(ids)
            all_sizes.append(sizes)
        return np.concatenate([np.zeros(0, np.uint32), *all_ids]), np.concatenate([np.zeros(0, np.int64), *all_sizes])

    def _new(self, pieces: list[str], known: dict[str, int], inner: bool) -> None:
        """Encodes pieces that are not known."""
        odd = [p for p in pieces if not p or _MARK in p or p.split() != [p]]
        if odd:
            apart = set(odd)
            pieces = [p for p in pieces if p not in apart]
            ids, sizes = self._library([" " + p if inner else p for p in odd])
            known.update(zip(odd, range(at := self.store.add(ids, sizes), at + len(odd)), strict=True))
        if pieces and (self.spaced and not inner and self.line_end < 0 or not self.spaced and self.mark < 0):
            ids, sizes = self._library(pieces)
        else:
            ids, sizes = self._joined(pieces, inner)
        known.update(zip(pieces, range(at := self.store.add(ids, sizes), at + len(pieces)), strict=True))

    def _words(self, words: list[str], known: dict[str, int], inner: bool) -> None:
        """Encodes words of _LETTERS that are not known."""
        if self.spaced:
            self._new(words, known, inner)
        elif words:
            ids, sizes = self._joined(words, False, words=True)
            known.update(zip(words, range(at := self.store.add(ids, sizes), at + len(words)), strict=True))

    def _learn(self, pieces: list[str], known: dict[str, int], inner: bool) -> None:
        """Makes pieces known. A word of letters and the signs that close it are two pieces to both tokenizers, so words meet again."""
        array = pa.array(pieces, pa.string())
        word = pc.utf8_rtrim(array, _CLOSING)
        length = _ints(pc.utf8_length(word))
        letters = pc.match_substring_regex(word, _LETTERS).to_numpy(zero_copy_only=False)
        closed = length < _ints(pc.utf8_length(array))
        self._words(_strings(array.filter(pa.array(letters & ~closed))), known, inner)
        self._new(_strings(array.filter(pa.array(~letters))), known, inner)
        cut = letters & closed
        if not cut.any():
            return
        words, wholes = _strings(word.filter(pa.array(cut))), _strings(array.filter(pa.array(cut)))
        ends = [p[n:] for p, n in zip(wholes, length[cut].tolist(), strict=True)]
        new = list(set(words).difference(known))
        self._words(new, known, inner)
        side = self.first if self.spaced else known
        new = list(set(ends).difference(side))
        if new:
            self._new(new, side, False)
        pairs = np.empty(2 * len(words), np.int64)
        pairs[0::2] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        pairs[1::2] = np.fromiter(map(side.__getitem__, ends), np.int64, len(words))
        at = self.store.add(self.store.take(pairs), self.store.size[pairs].reshape(-1, 2).sum(axis=1))
        known.update(zip(wholes, range(at, at + len(wholes)), strict=True))

    def _slots(self, pieces: pa.Array, known: dict[str, int], inner: bool) -> np.ndarray:
        names = _strings(pieces)
        slots = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        where = np.flatnonzero(slots < 0)
        if len(where):
            missing = [names[k] for k in where.tolist()]
            self._learn(missing, known, inner)
            slots[where] = np.fromiter(map(known.__getitem__, missing), np.int64, len(missing))
        self.store.asked[slots] += 1
        return slots

    def _forget(self) -> None:
        """Keeps the pieces that were asked for in several batches; of too many of them those asked for most."""
        old, self.store = self.store, _Store()
        for known in (self.inner, self.first, self.runs):
            names, slots = list(known), np.fromiter(known.values(), np.int64, len(known))
            often = np.flatnonzero(old.asked[slots] > 1)
            if len(often) > (self.pieces or PIECES) // 2:
                often = often[np.argsort(old.asked[slots[often]], kind="stable")[-((self.pieces or PIECES) // 2) :]]
            slots, names = slots[often], [names[k] for k in often.tolist()]
            at = self.store.add(old.take(slots), old.size[slots])
            self.store.asked[at : at + len(names)] = old.asked[slots] // 2
            known.clear()
            known.update(zip(names, range(at, at + len(names)), strict=True))

    # cutting

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pieces of texts, and the number of pieces of each text."""
        if not self.spaced:
            lower = _ascii_lower(texts)  # the tokenizer lower-cases, sign by sign
            if self.special:
                # Special tokens are cut out by now. A string that becomes one in lower case is none to the library, which looks at raw texts.
                made = pc.match_substring_regex(lower, "|".join(map(re.escape, self.special)))
                if pc.any(made).as_py():
                    lower = pc.if_else(made, texts, lower)
            cut = pc.ascii_split_whitespace(lower)
            coded = cut.flatten().dictionary_encode()
            slots = self._slots(coded.dictionary, self.inner, False)
            return slots[_ints(coded.indices)], np.diff(_ints(cut.offsets))
        cut = pc.split_pattern(pc.replace_substring_regex(texts, r"(\n+)", r" \1 "), " ")
        coded, ends = cut.flatten().dictionary_encode(), _ints(cut.offsets)
        names, index = coded.dictionary, _ints(coded.indices)
        lines = pc.match_substring_regex(names, r"\A\n+\z").to_numpy(zero_copy_only=False)
        odd = ~lines & (pc.not_equal(pc.utf8_trim_whitespace(names), names).to_numpy(zero_copy_only=False) | pc.equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False))
        line = lines[index]
        heads = np.zeros(len(index), bool)
        heads[ends[:-1]] = True
        if odd.any():
            bad = np.add.reduceat(odd[index].astype(np.int64), ends[:-1]) > 0
            bad &= np.diff(ends) > 1  # an empty or blank text is one piece
        else:
            bad = np.zeros(len(texts), bool)
        good = np.repeat(~bad, np.diff(ends))
        first = heads | line
        first[1:] |= line[:-1]
        slots = np.full(len(index), -1, np.int64)
        for kind, known, inner in ((first & ~line & good, self.first, False), (~first & good, self.inner, True)):
            which = np.zeros(len(names), bool)
            which[index[kind]] = True
            of = np.zeros(len(names), np.int64)
            of[which] = self._slots(names.filter(pa.array(which)), known, inner)
            slots[kind] = of[index[kind]]
        line &= good
        if line.any():
            slots[line] = self._line_ends(names, index, line, heads, ends)
        counts = np.diff(ends)
        if bad.any():
            slots, counts = self._one_by_one(texts, bad, slots, good, counts)
        return slots, counts

    def _line_ends(self, names: pa.Array, index: np.ndarray, line: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of runs of line ends: in front of a word the last one is a token of its own."""
        which = np.zeros(len(names), bool)
        which[index[line]] = True
        runs = names.filter(pa.array(which)).to_pylist()
        for run in set(runs).difference(self.runs):
            ids, _ = self._library([run + "a"])
            self.runs[run] = self.store.add(ids[:-1], np.array([len(ids) - 1]))
        of = np.zeros(len(names), np.int64)
        of[which] = [self.runs[r] for r in runs]
        self.store.asked[of[which]] += 1
        return of[index[line]]

    def _one_by_one(self, texts: pa.Array, bad: np.ndarray, slots: np.ndarray, good: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = [_BEFORE_WORD.split(t) for t in texts.filter(pa.array(bad)).to_pylist()]
        sizes = np.array([len(c) for c in cut], np.int64)
        heads = self._slots_of([c[0] for c in cut], self.first, False)
        rest = self._slots_of([p for c in cut for p in c[1:]], self.inner, True)
        mine = np.full(int(sizes.sum()), -1, np.int64)
        begin = np.cumsum(sizes) - sizes
        mine[begin] = heads
        mine[np.setdiff1d(np.arange(len(mine)), begin, assume_unique=True)] = rest
        counts = counts.copy()
        counts[bad] = sizes
        out = np.empty(int(counts.sum()), np.int64)
        where = np.repeat(bad, counts)
        out[where], out[~where] = mine, slots[good]
        return out, counts

    def _slots_of(self, pieces: list[str], known: dict[str, int], inner: bool) -> np.ndarray:
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        return self._slots(coded.dictionary, known, inner)[_ints(coded.indices)]

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), joined, and how many each has; end_id, if given, closes each text."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        if len(texts) and self.special_re and pc.any(hit := pc.match_substring_regex(texts, "|".join(map(re.escape, self.special)))).as_py():
            return self._with_special(texts, hit.to_numpy(zero_copy_only=False), end_id)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        slots, counts = self._pieces(texts)
        if end_id is not None:
            at = self.store.add(np.array([end_id], np.uint32), np.array([1]))
            slots, counts = np.insert(slots, np.cumsum(counts), at), counts + 1
        ids = self.store.take(slots)
        ends = np.concatenate([[0], np.cumsum(self.store.size[slots])])[np.cumsum(counts)]
        if max(len(self.inner), len(self.first)) > (self.pieces or PIECES):
            self._forget()
        return ids, np.diff(ends, prepend=0)

    def _with_special(self, texts: pa.Array, hit: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As encode, where some texts hold special tokens: what lies between them is text by itself."""
        parts, closing, owner = [], [], []
        for k, (text, special) in enumerate(zip(texts.to_pylist(), hit.tolist(), strict=True)):
            at = 0
            for m in self.special_re.finditer(text) if special else ():
                parts.append(text[at : m.start()])
                closing.append(self.special_ids[m.lastindex - 1])
                owner.append(k)
                at = m.end()
            parts.append(text[at:])
            closing.append(-1 if end_id is None else end_id)
            owner.append(k)
        slots, counts = self._pieces(pa.array(parts, pa.large_string()))
        mapped = {i: self.store.add(np.array([i] if i >= 0 else [], np.uint32), np.array([int(i >= 0)])) for i in set(closing)}
        slots = np.insert(slots, np.cumsum(counts), [mapped[i] for i in closing])
        ids = self.store.take(slots)
        sizes = np.diff(np.concatenate([[0], np.cumsum(self.store.size[slots])])[np.cumsum(counts + 1)], prepend=0)
        if max(len(self.inner), len(self.first)) > (self.pieces or PIECES):
            self._forget()
        return ids, np.bincount(np.array(owner), sizes, len(texts)).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(file: str, spaced: bool, plain: bool = False, pieces: int = 0) -> Encoder:
    """One for each worker process."""
    return Encoder(file, spaced, plain, pieces)
