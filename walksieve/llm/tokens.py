"""Whole texts to token ids with the tokenizers library, one encoding per different word.

In a byte-level BPE a space that stands between two visible characters begins a new
piece, and so does a single line feed between two; a full stop or comma after a letter
begins one too. So a text is cut there, each different part is encoded once per worker,
and the ids are put together. Parts and their ids are held in NumPy arrays, tens of
bytes a part, and looked up all at once. New parts are encoded many at a
time, as one text; its ids are cut where a token begins with a space (or is a line feed).
Texts with other white space, with characters beyond Latin ones, or with the string of a
special token are encoded as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Different parts that a worker keeps from one call to the next, those used last; twice as
#: many are held before the others go. Results do not depend on it.
KEPT_PARTS = 400_000
AT_ONCE = 1024          # new parts that are encoded as one text
TEXTS = 16              # such texts that the library is given at once
_OTHER = "[^\n -~¡-ɏ]"
_FIRST = "\r"            # stands before a text's first part; no text that is cut has one
_encoders: dict[tuple[str, bool], "Encoder"] = {}


def _characters(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and where each string begins and the last ends."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]], at - at[0]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of `sizes` that begin at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _same(data: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which runs of bytes, of `length` each, are equal."""
    if not len(length):
        return np.empty(0, dtype=bool)
    return np.logical_and.reduceat(data[_runs(at, length)] == other[_runs(other_at, length)], np.cumsum(length) - length)


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each of the strings, none of which is empty."""
    length = np.diff(at)
    powers = np.full(int(length.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64)
    np.multiply.accumulate(powers, out=powers)
    each = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(at[:-1], length)]
    found = np.add.reduceat(each, at[:-1])
    found = (found ^ found >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return found ^ found >> np.uint64(29)


class Encoder:
    def __init__(self, path: str, plain_specials: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # in a byte-level vocabulary these two characters stand for space and line feed
        names = self.library.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, dtype=bool)
        self.spaced[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self.feed = np.arange(len(self.spaced)) == names.get("Ċ", -1)
        self.feed_size = len(self._whole("\n"))
        dot, comma = self._whole("."), self._whole(",")
        self.marks = {ord("."): int(dot[0]), ord(","): int(comma[0])} if len(dot) == len(comma) == 1 else {}
        self.calls = 0
        # the known parts' bytes and ids, one after the other, and the call that used each last
        self.data, self.at = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.starts, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int32)
        self.used = np.empty(0, np.int32)
        # their numbers, sorted, and which part each belongs to
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _words(self, words: pa.LargeStringArray, before: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word with `before` in front, one after the other, and how many each
        has; `begins` are the ids that only begin one."""
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int32)]
        for at in range(0, len(words), AT_ONCE * TEXTS):
            some = words.slice(at, AT_ONCE * TEXTS)
            lists = pa.ListArray.from_arrays(np.minimum(np.arange(0, len(some) + AT_ONCE, AT_ONCE), len(some)), some)
            texts = [before + text for text in pc.binary_join(lists, pa.scalar(before, pa.large_string())).to_pylist()]
            for k, encoded in enumerate(self.library.encode_batch_fast(texts, add_special_tokens=False)):
                own, own_words = np.array(encoded.ids, "<u4"), some.slice(k * AT_ONCE, AT_ONCE)
                starts = np.flatnonzero(begins[own])
                if len(starts) == len(own_words):
                    sizes.append(np.diff(starts, append=len(own)))
                else:                               # another kind of vocabulary
                    each = [self._whole(before + word) for word in own_words.to_pylist()]
                    own = np.concatenate(each)
                    sizes.append(np.array([len(x) for x in each]))
                ids.append(own)
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int32)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null has none."""
        out: list[bytes] = [b""] * len(texts)
        rows = np.array([i for i, text in enumerate(texts) if text], dtype=np.int64)
        if not len(rows):
            return out
        lists = pc.split_pattern(pa.array([texts[i].replace("\n", " \n") for i in rows], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        odd = self._odd(coded.dictionary)
        apart = [s for s in self.specials if " " in s or "\n" in s]
        whole = np.array([any(s in texts[i] for s in apart) for i in rows]) if apart else np.zeros(len(rows), dtype=bool)
        if odd.any():
            whole |= np.logical_or.reduceat(odd[coded.indices.to_numpy()], lists.offsets.to_numpy()[:-1])
        if whole.any():
            for i in rows[whole]:
                out[i] = self._whole(texts[i]).tobytes()
            rows, lists = rows[~whole], lists.filter(pa.array(~whole))
            if not len(rows):
                return out
            coded = lists.values.dictionary_encode()
        offsets, which = lists.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        # a text's first part has no space before it, so it is a part of its own kind
        begins = offsets[:-1]
        first, own = np.unique(which[begins], return_inverse=True)
        which[begins] = len(coded.dictionary) + own
        table, starts, sizes = self._ids_of(coded.dictionary, coded.dictionary.take(pa.array(first)))
        bounds = np.concatenate(([0], np.cumsum(sizes[which])))[offsets].tolist()
        ids = table[_runs(starts[which], sizes[which])]
        for i, x, y in zip(rows, bounds, bounds[1:]):
            out[i] = ids[x:y].tobytes()
        return out

    def _odd(self, parts: pa.LargeStringArray) -> np.ndarray:
        """Which parts keep a text from being cut: those between white space that touches
        other or an end of the text, with other characters, or with a special token."""
        data, at = _characters(parts)
        length = np.diff(at)
        odd = length == 0
        odd[length == 1] = data[at[:-1][length == 1]] == ord("\n")
        text = data.tobytes().decode()
        if re.search(_OTHER, text):
            odd |= pc.match_substring_regex(parts, _OTHER).to_numpy(zero_copy_only=False)
        for special in self.specials:
            if special in text:
                odd |= pc.match_substring(parts, special).to_numpy(zero_copy_only=False)
        return odd

    def _ids_of(self, parts: pa.LargeStringArray, first: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each part begin and how many it has; the parts that are a text's first follow."""
        data, at = _characters(parts)
        last, length = data[at[1:] - 1], np.diff(at)
        before = data[np.maximum(at[1:] - 2, 0)] | 32
        marked = (length > 1) & (data[at[:-1]] != ord("\n")) & (before >= ord("a")) & (before <= ord("z")) & np.isin(last, list(self.marks))
        stays = np.ones(len(data), dtype=bool)
        stays[at[1:][marked] - 1] = False
        bare = _strings(data[stays], np.concatenate(([0], np.cumsum(length - marked))))
        marked = np.append(marked, np.zeros(len(first), dtype=bool))
        first = pa.array([_FIRST + part for part in first.to_pylist()], pa.large_string())
        codes = self._codes(*_characters(pa.concat_arrays([bare, first])))
        sizes = self.sizes[codes] + marked
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        table = np.empty(int(sizes.sum()), "<u4")
        table[_runs(starts, self.sizes[codes])] = self.ids[_runs(self.starts[codes], self.sizes[codes])]
        ends = (starts + sizes - 1)[marked]
        for mark, name in self.marks.items():
            table[ends[last[marked[:len(last)]] == mark]] = name
        if len(self.used) > 2 * KEPT_PARTS:
            self._keep(np.sort(np.argsort(self.used, kind="stable")[-KEPT_PARTS:]))
        return table, starts, sizes

    def _codes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which known part each string is, after new ones are learnt."""
        length, keys, known = np.diff(at), _hashes(data, at), len(self.used)
        codes = np.full(len(length), -1, dtype=np.int64)
        if known:
            near = np.minimum(np.searchsorted(self.keys, keys), known - 1)
            found = self.place[near]
            hit = np.flatnonzero((self.keys[near] == keys) & (np.diff(self.at)[found] == length))
            hit = hit[_same(data, at[hit], self.data, self.at[found[hit]], length[hit])]
            codes[hit] = found[hit]
        new = np.flatnonzero(codes < 0)
        if len(new):
            _, one, own = np.unique(keys[new], return_index=True, return_inverse=True)
            fits = length[new] == length[new[one]][own]
            fits[fits] = _same(data, at[new[fits]], data, at[new[one]][own[fits]], length[new[fits]])
            # other strings with one number are parts of their own
            own[~fits] = len(one) + np.arange(int((~fits).sum()))
            one = new[np.append(one, np.flatnonzero(~fits))]
            codes[new] = known + own
            bytes_ = data[_runs(at[one], length[one])]
            self._learn(_strings(bytes_, np.concatenate(([0], np.cumsum(length[one])))))
            self.data, self.at = np.append(self.data, bytes_), np.append(self.at, self.at[-1] + np.cumsum(length[one]))
            order = np.argsort(keys[one], kind="stable")
            where = np.searchsorted(self.keys, keys[one][order], "right")
            self.keys, self.place = np.insert(self.keys, where, keys[one][order]), np.insert(self.place, where, known + order)
            self.used = np.append(self.used, np.zeros(len(one), np.int32))
        self.calls += 1
        self.used[codes] = self.calls
        return codes

    def _learn(self, words: pa.LargeStringArray) -> None:
        """Appends the ids of new parts: one stands for itself after a space, unless it begins
        with a line feed or is marked as a text's first."""
        data, at = _characters(words)
        begun = data[at[:-1]]
        bare = (begun == ord("\n")) | (begun == ord(_FIRST))
        ids, sizes = self._words(words.filter(pa.array(~bare)), " ", self.spaced)
        more, lines = self._words(pc.utf8_slice_codeunits(words.filter(pa.array(bare)), 1), "\n", self.feed)
        # the parts that begin a text come without the line feed
        cut = np.where(begun[bare] == ord(_FIRST), self.feed_size, 0).astype(np.int32)
        more = np.delete(more, _runs(np.cumsum(lines, dtype=np.int64) - lines, cut))
        length = np.empty(len(words), np.int32)
        length[~bare], length[bare] = sizes, lines - cut
        starts = np.empty(len(words), np.int64)
        starts[~bare], starts[bare] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(lines - cut) - (lines - cut)
        self.starts = np.append(self.starts, len(self.ids) + starts)
        self.ids, self.sizes = np.concatenate((self.ids, ids, more)), np.append(self.sizes, length)

    def _keep(self, kept: np.ndarray) -> None:
        """Forgets all known parts but `kept`, in ascending order."""
        stays = np.full(len(self.used), -1, np.int32)
        stays[kept] = np.arange(len(kept))
        self.place = stays[self.place]
        self.keys, self.place = self.keys[self.place >= 0], self.place[self.place >= 0]
        length = np.diff(self.at)[kept]
        self.data, self.at = self.data[_runs(self.at[kept], length)], np.concatenate(([0], np.cumsum(length)))
        self.ids, self.sizes = self.ids[_runs(self.starts[kept], self.sizes[kept])], self.sizes[kept]
        self.starts, self.used = np.cumsum(self.sizes, dtype=np.int64) - self.sizes, self.used[kept]


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if (path, plain_specials) not in _encoders:
        _encoders[path, plain_specials] = Encoder(path, plain_specials)
    return _encoders[path, plain_specials]


def some_at_a_time(texts: list, most_chars: int = 4_000_000):
    """Index ranges of `texts` with about so many characters each."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most_chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def pieces(column: pa.Array, most_bytes: int = 3_000_000):
    """Index ranges of a column of texts with about so many bytes each, and their texts; the
    rest of the column is not in Python's memory then."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(size // most_bytes)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)]):
        yield a, b, column.slice(a, b - a).to_pylist()
