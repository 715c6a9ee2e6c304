"""Token ids of whole texts with a public byte-level BPE, inside Python workers.

The pre-tokeniser never joins anything across a single blank or line break between two other characters, so a text is the
concatenation of its words, each with the blank or break before it. About ``SLICE_BYTES`` of texts at once are cut into words and put
together again by arrays, and each distinct word of a slice is encoded once, ``GROUP`` words in a call. Of a word of letters with ASCII
marks behind it, which are two pre-tokens, only the letters are merged, and go to the model without the pre-tokeniser's rules. A worker
remembers up to ``MOST_STEMS`` words of letters and those of its last slice. Texts with other white space, runs of blanks or blank ends are
encoded whole.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID, SLICE_BYTES, GROUP, MOST_STEMS, MOST_MARKS = 2, 8 << 20, 200, 250_000, 100_000
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe, which may begin a pre-token with letters
#: White space beside blank and line break, by Unicode or by Python's split.
OTHER_SPACE = frozenset(map(chr, [*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_encoders: dict[str, "Encoder"] = {}


def _bytes_of(ids: list[int]) -> bytes:
    """Little-endian uint32."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


BLANK, BREAK = (_byte_characters()[b] for b in b" \n")
#: The code unit that is written for a byte.
WRITTEN = np.array([ord(c) for _, c in sorted(_byte_characters().items())], "<u2")


def _together(ids: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of entries one behind another, ids in each). ``ids`` holds the entries' ids, ``size`` how many each has."""
    counts = size[entry]
    to = np.cumsum(counts)
    return ids[np.repeat((np.cumsum(size) - size)[entry] - to + counts, counts) + np.arange(to[-1] if len(to) else 0)], counts


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model without added tokens; and for letters as they are written for bytes
        self.bare, self.letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer, self.letters.pre_tokenizer = self.tokenizer.pre_tokenizer, pre_tokenizers.CharDelimiterSplit(" ")
        if self.tokenizer.normalizer is not None:
            self.bare.normalizer = self.tokenizer.normalizer
        self.end, self.marks = _bytes_of([END_ID]), {}
        self.stems = pa.array([], pa.large_string()), *self._joined(pa.array([], pa.large_string()), " ", self.letters)
        self.begins = {c: np.zeros(self.tokenizer.get_vocab_size(), bool) for c in (BLANK, BREAK)}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token[0] in self.begins:
                self.begins[token[0]][i] = True

    def encode(self, text: str) -> bytes:
        return _bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        """Ids of a text and the end id, as bytes; a null text is empty."""
        return next(self.each(pa.array([text], pa.large_string())))

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """``ids`` of every text, in order."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield from self._slice(texts.slice(at, stop - at))
            at = stop

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(n) - n
        later = np.ones(len(words), bool)  # a first word has no blank before it
        later[begins] = False
        found = words.filter(pa.array(later)).dictionary_encode()
        ids, size, whole = self._words(found.dictionary)
        first = words.take(pa.array(begins)).to_pylist()
        rough = np.array([not x or not OTHER_SPACE.isdisjoint(x) for x in first])
        own = [b"" if r else self.encode(x) for x, r in zip(first, rough, strict=True)] + [self.end]
        ids = np.concatenate([ids, np.frombuffer(b"".join(own), "<u4")])
        size = np.concatenate([size, np.fromiter(map(len, own), np.int64, len(own)) // 4])

        # an entry for each word of each text and for its end
        row = np.arange(len(texts))
        heads, tails = begins + row, begins + row + n
        place = np.ones(len(words) + len(texts), bool)
        place[heads] = place[tails] = False
        entry = np.empty(len(place), np.int64)
        entry[place], entry[heads], entry[tails] = found.indices.to_numpy(zero_copy_only=False), len(whole) + row, len(size) - 1
        whole = np.logical_or.reduceat(np.concatenate([whole, rough, [False]])[entry], heads)
        for token in self.added:  # one id each, whatever is around them
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)

        ids, counts = _together(ids, size, entry)
        raw, to = ids.tobytes(), np.cumsum(counts)
        for k, (w, a, b) in enumerate(zip(whole.tolist(), (to - counts)[heads].tolist(), to[tails].tolist(), strict=True)):
            yield self.encode(texts[k].as_py()) + self.end if w else raw[4 * a:4 * b]

    def _words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each word, whether a text with it is encoded whole) of words after a blank or with their line break."""
        n, stem = len(words), pc.utf8_rtrim(words, MARKS)
        alone = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False).astype(bool)  # letters, and marks perhaps
        others = np.flatnonzero(~alone)
        whole, broken = np.zeros(n, bool), np.zeros(n, bool)
        listed = words.take(pa.array(others)).to_pylist()
        whole[others] = [x in ("", "\n") or not OTHER_SPACE.isdisjoint(x) for x in listed]
        broken[others] = [x[:1] == "\n" for x in listed]
        broken &= ~whole
        blank = ~(alone | broken | whole)

        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1] if n else np.zeros(1, np.int64)
        length = np.where(alone, np.diff(at) - pc.binary_length(stem).to_numpy(zero_copy_only=False), 0)
        to = np.cumsum(length)
        places = np.repeat(at[1:] - to, length) + np.arange(to[-1] if n else 0)
        cut = [np.append(0, to), np.frombuffer(words.buffers()[2] or b"", np.uint8)[places]]
        marks = pa.Array.from_buffers(pa.large_string(), n, [None, *map(pa.py_buffer, cut)]).dictionary_encode()  # mostly empty
        stems = stem.filter(pa.array(alone)).dictionary_encode()

        *stem_ids, stem_at = self._stems(stems.dictionary)
        parts = [stem_ids, self._marks(marks.dictionary.to_pylist()),
                 self._joined(words.filter(pa.array(blank)), " ", self.bare), self._joined(words.filter(pa.array(broken)), "", self.bare)]
        size = np.concatenate([*(x for _, x in parts), [0]])
        first = np.cumsum([0, *(len(x) for _, x in parts)])
        entry = np.full((n, 2), len(size) - 1)
        entry[alone, 0], entry[:, 1] = stem_at[stems.indices.to_numpy(zero_copy_only=False)], first[1] + marks.indices.to_numpy(zero_copy_only=False)
        entry[blank, 0], entry[broken, 0] = first[2] + np.arange(blank.sum()), first[3] + np.arange(broken.sum())
        ids, counts = _together(np.concatenate([x for x, _ in parts]), size, entry.ravel())
        return ids, counts.reshape(n, 2).sum(axis=1), whole

    def _stems(self, stems: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each entry, entry of each of the distinct ``stems``)."""
        known, ids, size = self.stems
        at = pc.index_in(stems, value_set=known)
        new = stems.filter(at.is_null())
        new_ids, new_size = self._joined(new, " ", self.letters)
        ids, size, at = np.concatenate([ids, new_ids]), np.concatenate([size, new_size]), at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        at[at < 0] = len(known) + np.arange(len(new))
        if len(size) <= MOST_STEMS:
            self.stems = pa.concat_arrays([known, new]), ids, size
        else:
            self.stems = stems, *_together(ids, size, at)
        return ids, size, at

    def _marks(self, marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.marks) > MOST_MARKS:
            self.marks.clear()
        for mark in marks:
            if mark not in self.marks:
                self.marks[mark] = self.encode(mark)
        found = [self.marks[mark] for mark in marks]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _joined(self, words: pa.LargeStringArray, before: str, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words that are encoded with ``before`` ahead, in groups. A word begins where an id begins with the
        blank or break: neither stands elsewhere in a word."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(words), GROUP), len(words)], pa.int32()), words.cast(pa.string()))
        texts = [before + x for x in pc.binary_join(groups, before).to_pylist()]
        if tokenizer is self.letters:
            texts = [WRITTEN[np.frombuffer(x.encode(), np.uint8)].tobytes().decode("utf-16-le").replace(BLANK, " " + BLANK)[1:] for x in texts]
        ids = np.concatenate([np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        starts = np.flatnonzero(self.begins[BLANK if before else BREAK][ids])
        assert len(starts) == len(words), "a tokenizer that joins words"
        return ids, np.diff(starts, append=len(ids))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
