"""Exact ids of whole texts by the tokenizers library, with every distinct word encoded once in a while.

Both vocabularies split a text before a single space that stands between two other characters: the pieces are encoded
on their own and give the ids of the whole. A text in which a space touches other white space or an end, or which may
hold a special token, goes to the library whole.

The vocabulary of words drops white space, lower-cases and never joins a letter to a mark after it other than an
apostrophe, so that lines, cases and marks are parted beforehand there and fewer distinct words are left.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the widest sense, as a regular expression of Arrow; wider than any tokenizer's only costs time.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]"
_AWKWARD = rf"(?:^|{_SPACE}) | (?:$|{_SPACE})|<\|"
#: A word of letters below U+0100, which are one word to either vocabulary and which no normal form or case rule joins,
#: and the marks after it, which are another; an apostrophe may begin a word of its own and is left to the library.
_PLAIN = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: A letter and a mark after it, which no piece of the vocabulary of words holds together.
_JOINT = r"([A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~])"
#: Characters that a normal form may join to a letter before them: its case then matters.
_JOINS = r"[^\x{0}-\x{2ff}]"
#: Words whose ids a worker keeps, some 200 bytes each, in either of two generations.
KEPT = 350_000
#: Bytes of text that are encoded at once, but at least one text.
STEP = 4_000_000


class Encoder:
    """Encodes batches of texts; `prefixed` says whether a word's ids depend on the space before it."""

    def __init__(self, path: str, prefixed: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.prefixed = prefixed
        self.kept: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.old: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.model, self.folds = self.tokenizer.model, '"Lowercase"' in self.tokenizer.to_str()
        # How the byte-level alphabet writes the space and the characters below U+0100.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (0x20, *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xA1, 0x100))}
        self.marks: dict[str, bytes] = {}
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of each word with `before` in front of it."""
        if len(self.kept[before]) > KEPT:
            # The older half goes; what is met again comes back from it.
            self.old[before], self.kept[before] = self.kept[before], {}
        kept, old, marks = self.kept[before], self.old[before], self.marks
        lead, tokenize, code = before.translate(self.written), self.model.tokenize, "H" if self.dtype is np.uint16 else "I"
        found = list(map(kept.get, words))
        new: dict[str, bytes] = {}
        others = []
        for k, x in enumerate(found):
            if x is not None:
                continue
            word = words[k]
            if (x := old.get(word)) is None:
                if word.isascii() and word.isalpha():
                    core, tail = word, ""
                elif plain := _PLAIN(word):
                    core, tail = plain.groups()
                else:
                    others.append(k)
                    continue
                if self.folds:
                    core = core.lower()
                if (x := new.get(core)) is None:
                    x = new[core] = array(code, [t.id for t in tokenize(lead + (core if core.isascii() else core.translate(self.written)))]).tobytes()
                if tail:
                    if tail not in marks:
                        if len(marks) > KEPT:
                            marks.clear()
                        marks[tail] = self._whole([tail])[0]
                    x += marks[tail]
            kept[word] = found[k] = x
        for a in range(0, len(others), 4096):
            some = others[a:a + 4096]
            for k, x in zip(some, self._whole([before + words[k] for k in some]), strict=True):
                kept[words[k]] = found[k] = x
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        found = [self._encode(texts.slice(a, z - a)) for a, z in _cuts(texts, STEP if self.prefixed else 2 * STEP)]
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def _parted(self, texts: pa.Array) -> pa.Array:
        """Texts of the same ids without their line ends, with a space between a letter and a mark, in lower case."""
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _JOINT, r"\1 \2")
        if not self.folds:
            return texts
        lower, joins = pc.ascii_lower(texts), pc.match_substring_regex(texts, _JOINS)
        return pc.if_else(joins, texts, lower) if pc.any(joins).as_py() else lower

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        awkward = pc.match_substring_regex(texts, _AWKWARD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~awkward)) if awkward.any() else texts
        split = pc.split_pattern(plain if self.prefixed else self._parted(plain), " ")
        offsets = np.asarray(split.offsets)
        words = split.values[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        coded = words.dictionary_encode()
        at = np.asarray(coded.indices)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._words(names, " " if self.prefixed else "")
        if self.prefixed:
            # The first word of a text has no space before it.
            first = offsets[:-1]
            seen, own = np.unique(at[first], return_inverse=True)
            at = at.copy()
            at[first] = len(ids) + own
            ids += self._words([names[k] for k in seen], "")
        flat, ends = self._spread(ids, at)
        lengths = ends[offsets[1:]] - ends[offsets[:-1]]
        if not awkward.any():
            return flat, lengths
        whole = iter(self._whole(texts.filter(pa.array(awkward)).to_pylist()))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out, k = [], 0
        for odd in awkward:
            if odd:
                out.append(np.frombuffer(next(whole), self.dtype))
            else:
                out.append(flat[starts[k]:starts[k + 1]])
                k += 1
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _spread(self, ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of the numbers `at`, and where each of them begins and ends."""
        if not len(at):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        taken = pa.array(ids, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // np.dtype(self.dtype).itemsize
        return np.frombuffer(taken.buffers()[2] or b"", self.dtype, ends[-1]), ends


def _cuts(texts: pa.Array, step: int) -> list[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = (np.flatnonzero(np.diff(sizes // step)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(texts)], strict=True)) if len(texts) else []


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `step` bytes of text, so that a task's memory doesn't follow the batch size."""
    for batch in batches:
        for a, z in _cuts(batch.column(column), step):
            yield batch.slice(a, z - a)
            pa.default_memory_pool().release_unused()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, prefixed: bool, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; it and its words stay from task to task."""
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = Encoder(path, prefixed, special_as_text)
    return _ENCODERS[path, special_as_text]


def with_end(flat: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each text, and the new lengths."""
    return np.insert(flat, np.cumsum(lengths), end), lengths + 1
