"""Token ids of whole texts by the tokenizers library, with the ids of frequent text parts remembered.

A text is cut where a character that is no white space meets ASCII white space.
The byte-level pre-split has no match across such a place, so the ids of the
parts, in order, are the ids of the text.  Parts recur far more often than
texts; those seen are looked up, the others go through the library joined to
longer strings.  Where white space never meets white space, a text is cut in
front of every blank and line feed, which needs no pattern.  Texts with rarer
white space go through the library whole.

Cutting, numbering and looking up parts is done by Arrow on columns, and ids
are gathered by numpy from one array, so no part becomes a Python object.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stipendia.llm.common import ODD_SPACE

_ODD = ODD_SPACE.pattern[:-1] + r"\x00]"  # white space at which no text is cut, and the mark of a cut
_SPACE = r" \t\n\r\f\x0b"
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\f\v"))
_REMEMBERED, _LONG = 600_000, 64  # parts remembered, bytes of the longest
_JOINED, _STRINGS = 250, 20       # parts encoded as one string, such strings in one call
_TOGETHER = 4_000_000             # bytes cut into parts at once


def _ends(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins and the last one ends, and the bytes of all, none between them."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class PartTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.library.get_vocab()  # each character of a byte-level token stands for one byte
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)
        self.known = pa.array([], pa.large_string())  # the parts remembered, with their ids behind each other
        self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.again = np.zeros(0, bool)                # those met again since parts were last forgotten

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and the ids of all in order.  Parts that begin with white space and do not end
        with it are encoded joined, which the library does faster than one by one, and told apart by the bytes their
        ids stand for."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        offsets, data = _ends(parts)
        size = np.diff(offsets)
        first = data[np.minimum(offsets[:-1], len(data) - 1)] if len(data) else np.zeros(len(parts), np.uint8)
        last = data[offsets[1:] - 1] if len(data) else first
        joined = (size > 0) & _BLANK[first] & ~_BLANK[last]
        counts, found = np.zeros(len(parts), np.int64), []
        at = np.flatnonzero(joined)
        together = parts.take(pa.array(at))
        offsets, data = _ends(together)
        for start in range(0, len(at), _JOINED * _STRINGS):
            groups = [offsets[i:i + _JOINED + 1] for i in range(start, min(len(at), start + _JOINED * _STRINGS), _JOINED)]
            for ends, ids in zip(groups, self._whole([data[g[0]:g[-1]].tobytes().decode() for g in groups])):
                cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends[1:] - ends[0]) + 1
                counts[at[start:start + len(cuts)]] = np.diff(cuts, prepend=0)
                start += len(cuts)
                found.append(ids)
        alone = np.flatnonzero(~joined & (size > 0))
        single = self._whole(parts.take(pa.array(alone)).to_pylist())
        counts[alone] = [len(ids) for ids in single]
        order = np.concatenate([at, alone])  # found lies in this order
        ids = np.concatenate(found + single + [np.zeros(0, "<u4")])
        begins = np.zeros(len(parts), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return counts, _gathered(ids, begins, counts)

    def encode(self, texts: list[str | None] | pa.Array, together: int | None = None) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text; null and empty texts have none.  Looking up costs some time
        for every ``together`` bytes (at most, unless one text is longer), which take memory at once."""
        together = together or _TOGETHER
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        taken = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        out, start = [], 0
        while start < len(column):
            end = max(start + 1, int(np.searchsorted(taken, (taken[start - 1] if start else 0) + together, "right")))
            out += self._encode_some(column.slice(start, end - start))
            start = end
        return out

    def _encode_some(self, texts: pa.LargeStringArray) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _ODD)
        meeting = pc.match_substring_regex(texts, f"[{_SPACE}]{{2}}")
        out = np.empty(len(texts), object)
        plain, mixed = pc.invert(pc.or_(odd, meeting)), pc.and_not(meeting, odd)
        marked = pc.replace_substring(pc.replace_substring(texts.filter(plain), " ", "\x00 "), "\n", "\x00\n")
        rest = pc.replace_substring_regex(texts.filter(mixed), f"([^{_SPACE}])([{_SPACE}])", "\\1\x00\\2")
        out[np.concatenate([np.flatnonzero(plain), np.flatnonzero(mixed)])] = self._cut(pa.concat_arrays([marked, rest]))
        at = np.flatnonzero(odd)
        out[at] = [ids.tobytes() for ids in self._whole(texts.filter(odd).to_pylist())]
        return out.tolist()

    def _cut(self, marked: pa.LargeStringArray) -> list[bytes]:
        """Ids of texts whose parts are set off by marks."""
        cut = pc.split_pattern(marked, "\x00")
        numbered = cut.flatten().dictionary_encode()
        parts, number = numbered.dictionary, numbered.indices.to_numpy()
        place = pc.index_in(parts, value_set=self.known)
        new = np.flatnonzero(place.is_null())
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        place[new] = len(self.known) + np.arange(len(new))
        counts, ids = self._encode(parts.take(pa.array(new)))
        self.known = pa.concat_arrays([self.known, parts.take(pa.array(new))])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        self.again = np.concatenate([self.again, np.bincount(number, minlength=len(parts))[new] > 1])
        self.again[place[place < len(self.known) - len(new)]] = True
        begins = np.cumsum(self.counts) - self.counts
        place = place[number]
        counts = self.counts[place]
        packed = _gathered(self.ids, begins[place], counts).tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)])[cut.offsets.to_numpy()] * 4
        self._forget()
        return [packed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _forget(self) -> None:
        """Parts that are long are not remembered; beyond the limit, those not met again lately go as well, or all."""
        keep = pc.binary_length(self.known).to_numpy() <= _LONG
        if len(keep) > _REMEMBERED:
            keep &= self.again
            if keep.sum() > _REMEMBERED // 2:
                keep[:] = False
            self.again[:] = False
        if not keep.all():
            self.ids = self.ids[np.repeat(keep, self.counts)]
            self.known, self.counts, self.again = self.known.filter(pa.array(keep)), self.counts[keep], self.again[keep]


def _gathered(ids: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``counts`` ids that start at ``begins``, after each other."""
    ends = np.cumsum(counts)
    return ids[np.repeat(begins - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PartTokenizer:
    """One per worker process."""
    return PartTokenizer(path)
