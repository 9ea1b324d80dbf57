"""Byte-level BPE with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be joined by any
merge, so the text may be cut there: encoding the fragments apart and concatenating gives the
ids of the whole text. The table of such pairs is read off the vocabulary (`forced_pairs`).

The tokenizer also splits text by a pattern before merging. A forced cut leaves that split's
effect unchanged if (a) the right byte is ASCII white space, or (b) the left byte is ASCII and
not white space and the right one is no apostrophe; other forced pairs are not used, since after
white space the pattern looks ahead and an apostrophe may begin a contraction. Strings of special tokens are
cut out first, as the library does.

Rows are encoded many at a time: a row's end is a forced boundary too. Equal fragments of a block are
found by their bytes (numpy), each distinct one is looked up once in a bounded table fragment -> packed ids that a
worker keeps, and what is not in it goes to the tokenizers library, as texts of fragments whose
joints are forced boundaries, so its answer can be cut again at the fragments' ends.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from darkslide.llm.textbuf import mix, U

#: Fragments in a worker's table. A full one becomes the table before, from which fragments that are met
#: again move to the new one; so at most twice as many (or those of one window, if more) are held, and common ones stay.
MEMO_FRAGMENTS = 300_000
#: Longer fragments are encoded without being remembered.
MEMO_BYTES = 64
#: Bytes of text encoded at a time; longer rows are taken in windows that end at forced boundaries.
WINDOW_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """(256, 256) bool: True where the two bytes stand side by side in no token."""
    forced = np.ones((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        forced[b[:-1], b[1:]] = False
    return forced


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ForcedBoundaryBpe:
    """Encoder and decoder over one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        forced = forced_pairs(list(bytes_of.values()))
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in white space aren't supported")
        self.special = {t["content"].encode(): np.uint32(t["id"]).tobytes() for t in spec["added_tokens"]}
        bytes_of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        left, right = np.indices((256, 256))
        safe = _SPACE[right] | ((left < 128) & ~_SPACE[left] & (right != ord("'")))
        self.cut = (forced & safe).ravel()
        # bytes of all tokens, one after the other
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.length = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.memo: dict[bytes, bytes] = dict(self.special)
        self.before: dict[bytes, bytes] = {}

    def boundaries(self, data: np.ndarray) -> np.ndarray:
        """bool by byte: True where the text may be cut before it. Special tokens are cut out whole."""
        flag = np.zeros(len(data), bool)
        flag[1:] = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        for text in self.special:
            for m in re.finditer(re.escape(text), data.data):
                flag[m.start()] = True
                flag[m.start() + 1 : m.end()] = False
                flag[m.end() : m.end() + 1] = True
        return flag

    def fragments(self, data: bytes) -> list[bytes]:
        """The text cut at every usable forced boundary."""
        at = np.flatnonzero(self.boundaries(np.frombuffer(data, np.uint8))[1:]) + 1
        return [data[i:j] for i, j in zip([0, *at.tolist()], [*at.tolist(), len(data)], strict=True)] if data else []

    def _library(self, fragments: list[bytes]) -> list[bytes]:
        """Packed ids of distinct fragments, from the library."""
        out: list[bytes] = []
        for lo in range(0, len(fragments), 16384):
            some = fragments[lo : lo + 16384]
            ends = np.frombuffer(bytes(x for p in some for x in (p[0], p[-1])), np.uint8).reshape(-1, 2).astype(np.uint16)
            apart = np.flatnonzero(~self.cut[(ends[:-1, 1] << 8) | ends[1:, 0]]) + 1
            runs = [some[i:j] for i, j in zip([0, *apart.tolist()], [*apart.tolist(), len(some)], strict=True)]
            found = self.tokenizer.encode_batch_fast([b"".join(r).decode() for r in runs], add_special_tokens=False)
            for run, e in zip(runs, found, strict=True):
                ids = np.array(e.ids, np.uint32)
                done, wanted = np.cumsum(self.length[ids]), np.cumsum([len(p) for p in run])
                at = np.searchsorted(done, wanted)
                if len(run) > 1 and not np.array_equal(done[np.minimum(at, len(done) - 1)], wanted):
                    # the joint of two fragments made the text of a special token
                    out += [packed(x.ids) for x in self.tokenizer.encode_batch_fast([p.decode() for p in run], add_special_tokens=False)]
                    continue
                raw, stops = ids.astype("<u4").tobytes(), (4 * (at + 1)).tolist()
                out += [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        return out

    def _packed_ids(self, fragments: list[bytes]) -> list[bytes]:
        """Packed ids of fragments, from the table or the library."""
        found = list(map(self.memo.get, fragments))
        missed = [i for i, x in enumerate(found) if x is None]
        if len(self.memo) + len(missed) > MEMO_FRAGMENTS:
            self.before, self.memo = self.memo, dict(self.special)
            missed = list(range(len(fragments)))
        wanted = [fragments[i] for i in missed]
        ids = list(map(self.before.get, wanted))
        new = [k for k, x in enumerate(ids) if x is None]
        texts = [wanted[k] for k in new]
        for k, x in zip(new, self._library(texts), strict=True):
            ids[k] = x
        self.memo.update(zip(wanted, ids, strict=True))
        for p in texts:
            if len(p) > MEMO_BYTES:
                self.memo.pop(p, None)
        for i, x in zip(missed, ids, strict=True):
            found[i] = x
        return found

    def _window(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        flag = np.concatenate([self.boundaries(data), [False]])
        for text in self.special if len(offsets) > 2 else ():
            if text in data.data.tobytes():  # one that begins in a row and ends in the next is no token
                return self._each(data, offsets)
        flag[offsets] = True
        start = np.flatnonzero(flag[:n])
        length = np.diff(np.append(start, n))
        # equal fragments: by their bytes if they have at most 16, found by a hash and then compared
        wide = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray(n + 8, "<u8", wide.data, strides=(1,))
        low = words[start] & _LOW[np.minimum(length, 8)]
        high = words[np.minimum(start + 8, n)] & _LOW[np.clip(length - 8, 0, 8)]
        code, _ = pd.factorize(mix(low * U(0x9E3779B97F4A7C15) + mix(high + length.astype(np.uint64))))
        first = np.empty(int(code.max(initial=-1)) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        of = first[code]
        odd = np.flatnonzero((length > 16) | (low != low[of]) | (high != high[of]) | (length != length[of]))
        raw = data.tobytes()
        fragments = [raw[i:j] for i, j in zip(start[first].tolist(), (start + length)[first].tolist(), strict=True)]
        places: dict[bytes, int] = {}
        for k in odd.tolist():
            p = raw[start[k] : start[k] + length[k]]
            if p != fragments[code[k]]:
                code[k] = places.setdefault(p, len(fragments) + len(places))
        found = self._packed_ids([*fragments, *places])
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n_ids = size[code]
        total = np.concatenate([[0], np.cumsum(n_ids)])
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - total[:-1], n_ids) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, offsets)])

    def _each(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._window(data[i:j], np.array([0, j - i]))[0] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)

    def _stop(self, data: np.ndarray, at: int) -> int:
        """A boundary near WINDOW_BYTES after `at`, or later if there is none before."""
        size, longest = WINDOW_BYTES, max(map(len, self.special), default=0)
        while at + size < len(data):
            found = np.flatnonzero(self.boundaries(data[at : at + size + longest])[1:size])
            if len(found):
                return at + int(found[-1]) + 1
            size *= 2
        return len(data)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows data[offsets[i]:offsets[i + 1]] one after the other (unsigned 32-bit), and their
        number in each row."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if len(data) <= 2 * WINDOW_BYTES:
            return self._window(data, offsets)
        parts, counts = [], []
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            row, at, n = data[i:j], 0, 0
            while at < len(row):
                stop = self._stop(row, at)
                parts.append(self._window(row[at:stop], np.array([0, stop - at]))[0])
                at, n = stop, n + len(parts[-1])
            counts.append(n)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array(counts, np.int64)

    def encode(self, data: bytes) -> bytes:
        """Packed ids of one text."""
        return self.encode_rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].astype("<u4").tobytes()

    def decode_rows(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of rows of ids, in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        out, ends = [], np.concatenate([[0], np.cumsum(counts)]).tolist()
        lo = 0
        while lo < len(counts):  # some rows at a time: a byte takes 8 bytes of indices
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), "right")) - 1)
            some = ids[ends[lo] : ends[hi]]
            length = self.length[some]
            total = np.concatenate([[0], np.cumsum(length)])
            raw = self.bytes[np.repeat(self.start[some] - total[:-1], length) + np.arange(total[-1])].tobytes()
            stops = total[np.array(ends[lo : hi + 1]) - ends[lo]].tolist()
            out += [raw[i:j].decode("utf-8", "replace").encode() for i, j in zip(stops[:-1], stops[1:], strict=True)]
            lo = hi
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids."""
        ids = np.frombuffer(packed, "<u4")
        return self.decode_rows(ids, np.array([len(ids)]))[0].decode()


@functools.lru_cache(2)
def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder per worker and file."""
    return ForcedBoundaryBpe(path)
