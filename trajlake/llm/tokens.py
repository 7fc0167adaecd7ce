"""Token ids of whole texts by a tokenizer of the ``tokenizers`` library, for Arrow batches.

The library's pre-tokenizers never join what a blank parts, so a text is cut before its blanks (and
before a full stop or comma that ends a word), each distinct piece is encoded once by the library, and
the ids of a text are put together from those of its pieces. Natural text repeats its words, so a task
encodes a small part of what it reads. Pieces are told apart by length and a 64-bit hash. Texts with
other white space than blanks and line ends are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from trajlake.llm.common import BYTE_VALUES, LOWER_VALUES, RUN_BYTES, mix, prefix_hashes, runs, segment_hashes

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
# Bytes that may be part of white space other than " " and "\n".
_ODD_SPACE = np.zeros(256, bool)
_ODD_SPACE[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# Bytes outside visible ASCII and U+00C0 to U+00FF: texts with them may change when normalised.
_STRANGE = np.ones(256, bool)
_STRANGE[33:127] = _STRANGE[0x80:0xC0] = _STRANGE[0xC3] = False
WORDS_PER_TEXT = 64
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _letter_before(text: np.ndarray) -> np.ndarray:
    """Whether a letter known to every pre-tokenizer (ASCII, or U+00C0 to U+00FF) ends before each byte."""
    out = np.zeros(len(text), bool)
    out[1:] = _LETTER[text[:-1]]
    wide = (text[:-2] == 0xC3) & (text[1:-1] != 0x97) & (text[1:-1] != 0xB7)
    out[2:] |= wide
    return out


class PieceIds:
    """Ids of known pieces: sorted keys in two levels, ids in one growing array."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if unknown."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in self.levels:
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hit = known[at] == keys
                out[hit] = slots[at[hit]]
        return out

    def put(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Append the ids of pieces, one piece after the other; their slots."""
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = ids
        slots = len(self.start) + np.arange(len(length))
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += total
        return slots

    def remember(self, keys: np.ndarray, slots: np.ndarray) -> None:
        recent = tuple(np.concatenate(x) for x in zip(self.levels[1], (keys, slots)))
        if len(recent[0]) > max(50_000, len(self.levels[0][0]) // 8):
            self.levels = [_sorted(tuple(np.concatenate(x) for x in zip(self.levels[0], recent))),
                           (np.empty(0, np.uint64), np.empty(0, np.int64))]
        else:
            self.levels[1] = _sorted(recent)


def _sorted(level: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(level[0], kind="stable")
    return level[0][order], level[1][order]


class Encoder:
    """Encode rows of text, each followed by ``end_id``.

    ``known_pieces`` bounds what a worker remembers between batches; beyond it, it starts anew.
    """

    def __init__(self, path: str, end_id: int | None, known_pieces: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # What all added tokens begin with, and any of them in whatever case.
        self.added_start = os.path.commonprefix(added)
        self.added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.pieces = PieceIds(known_pieces)
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # Bytes of the text that each id stands for: a vocabulary letter is a byte.
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token.removesuffix(suffix) if suffix else token)
        # A tokenizer that drops blanks, or case, gives one piece the ids of another: they share a key.
        self.blank_bytes = int(self.id_bytes[self._library([" a"])[0]].sum()) - 1  # 0 if blanks are dropped
        lower = [self._library([x])[0].tolist() for x in ("ABC xyz", "abc xyz")]
        self.values = LOWER_VALUES if lower[0] == lower[1] else BYTE_VALUES

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([i for x in found for i in x], np.uint32), length

    def _words(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words with the blank before each: many in one text, told apart by their bytes."""
        if not len(start):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        blank = b"" if self.blank_bytes else b" "
        words = [blank + raw[i:j] for i, j in zip(start.tolist(), end.tolist())]
        ids, _ = self._library([b"".join(words[i:i + WORDS_PER_TEXT]).decode() for i in range(0, len(words), WORDS_PER_TEXT)])
        upto = np.cumsum(self.id_bytes[ids])
        ends = np.cumsum(end - start)
        at = np.searchsorted(upto, ends)
        if len(upto) and at[-1] == len(upto) - 1 and (upto[at] == ends).all():
            return ids, np.diff(at + 1, prepend=0)
        return self._library([w.decode() for w in words])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the n + 1 bounds of the rows in it."""
        flats, lengths = [], []
        for first, last in runs(offsets):
            rows = offsets[first:last + 1]
            parts = _cut_long(data, rows) if rows[-1] - rows[0] > RUN_BYTES else rows
            counts = 0
            for a, b in ((0, last - first),) if parts is rows else [(i, i + 1) for i in range(len(parts) - 1)]:
                closes = parts is rows or b == len(parts) - 1
                flat, n = self._run(data, parts[a:b + 1], closes)
                flats.append(flat)
                counts = n if parts is rows else counts + n
            lengths.append(counts)
        bounds = np.zeros(len(offsets), np.int64)
        if lengths:
            np.cumsum(np.concatenate(lengths), out=bounds[1:])
        return np.concatenate(flats) if flats else np.empty(0, np.uint32), bounds

    def _run(self, data: np.ndarray, rows: np.ndarray, closes: bool) -> tuple[np.ndarray, np.ndarray]:
        text = data[rows[0]:rows[-1]]
        at = rows - rows[0]
        n = len(text)
        filled = at[:-1][np.diff(at) > 0]
        first = np.zeros(n, bool)
        first[filled] = True
        blank = (text == 32) | (text == 10)
        last = np.ones(n, bool)
        last[:-1] = first[1:] | blank[1:]
        before = np.ones(n, bool)
        before[1:] = blank[:-1]
        cut = first | (blank & ~before)
        cut[2:] |= (text[1:-1] == 10) & ~blank[:-2] & _LETTER[text[2:]]
        if n > 2:
            cut |= ((text == 46) | (text == 44)) & last & _letter_before(text)
        whole = self._odd_rows(text, at)
        for r in whole:
            cut[at[r] + 1:at[r + 1]] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        own = start if self.blank_bytes else start + (blank[start] & (end - start > 1))
        keys = mix(segment_hashes(prefix_hashes(text, self.values), own, end) + (end - own).astype(np.uint64))
        unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.pieces.start) > self.pieces.limit:
            self.pieces.clear()
        slots = self.pieces.slots(unique)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = text.tobytes()
            strange = np.zeros(n + 1, np.int64)
            np.cumsum(_STRANGE[text], out=strange[1:])
            s, e = own[where[new]], end[where[new]]
            word = (e - s <= 64) & (strange[e] == strange[s])
            if self.blank_bytes:
                word = (text[s] == 32) & (e - s > 1) & (e - s <= 64)
                word[word] = strange[e[word]] == strange[s[word] + 1]
            slots[new[word]] = self.pieces.put(*self._words(raw, s[word], e[word]))
            slots[new[~word]] = self.pieces.put(*self._library([
                raw[i:j].decode("utf-8", "replace") for i, j in zip(s[~word].tolist(), e[~word].tolist())]))
            short = (e - s) <= 64
            self.pieces.remember(unique[new[short]], slots[new[short]])
        # The end of a row is a piece of its own.
        closing = self.pieces.put(self.end if closes else self.end[:0], np.array([len(self.end) if closes else 0]))[0]
        order = np.insert(slots[inverse], np.searchsorted(start, at[1:]), closing)
        length = self.pieces.length[order]
        upto = np.cumsum(length)
        flat = self.pieces.flat[np.repeat(self.pieces.start[order] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.searchsorted(start, at[1:]) + np.arange(1, len(at))
        total = upto[ends - 1]
        return flat, np.diff(total, prepend=0)

    def _odd_rows(self, text: np.ndarray, at: np.ndarray) -> list[int]:
        """Rows that the library must see whole: with unusual spaces, or with the text of a token outside the model."""
        found = set()
        if self.added is not None:
            raw = text.tobytes()
            if self.added_start in raw:
                hits = np.array([m.start() for m in self.added.finditer(raw)], np.int64)
                found.update((np.searchsorted(at, hits, side="right") - 1).tolist())
        hits = np.flatnonzero(_ODD_SPACE[text])
        if len(hits):
            rows = np.unique(np.searchsorted(at, hits, side="right") - 1)
            found.update(r for r in rows.tolist() if _OTHER_SPACE.search(text[at[r]:at[r + 1]].tobytes().decode("utf-8", "replace")))
        return sorted(found)


def _cut_long(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bounds of parts of one long row, cut at blanks between two letters, where no token can span."""
    text = data[rows[0]:rows[-1]]
    safe = 1 + np.flatnonzero(_LETTER[text[:-2]] & (text[1:-1] == 32) & _LETTER[text[2:]])
    bounds = [0]
    while len(text) - bounds[-1] > RUN_BYTES:
        k = int(np.searchsorted(safe, bounds[-1] + RUN_BYTES, side="right")) - 1
        if k < 0 or safe[k] <= bounds[-1]:
            k += 1
            if k >= len(safe):
                break
        bounds.append(int(safe[k]))
    return rows[0] + np.array([*bounds, len(text)], np.int64)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """The encoder of this Python worker; it stays between tasks."""
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
