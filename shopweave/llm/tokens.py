"""Token ids of whole texts with the tokenizers library, a batch of texts at a time.

Neither vocabulary merges across the start of a run of ASCII white space, so the ids of a
text are those of its pieces in turn. Pieces repeat: the library encodes each one once,
and a table keyed by a piece's own bytes gives the ids of all others of a batch in a few
numpy steps. A text that a cut might not be safe for goes to the library whole, as does
every text that holds one of the vocabulary's added tokens.
"""

from __future__ import annotations

import os

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that the table holds before it starts anew, and the bits of its slots.
CACHE, SLOT_BITS = 1 << 20, 21
#: Bytes of a piece that its key has; longer pieces are looked up in a dict.
KEY = 16

#: How the two vocabularies split a text before merging (fixed by their files).
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters up to here need no normalising and fold case one by one; others are left to the library.
PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-įĲ-ɏ]*")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceTable:
    """Where the ids of each known piece lie in ``ids``; open addressing, keys are the bytes themselves.

    A full table takes no more pieces; after eight times as many unknown ones it starts anew.
    """

    def __init__(self, make):
        self.make = make
        self.clear()

    def clear(self) -> None:
        size = 1 << SLOT_BITS
        self.key = np.zeros((size, 2), np.uint64)
        self.info = np.zeros(size, np.int64)  # where the ids are << 24 | 1 + their number << 8 | 1 + bytes of the piece; 0: free
        self.long: dict[bytes, tuple[int, int]] = {}
        self.ids, self.used, self.kept, self.pieces, self.missed = np.zeros(1 << 16, np.uint32), 0, 0, 0, 0

    def _add(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of new pieces' ids; -1 ids for one whose text must go to the library whole."""
        made = list(map(self.make, pieces))
        count = np.array([-1 if x is None else len(x) for x in made], np.int64)
        new = np.array([i for x in made if x for i in x], np.uint32)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(np.maximum(count, 0)) - np.maximum(count, 0)
        self.used += len(new)
        return at, count

    def _probe(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, or the free one where it is missing: linear probing, all keys side by side."""
        place, missing, todo = slot.copy(), [], slice(None)
        while True:
            s = place[todo]
            info, key = self.info[s], self.key[s]
            wrong = (info != 0) & ((key[:, 0] != a[todo]) | (key[:, 1] != b[todo]) | ((info & 255) != size[todo] + 1))
            at = np.arange(len(slot))[todo]
            missing.append(at[info == 0])
            todo = at[wrong]
            if not len(todo):
                return place, np.concatenate(missing)
            place[todo] = (place[todo] + 1) & ((1 << SLOT_BITS) - 1)

    def find(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of ``raw``'s pieces in ``ids``; good until the next call."""
        if self.missed > 8 * CACHE:
            self.clear()
        full = self.pieces + len(self.long) >= CACHE
        self.used = self.kept  # the ids of pieces that a full table has not taken are needed no more
        words = np.ndarray(len(raw) + 1, "<u8", raw + bytes(2 * KEY), strides=(1,))  # eight bytes from each place on
        a = words[begin] & _MASK[np.minimum(size, 8)]
        b = words[np.minimum(begin + 8, len(raw))] & _MASK[np.clip(size - 8, 0, 8)]
        with np.errstate(over="ignore"):
            h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place, missing = self._probe(a, b, size, slot)
        info = self.info[place]
        at, count = info >> 24, (info >> 8 & 0xFFFF) - 1
        if not len(missing):
            return at, count
        far = size[missing] > KEY
        for k in missing[far].tolist():
            piece = raw[begin[k] : begin[k] + size[k]]
            got = self.long.get(piece)
            if got is None:
                got = tuple(int(x[0]) for x in self._add([piece]))
                self.missed += 1
                if not full:
                    self.long[piece] = got
            at[k], count[k] = got
        missing = missing[~far]
        order = missing[np.lexsort((size[missing], b[missing], a[missing]))]
        fresh = np.flatnonzero(np.concatenate([[True], (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]) | (size[order[1:]] != size[order[:-1]])])) if len(order) else order
        one = order[fresh]  # one of each missing piece
        new_at, new_count = self._add([raw[i:j] for i, j in zip(begin[one].tolist(), (begin[one] + size[one]).tolist(), strict=True)])
        self.missed += len(one)
        times = np.diff(np.append(fresh, len(order)))
        at[order], count[order] = np.repeat(new_at, times), np.repeat(new_count, times)
        todo, spot = np.arange(len(one)), place[one]
        while not full and len(todo):  # several may want one slot: one of them gets it
            s = spot[todo]
            free = self.info[s] == 0
            won = np.zeros(len(todo), bool)
            won[np.unique(np.where(free, s, -1), return_index=True)[1]] = True
            won &= free
            t, s = todo[won], s[won]
            self.key[s, 0], self.key[s, 1], self.info[s] = a[one[t]], b[one[t]], new_at[t] << 24 | new_count[t] + 1 << 8 | size[one[t]] + 1
            todo = todo[~won]
            spot[todo] = (spot[todo] + 1) & ((1 << SLOT_BITS) - 1)
        if not full:
            self.pieces, self.kept = self.pieces + len(one), self.used
        return at, count


class Encoder:
    """Ids as ``encode(text, add_special_tokens=False)`` gives them; ``kind`` is ``word`` or ``byte``."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.kind = self.whole.model, kind
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.chars = _byte_chars()
        self.short: dict[str, list[int]] = {}
        self.table = PieceTable(self._word_piece if kind == "word" else self._byte_piece)

    def _library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _split(self, part: str) -> list[int]:
        """Ids of one pre-token."""
        if part.isascii() and part.isprintable():
            text = part.replace(" ", self.chars[32])  # the other printable ones stand for themselves
        else:
            text = part.encode().decode("latin-1").translate(self.chars)
        return [t.id for t in self.model.tokenize(text)]

    def _short(self, part: str) -> list[int]:
        """The same of a part that is likely to come again, such as a stop or a number."""
        got = self.short.get(part)
        if got is None:
            if len(self.short) >= 1 << 16:
                self.short.clear()
            got = self.short[part] = self._split(part)
        return got

    def _word_piece(self, piece: bytes) -> list[int]:
        text = piece.decode()
        last = text[-1]
        stem = text[:-1] if last in ".," else text
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0130"):  # a word, or one with a stop or comma
            own = self._split(stem.lower())
            return own + self._short(last) if last in ".," else own
        if not PLAIN.fullmatch(text):
            return self._library(text)
        return [i for part in WORD_SPLIT.findall(text.lower()) for i in self._short(part)]

    def _byte_piece(self, piece: bytes) -> list[int] | None:
        """A run of white space and what follows it; None where other white space ends it."""
        text = piece.decode()
        last = text[-1]
        stem = text[:-1] if last in ".," else text
        bare = stem[1:] if stem[:1] == " " else stem
        if bare.isalpha() and (bare.isascii() or max(bare) < "\u0130"):
            own = self._split(stem)
            return own + self._short(last) if last in ".," else own
        if last.isspace() and last not in " \t\n\v\f\r":
            return None
        if not PLAIN.fullmatch(text):
            return self._library(text)
        return [i for part in BYTE_SPLIT.findall(text) for i in self._short(part)]

    def _whole_texts(self, raw: bytes) -> bool:
        return any(x in raw for x in self.added)

    def batch(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the rows of ``data`` cut at ``at``, one after the other, and their n + 1 offsets."""
        rows, raw = len(at) - 1, data.tobytes()
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        gap, cut = np.append(_SPACE[data], True), np.zeros(len(data) + 1, bool)
        cut[at] = True
        first = np.concatenate([[True], gap[:-1]]) | cut  # no word goes on here
        if self.kind == "word":
            begin = np.flatnonzero(~gap & first)
            end = np.flatnonzero((gap | cut)[1:] & ~gap[:-1]) + 1
        else:
            begin = np.flatnonzero(((gap & ~np.concatenate([[False], gap[:-1]])) | cut)[:-1])
            end = np.append(begin[1:], len(data))
        row = np.searchsorted(at, begin, side="right") - 1
        place, count = self.table.find(raw, begin, end - begin)
        flat = self.table.ids[: self.table.used]
        whole = set(row[count < 0].tolist())
        if self._whole_texts(raw):
            whole.update(r for r in range(rows) if at[r] < at[r + 1] and self._whole_texts(raw[at[r] : at[r + 1]]))
        if whole:  # the ids of these rows stand in for their first piece's, their other pieces have none
            extra = {r: self._library(raw[at[r] : at[r + 1]].decode()) for r in sorted(whole)}
            count = np.where(np.isin(row, sorted(whole)), 0, count)
            start = len(flat)
            flat = np.concatenate([flat, np.array([i for x in extra.values() for i in x], np.uint32)])
            for r, ids in extra.items():
                k = int(np.searchsorted(row, r))
                if k == len(row) or row[k] != r:  # a row of no piece
                    begin, row, place, count = (np.insert(x, k, v) for x, v in ((begin, at[r]), (row, r), (place, 0), (count, 0)))
                place[k], count[k] = start, len(ids)
                start += len(ids)
        ends = np.cumsum(count)
        ids = flat[np.repeat(place - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(row, np.arange(rows + 1))]

    def ended(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``batch``, with ``end_id`` after each row's ids."""
        ids, cuts = self.batch(data, at)
        return np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))

    def ids(self, text: str) -> bytes:
        """The ids of one text as little-endian uint32 bytes."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.batch(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker process's encoder for a vocabulary file; its table outlives a task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
