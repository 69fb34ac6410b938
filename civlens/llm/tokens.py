"""Token ids of whole texts with the tokenizers library, cached per piece of text.

A byte-level BPE never merges across a lone space or line feed between two characters that are no
white space, nor across a letter or digit and a mark behind it, so a text may be cut in front of those
spaces and marks and each piece encoded once per worker. The cuts
and a 64-bit hash of each piece are found in numpy over the bytes of many texts; the different hashes
of a batch are looked up in the sorted hashes of the known pieces, and only the other pieces are cut
out of the text. The ids are those of encoding the whole text; a test compares them on adversarial
texts.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

CUT = re.compile(r"(?<=\S) (?=\S)")
CACHE_PIECES = 500_000
SEGMENT_CHARS = 1 << 19
BATCH_CHARS = 1 << 20
#: Longer pieces are not told apart by their hash.
HASHED_BYTES = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: The vertical bar stands after letters in a special token, which is one piece.
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and b != 124 for b in range(256)])


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 bytes by
    themselves, the others by the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
SPACE_LETTER = BYTE_LETTERS[32]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_tables(n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
    """A random number for each byte, powers of an odd number and of its inverse (mod 2^64)."""
    if "byte" not in known:
        known["byte"] = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        known["n"] = -1
    if known["n"] < n:
        known["n"] = n = max(n, BATCH_CHARS + (1 << 20))
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            known[name] = np.multiply.accumulate(x)
    return known["byte"], known["up"], known["down"]


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that begin at ``starts``: there, at each lone space or
    line feed between characters that are no white space, and at each mark behind a letter or digit, of
    ASCII or a letter of Latin-1. Characters of three bytes that may be white space count as white
    space here, which only makes pieces longer."""
    n = len(data)
    low = data <= 32
    space = low & ((data == 32) | ((data >= 9) & (data <= 13)) | (data >= 28))
    lone = (data == 32) | (data == 10)
    wide = np.zeros(n + 6, np.uint8)
    wide[3 : n + 3] = data

    def at(k):  # the byte k places further on
        return wide[3 + k : n + 3 + k]

    two = lambda a, b: (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = lambda a: (a >= 0xE1) & (a <= 0xE3)
    spot = np.flatnonzero(lone)
    spot = spot[(spot > 0) & (spot < n - 1)]
    before, after = spot - 1, spot + 1
    ok = ~space[before] & ~space[after]
    ok &= ~two(at(-2)[spot], at(-1)[spot]) & ~(three(at(-3)[spot]) & (at(-1)[spot] >= 0x80))
    ok &= ~two(at(1)[spot], at(2)[spot]) & ~three(at(1)[spot])
    mark = np.flatnonzero(_MARK[data])
    last = at(-1)[mark]
    latin = (at(-2)[mark] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    first = np.zeros(n + 1, bool)
    first[spot[ok]] = first[mark[_LETTER[last] | latin]] = first[starts] = True
    return np.flatnonzero(first[:n])


def joinable(piece: bytes) -> bool:
    """Whether a piece may follow and precede others in one text: it begins with a lone space or line
    feed and has no white space at its other end."""
    inner, last = piece[1:4], piece[-3:]
    return (
        len(piece) > 1 and piece[0] in b" \n" and inner[0] > 32 and last[-1] > 32
        and not 0xE1 <= inner[0] <= 0xE3 and inner[:2] not in (b"\xc2\x85", b"\xc2\xa0")
        and not 0xE1 <= last[0] <= 0xE3 and last[-2:] not in (b"\xc2\x85", b"\xc2\xa0")
    )


def segments(text: str, size: int = SEGMENT_CHARS):
    """Cut a long text at safe spaces, so that a piece list stays bounded."""
    at = 0
    while len(text) - at > size:
        m = CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class PieceTokenizer:
    """Encodes batches of texts; ``encode`` returns flat ids and where each text's ids end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.model._resize_cache(0)  # pieces are remembered here, once
        # a byte-level token is written with one character a byte
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.width = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        for i, token in self.tok.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self._clear()

    def _clear(self):
        self.code: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int32)
        self.again = np.zeros(1 << 14, bool)
        self.used = 0
        self.keys = np.empty(0, np.uint64)  # sorted hashes of pieces, and their numbers
        self.numbers = np.empty(0, np.int64)

    def _learn(self, new: list[bytes]):
        """Encode and store pieces. A run of letters (after a space or not) is one unit of the merges
        and goes straight to the model. Of the others, those that begin with their space or line
        feed are encoded many at a time in one text, where the ids' byte lengths tell where each one
        ends."""
        units, words, plain, single = [], [], [], []
        for p in new:
            spaced = p[0] == 32
            core = p[1:] if spaced else p
            if core.isalpha():  # of ASCII only; its letters stand for themselves
                units.append(p)
                words.append(SPACE_LETTER + core.decode() if spaced else core.decode())
            elif not core.isascii() and core.decode().isalpha():
                units.append(p)
                words.append(p.decode("latin-1").translate(BYTE_LETTERS))
            else:
                (plain if joinable(p) else single).append(p)
        for a in range(0, len(plain), 1024):
            some = plain[a : a + 1024]
            ids = np.array(self._ids(b"".join(some)), np.uint32)
            ends = np.cumsum(self.width[ids])
            stops = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            at = np.searchsorted(ends, stops)
            if ends[-1] == stops[-1] and (ends[at] == stops).all():
                self._store(some, ids, np.diff(at, prepend=-1))
            else:
                single += some
        flat, lens = [], []
        for w in words:
            got = self.model.tokenize(w)
            lens.append(len(got))
            flat += [t.id for t in got]
        for got in self.tok.encode_batch_fast([p.decode() for p in single], add_special_tokens=False):
            lens.append(len(got.ids))
            flat += got.ids
        self._store(units + single, np.array(flat, np.uint32), np.array(lens, np.int64))

    def _ids(self, piece: bytes) -> list[int]:
        return self.tok.encode_batch_fast([piece.decode()], add_special_tokens=False)[0].ids

    def _store(self, new: list[bytes], flat: np.ndarray, lens: np.ndarray):
        base, n = len(self.code), len(new)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while base + n > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.count[base : base + n] = lens
        self.start[base : base + n] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.code.update(zip(new, range(base, base + n), strict=True))

    def room(self):
        """If there are too many pieces, forget those that no later batch has asked for again, and of
        the others all but the newest half of the room. Codes got before are void then."""
        if len(self.code) <= CACHE_PIECES:
            return
        pieces = list(self.code)
        kept = np.flatnonzero(self.again[: len(pieces)])[-CACHE_PIECES // 2 :]
        flat, lens = self.expand(kept), self.count[kept]
        moved = np.full(len(pieces), -1)
        moved[kept] = np.arange(len(kept))
        keys, numbers = self.keys, moved[self.numbers]
        self._clear()
        self._store([pieces[k] for k in kept.tolist()], flat, lens)
        self.keys, self.numbers = keys[numbers >= 0], numbers[numbers >= 0]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and the position after each text's last piece.
        The numbers hold until ``room`` is called."""
        raw = [t.encode() for t in texts]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        blob = b"".join(raw)
        data = np.frombuffer(blob, np.uint8)
        starts = np.cumsum(lens) - lens
        first = cuts(data, starts[lens > 0])
        stop = np.append(first[1:], len(data))[: len(first)]
        byte, up, down = byte_tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        value = byte[data]
        value *= up[: len(data)]
        np.cumsum(value, out=sums[1:])
        key = (sums[stop] - sums[first]) * down[first]
        long = np.flatnonzero(stop - first > HASHED_BYTES)
        key[long] = long
        order = np.argsort(key)
        key = key[order]
        fresh = np.concatenate([np.ones(len(key[:1]), bool), key[1:] != key[:-1]])
        different, place = key[fresh], order[fresh]
        piece = np.empty(len(key), np.int64)
        piece[order] = np.cumsum(fresh) - 1
        hashed = (stop - first)[place] <= HASHED_BYTES
        known = np.where(hashed, self._known(different), -1)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            at = place[missing]
            new = [blob[a:b] for a, b in zip(first[at].tolist(), stop[at].tolist(), strict=True)]
            # long pieces have no hash, and other pieces that are known have theirs in ``keys``
            known[missing] = np.fromiter(map(self.code.get, new, repeat(-1)), np.int64, len(new))
        self.again[known[known >= 0]] = True
        if len(missing):
            unseen = np.flatnonzero(known[missing] < 0).tolist()
            if unseen:
                self._learn(list(dict.fromkeys([new[k] for k in unseen])))
                known[missing[unseen]] = [self.code[new[k]] for k in unseen]
            told = missing[hashed[missing]]
            at = np.searchsorted(self.keys, different[told])
            self.keys = np.insert(self.keys, at, different[told])
            self.numbers = np.insert(self.numbers, at, known[told])
        return known[piece], np.searchsorted(first, starts + lens)

    def expand(self, codes: np.ndarray) -> np.ndarray:
        lens = self.count[codes]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[codes] - (ends - lens), lens) + np.arange(total)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the position after each text's last id."""
        out, counts = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64)
        for owner, parts in batches(texts):
            self.room()
            codes, ends = self.codes(parts)
            out.append(self.expand(codes))
            sums = np.concatenate([[0], np.cumsum(self.count[codes])])[ends]
            np.add.at(counts, owner, np.diff(sums, prepend=0))
        return np.concatenate(out), np.cumsum(counts)


def batches(texts: list[str], size: int = BATCH_CHARS):
    """(numbers of texts, their segments) of about ``size`` characters at a time."""
    owner, parts, held = [], [], 0
    for k, text in enumerate(texts):
        for segment in segments(text):
            owner.append(k)
            parts.append(segment)
            held += len(segment)
            if held >= size:
                yield owner, parts
                owner, parts, held = [], [], 0
    if parts:
        yield owner, parts


_CACHE: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One per Python worker, kept between tasks."""
    if path not in _CACHE:
        _CACHE[path] = PieceTokenizer(path)
    return _CACHE[path]
