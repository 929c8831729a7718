"""Exact, cached encoding with a public tokenizer file of the tokenizers library, vectorised.

word_bpe_49k.json lower-cases, splits a text into pieces (letters, one digit, other marks) and merges
inside a piece alone, so a text's ids are the ids of its pieces in a row. A batch of texts is cut
into pieces in numpy over code points; pieces are named by two 64-bit hashes; new ones go through the
tokenizer's model in one call and are kept. Whatever could behave otherwise (special tokens in the
text, separators that Python and the tokenizer class differently, characters whose case or
composition depends on their neighbours, very long pieces) goes through the tokenizer as a whole text.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np

from .hashing import Powers, ragged, splitmix

_U64 = np.uint64
#: Pieces kept for a worker, about 50 bytes each; beyond them the cache starts anew.
MAX_PIECES = 600_000
MAX_PIECE_CHARS = 500
END_ID = 2

_SPACE, _LETTER, _NUMBER, _OTHER, _BEYOND = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case, class) of each code point below 0x2100; what is not plain is _BEYOND."""
    import unicodedata

    lower, kind = np.arange(0x2101, dtype=np.uint32), np.full(0x2101, _BEYOND, np.uint8)
    plain = [c for c in range(0x2100) if c < 0x250 or 0x2010 <= c <= 0x2027 or 0x2030 <= c <= 0x205E or 0x20A0 <= c <= 0x20BF]
    plain = {c for c in plain if not (0x1C <= c <= 0x1F or c == 0x85) and unicodedata.normalize("NFC", chr(c)) == chr(c)}
    for c in plain:
        x = chr(c)
        if len(x.lower()) > 1 or ord(x.lower()) not in plain:  # a lower case outside the table, as that of U+023A
            continue
        lower[c] = ord(x.lower())
        major = unicodedata.category(x)[0]
        kind[c] = _SPACE if x.isspace() else _LETTER if major == "L" else _NUMBER if major == "N" else _OTHER
    return lower, kind


def _byte_symbols() -> dict[int, int]:
    """Byte-level BPE's rule: visible Latin-1 stands for itself, other bytes for code points from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden) if b != 32}


class PieceEncoder:
    """texts -> ids, equal to Tokenizer.encode(add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"]
        self.ends = np.zeros(max([*vocab.values(), *(t["id"] for t in whole["added_tokens"])]) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = sorted(t["content"] for t in whole["added_tokens"])
        # The model alone: pieces come lowered, composed and split by blanks, as byte symbols.
        bare = whole | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(bare))
        self.lower, self.kind = _tables()
        self.symbols = _byte_symbols()
        self.powers = [Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)]
        self._forget()

    def _forget(self) -> None:
        self.names, self.checks = np.zeros(0, _U64), np.zeros(0, _U64)
        self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    @cached_property
    def tokenizer(self):
        """The whole tokenizer, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _pieces(self, codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces of lower-cased code points; texts are parted by blanks."""
        n = len(codes)
        inside = kind != _SPACE
        first = inside & (kind != np.concatenate([[_SPACE], kind[:-1]]).astype(np.uint8))
        first |= kind == _NUMBER
        # 's 't 'm 'd 're 've 'll, where the apostrophe begins a piece
        quotes = np.flatnonzero((codes == 39) & first)
        if len(quotes):
            padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            hit, size = quotes[short | long], np.where(short, 2, 3)[short | long]
            first[hit + 1] = False
            after = hit + size
            after = after[after < n]
            first[after] = inside[after]
        starts = np.flatnonzero(first)
        last = inside & ~np.concatenate([inside[1:], [False]])
        last[starts[starts > 0] - 1] |= inside[starts[starts > 0] - 1]
        return starts, np.flatnonzero(last) + 1

    def _learn(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of pieces."""
        ids, sizes = [], []
        for x in range(0, len(starts), 256):
            lo, hi = starts[x : x + 256], ends[x : x + 256]
            # Each piece and the blank after it (or a stand-in at the end).
            take = ragged(lo, hi - lo + 1)
            line = np.where(take < len(codes), codes[np.minimum(take, len(codes) - 1)], 32)
            line[np.cumsum(hi - lo + 1) - 1] = 32
            text = line.astype("<u4").tobytes().decode("utf-32-le")
            text = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.symbols)
            got = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(lo):
                raise ValueError("the tokenizer does not end pieces as expected")
            ids.append(got)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all texts, number of ids in each), or None if some text is not plain."""
        codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        small = np.minimum(codes, 0x2100)
        if (self.kind[small] == _BEYOND).any():
            return None
        codes = self.lower[small]
        kind = self.kind[codes]
        starts, ends = self._pieces(codes, kind)
        lengths = ends - starts
        text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        piece_at = np.searchsorted(starts, text_at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if lengths.max() > MAX_PIECE_CHARS:
            return None
        both = []
        for powers in self.powers:
            sums = np.cumsum((codes + np.uint32(1)).astype(_U64) * powers.up(len(codes)), dtype=_U64)
            before = np.where(starts > 0, sums[starts - 1], _U64(0))
            both.append(splitmix((sums[ends - 1] - before) * powers.down(len(codes))[starts] + lengths.astype(_U64)))
        names, first, which = np.unique(both[0], return_index=True, return_inverse=True)
        checks = both[1][first]
        if (checks[which] != both[1]).any():
            return None
        if len(self.names) + len(names) > MAX_PIECES:
            self._forget()
        spot = np.searchsorted(self.names, names)
        inside = np.minimum(spot, max(0, len(self.names) - 1))
        known = self.names[inside] == names if len(self.names) else np.zeros(len(names), bool)
        if known.any() and (self.checks[inside[known]] != checks[known]).any():
            return None
        if not known.all():
            new = ~known
            ids, sizes = self._learn(codes, starts[first[new]], ends[first[new]])
            self.at = np.insert(self.at, spot[new], (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32))
            self.size = np.insert(self.size, spot[new], sizes.astype(np.int32))
            self.checks = np.insert(self.checks, spot[new], checks[new])
            self.names = np.insert(self.names, spot[new], names[new])
            self.pool = np.concatenate([self.pool, ids])
            inside = np.searchsorted(self.names, names)
        slot = inside[which]
        sizes = self.size[slot].astype(np.int64)
        ids = self.pool[ragged(self.at[slot], sizes)]
        ends_at = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends_at[piece_at])

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with end_id after them."""
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        odd = [any(s in t for s in self.special) for t in texts]
        out: list = [None] * len(texts)
        todo = [i for i, o in enumerate(odd) if not o]
        found = self._plain([texts[i] for i in todo])
        if found is None:  # keep out the texts that are not plain
            plain = []
            for i in todo:
                codes = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4")
                if not (self.kind[np.minimum(codes, 0x2100)] == _BEYOND).any() and not any(len(w) > MAX_PIECE_CHARS for w in texts[i].split()):
                    plain.append(i)
            todo = plain
            found = self._plain([texts[i] for i in todo])
            if found is None:  # two pieces with one hash
                todo, found = [], (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ids, sizes = found
        ends = np.cumsum(sizes)
        for i, lo, hi in zip(todo, (ends - sizes).tolist(), ends.tolist(), strict=True):
            out[i] = np.concatenate([ids[lo:hi], tail])
        return [np.concatenate([self.whole(t), tail]) if x is None else x for t, x in zip(texts, out, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(path)
