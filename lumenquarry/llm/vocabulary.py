"""A SentencePiece vocabulary as arrays, and pre-tokens of whole slices of texts.

A text is a blank followed by its bytes (the model's dummy prefix); blanks stand for the
model's meta symbol. Pre-tokens begin at each run of blanks. No piece of the vocabulary
reaches over such a border, which ``load`` checks, so pre-tokens can be segmented one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np

from .textops import U, hashes, powers, R, R_INVERSE, VALUE, mix

#: A parameter everywhere; the file isn't part of this repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = -1


@dataclass
class Vocabulary:
    pieces: list[bytes]  # b"" where an id stands for no text
    score: np.ndarray
    byte_base: int
    char_code: np.ndarray  # sorted codes of the pieces of one character
    char_id: np.ndarray
    pair_key: np.ndarray  # sorted left * size + right
    pair_id: np.ndarray
    pair_rank: np.ndarray  # 0 for what merges first
    piece_hash: np.ndarray  # sorted
    piece_id: np.ndarray
    seen: np.ndarray  # by the low bits of piece_hash
    tails: np.ndarray  # likewise of the hashes of all that pieces end with
    text: np.ndarray  # all pieces' bytes on end
    text_at: np.ndarray
    longest: int

    @property
    def size(self) -> int:
        return len(self.pieces)


def code_of(char: bytes) -> int:
    return int.from_bytes(char.ljust(4, b"\0"), "little")


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(Path(path)))
    n = sp.get_piece_size()
    pieces, byte_base = [], None
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_base = i if byte_base is None else byte_base
            pieces.append(bytes([i - byte_base]))
        else:
            pieces.append(b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else p.replace("▁", " ").encode())
    if byte_base is None:
        raise ValueError("the vocabulary has no bytes to fall back on")
    normal = {p: i for i, p in enumerate(pieces) if p and not byte_base <= i < byte_base + 256}
    if any(b" " in p.lstrip(b" ") for p in normal):
        raise ValueError("a piece reaches over the border of pre-tokens")
    score = np.array([sp.get_score(i) for i in range(n)], np.float64)
    ids = np.fromiter(normal.values(), np.int64)
    chars = sorted((code_of(p), i) for p, i in normal.items() if len(p.decode()) == 1)
    pairs = []
    for p, i in normal.items():
        s = p.decode()
        for k in range(1, len(s)):
            left, right = normal.get(s[:k].encode()), normal.get(s[k:].encode())
            if left is not None and right is not None:
                pairs.append((left * n + right, i))
    pairs.sort()
    key, merged = np.array(pairs, np.int64).reshape(-1, 2).T
    order = np.argsort(-score[ids], kind="stable")
    rank = np.zeros(n, np.int64)
    rank[ids[order]] = np.unique(-score[ids[order]], return_inverse=True)[1]
    data = np.frombuffer(b"".join(normal), np.uint8)
    end = np.cumsum([len(p) for p in normal])
    h = hashes(data, end - [len(p) for p in normal], end)
    by = np.argsort(h)
    if (np.diff(h[by]) == 0).any():
        raise ValueError("two pieces have one hash")
    seen = np.zeros(1 << 22, bool)
    seen[h & U((1 << 22) - 1)] = True
    tails = {p[k:] for p in normal for k in range(len(p)) if p[k] & 0xC0 != 0x80}
    ends = np.cumsum([len(p) for p in tails])
    tail = np.zeros(1 << 22, bool)
    tail[hashes(np.frombuffer(b"".join(tails), np.uint8), ends - [len(p) for p in tails], ends) & U((1 << 22) - 1)] = True
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    codes, char_ids = np.array(chars, np.int64).reshape(-1, 2).T
    return Vocabulary(pieces, score, byte_base, codes, char_ids, key, merged, rank[merged], h[by], ids[by], seen, tail, np.frombuffer(b"".join(pieces), np.uint8), at, max(len(p.decode()) for p in normal))


@dataclass
class PreTokens:
    """All pre-tokens of a slice of texts. Characters are counted over the whole slice."""

    data: np.ndarray
    row: np.ndarray  # of each pre-token
    place: np.ndarray  # in its text
    hash: np.ndarray
    first_char: np.ndarray  # of each pre-token, and the end
    char_at: np.ndarray  # byte at which a character begins, and the end


def split(data: np.ndarray, offsets: np.ndarray) -> PreTokens:
    size = np.diff(offsets)
    live = size > 0
    row_of = np.repeat(np.cumsum(live) - 1, size)
    out = np.full(data.size + int(live.sum()), 32, np.uint8)
    out[np.arange(data.size) + row_of + 1] = data
    begin = (offsets[:-1] + np.cumsum(live) - live)[live]
    blank = out == 32
    edge = blank.copy()
    edge[1:] &= ~blank[:-1]
    edge[begin] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], out.size)
    which = np.searchsorted(begin, start, "right") - 1
    place = np.arange(start.size) - np.searchsorted(start, begin)[which] if start.size else start
    char_at = np.flatnonzero((out & 0xC0) != 0x80)
    first = np.append(np.searchsorted(char_at, start), char_at.size)
    return PreTokens(out, np.flatnonzero(live)[which], place, hashes(out, start, end), first, np.append(char_at, out.size))


def whole(data: np.ndarray, offsets: np.ndarray) -> PreTokens:
    """Pre-tokens that are given one by one, none of them empty."""
    char_at = np.flatnonzero((data & 0xC0) != 0x80)
    n = np.arange(offsets.size - 1)
    return PreTokens(data, n, np.zeros_like(n), hashes(data, offsets[:-1], offsets[1:]), np.append(np.searchsorted(char_at, offsets[:-1]), char_at.size), np.append(char_at, data.size))


def char_codes(t: PreTokens) -> np.ndarray:
    at, n = t.char_at[:-1], np.diff(t.char_at)
    padded = np.append(t.data, np.zeros(4, np.uint8)).astype(np.int64)
    code = padded[at].copy()
    for k in (1, 2, 3):
        more = n > k
        code[more] |= padded[at[more] + k] << (8 * k)
    return code


def look_up(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where it isn't."""
    i = np.searchsorted(sorted_keys, keys)
    i[i == sorted_keys.size] = 0
    return np.where(sorted_keys[i] == keys, i, -1)


def char_symbols(v: Vocabulary, t: PreTokens) -> np.ndarray:
    """The id of each character, UNKNOWN where the vocabulary has it only as bytes."""
    i = look_up(char_codes(t), v.char_code)
    return np.where(i < 0, UNKNOWN, v.char_id[i])


class Spans:
    """Hashes of any spans of one buffer."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(data.size + 1, U)
        np.cumsum(VALUE[data] * powers(R, data.size), out=self.total[1:])
        self.back = powers(R_INVERSE, data.size + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(U))


def pieces_of(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """The id of the piece with each hash, -1 if there is none."""
    out = np.full(h.size, -1, np.int64)
    able = np.flatnonzero(v.seen[h & U(v.seen.size - 1)])
    i = look_up(h[able], v.piece_hash)
    out[able[i >= 0]] = v.piece_id[i[i >= 0]]
    return out
