"""Coins of the paired randomisation: md5 of many short messages at once."""

from __future__ import annotations

from hashlib import md5

import numpy as np

#: coins drawn from one md5: its first 15 hex digits
COIN_BITS = 60
#: messages that are hashed at once
MESSAGES = 1 << 13

_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).astype(np.uint32)
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_BEGUN = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _digests(block: np.ndarray) -> np.ndarray:
    """The first two words of the md5 of messages of one block each, ``block``: their 16 words, a column a message."""
    a, b, c, d = (np.full(block.shape[1], x) for x in _BEGUN)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            word = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            word = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            word = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            word = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _ADDED[i]
        f += block[word]
        np.right_shift(f, np.uint32(32) - _TURNS[i], out=t)
        f <<= _TURNS[i]
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([a + _BEGUN[0], b + _BEGUN[1]], axis=1)


def coin_words(segments, blocks: int, seed: int) -> np.ndarray:
    """``coin_word`` of every segment (a row) and block of trials (a column), as 64-bit numbers."""
    names = [str(k).encode() for k in range(blocks)]
    wide = max(map(len, names), default=1)
    ends = np.zeros((blocks, wide + 1), np.uint8)  # the block's number and md5's closing bit
    for k, x in enumerate(names):
        ends[k, :len(x) + 1] = np.frombuffer(x + b"\x80", np.uint8)
    begins = [f"{seed}-{s}-".encode() for s in segments]
    out = np.empty((len(begins), blocks), np.uint64)
    size = np.array([len(x) for x in begins], np.int64)
    for length in np.unique(size).tolist():
        same = np.flatnonzero(size == length)
        if length + wide > 55:  # more than one block
            for i in same.tolist():
                begun = md5(begins[i])
                for k, x in enumerate(names):
                    whole = begun.copy()
                    whole.update(x)
                    out[i, k] = int.from_bytes(whole.digest()[:8], "big") >> 4
            continue
        bits = np.array([8 * (length + len(x)) for x in names], "<u2")
        most = max(1, MESSAGES // blocks)
        for some in (same[i:i + most] for i in range(0, len(same), most)):
            text = np.zeros((len(some), blocks, 64), np.uint8)
            text[:, :, :length] = np.frombuffer(b"".join(begins[i] for i in some.tolist()), np.uint8).reshape(len(some), 1, length)
            text[:, :, length:length + wide + 1] = ends
            text[:, :, 56:58] = bits.view(np.uint8).reshape(blocks, 2)
            words = np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T).astype(np.uint32, copy=False)
            first = np.ascontiguousarray(_digests(words).astype("<u4", copy=False)).view(np.uint8).reshape(-1, 8)
            out[some] = (first.view(">u8").astype(np.uint64) >> np.uint64(4)).reshape(len(some), blocks)
    return out


def coins(segments, trials: int, seed: int) -> np.ndarray:
    """A row per segment, a coin per trial: the bits of its words from the lowest."""
    words = coin_words(segments, -(-trials // COIN_BITS), seed).astype("<u8", copy=False)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1, 8), axis=2, bitorder="little")[:, :, :COIN_BITS]
    return bits.reshape(len(words), -1)[:, :trials]
