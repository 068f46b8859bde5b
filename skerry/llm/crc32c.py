"""CRC-32C of many byte strings at once, with numpy tables (Castagnoli polynomial, reflected)."""

from __future__ import annotations

import numpy as np

_POLY, _BLOCK = 0x82F63B78, 512


def _tables() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    out = [t]
    for _ in range(7):
        out.append((out[-1] >> 8) ^ t[out[-1] & 255])
    return np.stack(out)


_T = _tables()


def _eight(state: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The state after eight more bytes, given as two little-endian words."""
    x = low ^ state
    return (
        _T[7][x & 255] ^ _T[6][(x >> 8) & 255] ^ _T[5][(x >> 16) & 255] ^ _T[4][x >> 24]
        ^ _T[3][high & 255] ^ _T[2][(high >> 8) & 255] ^ _T[1][(high >> 16) & 255] ^ _T[0][high >> 24]
    )


def _after_block() -> np.ndarray:
    """What a block of zero bytes makes of each byte of a state."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    zero = np.zeros_like(state)
    for _ in range(_BLOCK // 8):
        state = _eight(state, zero, zero)
    return state.reshape(4, 256)


_S = _after_block()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32C of each byte string."""
    if not parts:
        return np.zeros(0, np.uint32)
    size = np.array([len(p) for p in parts], dtype=np.int64)
    block = 8 if size.max() <= 8 else _BLOCK
    blocks = np.maximum(1, -(-size // block))
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * block, dtype=np.uint8)
    for p, n, end in zip(parts, size.tolist(), (ends * block).tolist(), strict=True):
        if n >= 4:
            flat[end - n : end] = np.frombuffer(p, np.uint8)
            flat[end - n : end - n + 4] ^= 255  # the initial state, moved into the data
    words = np.ascontiguousarray(flat.view("<u4").reshape(-1, block // 4).T)
    state = np.zeros(words.shape[1], dtype=np.uint32)
    for j in range(0, block // 4, 2):
        state = _eight(state, words[j], words[j + 1])
    first = ends - blocks
    out = state[first]
    for j in range(1, int(blocks.max())):
        own = np.flatnonzero(blocks > j)
        x = out[own]
        out[own] = _S[0][x & 255] ^ _S[1][(x >> 8) & 255] ^ _S[2][(x >> 16) & 255] ^ _S[3][x >> 24] ^ state[first[own] + j]
    out = ~out
    for i in np.flatnonzero(size < 4):
        x = 0xFFFFFFFF
        for b in parts[i]:
            x = (x >> 8) ^ int(_T[0][(x ^ b) & 255])
        out[i] = x ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """The mask of length-delimited record files: rotate by 15 and add a constant."""
    return ((crc >> 15) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
