"""SHA-256 whose state can be kept, sent and resumed, for many messages at once.

``hashlib`` copies a state within a process but can't write one down. A
digest as hexadecimal text is one 64-byte block, so the state before a
child slot is the chaining value after the children before it: eight
words. Arrays are laid out as (words, lanes), one lane a message.
"""

from __future__ import annotations

import numpy as np

# The standard's initial state and round constants come from square and cube roots of primes.


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root(value: int, power: int) -> int:
    """The integer part of the root of ``value``."""
    low, high = 0, 1 << (value.bit_length() // power + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= value else (low, middle - 1)
    return low


START = np.array([_root(p << 64, 2) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_root(p << 96, 3) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
#: The hexadecimal text of two bytes as one big-endian word.
HEX_PAIR = np.array([int.from_bytes(b"%04x" % i, "big") for i in range(1 << 16)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The state (8, n) after one more block (16, n)."""
    w = np.empty((64, state.shape[1]), np.uint32)
    w[:16] = block
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w[t] = w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
    w += ROUND[:, None]
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def fresh(lanes: int) -> np.ndarray:
    """The state before any input."""
    return np.repeat(START[:, None], lanes, axis=1)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The block (16, n) that the hexadecimal text of each digest (8, n) fills."""
    block = np.empty((16, digest.shape[1]), np.uint32)
    block[0::2] = HEX_PAIR[digest >> np.uint32(16)]
    block[1::2] = HEX_PAIR[digest & np.uint32(0xFFFF)]
    return block


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digest (8, n) of messages of so many (n) whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 1 << 31
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[14], last[15] = (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return compress(state, last)


def from_bytes(raw: bytes) -> np.ndarray:
    """Digests or states of 32 bytes each, one after the other, as (8, n)."""
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32))


def to_bytes(words: np.ndarray) -> bytes:
    return words.T.astype(">u4").tobytes()


def to_hex(words: np.ndarray) -> list[str]:
    raw = to_bytes(words).hex()
    return [raw[i : i + 64] for i in range(0, len(raw), 64)]
