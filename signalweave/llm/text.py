"""Words and shingles of Arrow text columns, by whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What separates words in the contracts that say so: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def filled(text: pa.Array) -> pa.Array:
    return pc.fill_null(text, "") if text.null_count else text


def words_of(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of all rows in one array, and where each row's words start and end in it. Lowers A-Z only."""
    text = filled(text)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype("i8")
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        flat = flat.filter(pa.array(real))
    return flat, bounds


def coded(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different words and each word's place among them."""
    d = words.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


#: What XXH3 mixes into up to three and up to eight bytes, and its multipliers.
_KEYS = np.uint64(0x87275A9B), np.uint64(0xC73AB174C5ECD5A2)
_FACTORS = np.uint64(0x165667B19E3779F9), np.uint64(0x9FB21C651E98DF25)


def short_hashes(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The XXH3 hashes of strings of one to eight bytes, which key holds from its lowest byte on."""
    u, n = np.uint64, size.astype("u8")
    tiny = key & u(0xFF)
    tiny = tiny << u(16) | (key >> (u(8) * (n >> u(1))) & u(0xFF)) << u(24) | (key >> (u(8) * (n - u(1))) & u(0xFF)) | n << u(8)
    tiny ^= _KEYS[0]
    tiny = (tiny ^ (tiny >> u(33))) * _B
    tiny = (tiny ^ (tiny >> u(29))) * _FACTORS[0]
    h = ((key >> (u(8) * (np.maximum(n, u(4)) - u(4)))) & u(0xFFFFFFFF)) + (key << u(32))
    h ^= _KEYS[1]
    h ^= (h << u(49) | h >> u(15)) ^ (h << u(24) | h >> u(40))
    h *= _FACTORS[1]
    h = (h ^ ((h >> u(35)) + n)) * _FACTORS[1]
    return np.where(n < u(4), tiny ^ (tiny >> u(32)), h ^ (h >> u(28)))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit XXH3 hash of each word. Words of up to eight bytes are hashed as numbers, all at once; of longer ones that are equal only one is."""
    offsets = np.frombuffer(words.buffers()[1], "i4", len(words) + 1, words.offset * 4) if len(words) else np.zeros(1, "i4")
    data = np.frombuffer((words.buffers()[2] if len(words) else None) or b"", "u1")
    size = np.diff(offsets)
    short = (size > 0) & (size <= 8) & (offsets[:-1] <= len(data) - 8)  # eight bytes must stand from its start on
    out = np.empty(len(words), "u8")
    at = np.flatnonzero(short)
    for i in range(0, len(at), 1 << 14):
        some = at[i : i + (1 << 14)]
        key = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))[offsets[some]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - size[some])).astype("u8"))
        out[some] = short_hashes(key, size[some])
    if len(at) < len(words):
        d = words.filter(pa.array(~short)).dictionary_encode()
        found = np.fromiter(map(xxhash.xxh3_64_intdigest, d.dictionary.cast(pa.binary()).to_pylist()), "u8", len(d.dictionary))
        out[~short] = found[d.indices.to_numpy(zero_copy_only=False)]
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """For each start the hash of k words in a row, also across rows; empty if there are fewer than k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, "u8")
    out = np.full(n, k, "u8")
    for j in range(k):
        out = mixed((out ^ hashes[j : j + n]) * _A)
    return out


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted set of k-word shingles; with 1 to k - 1 words, the whole sequence as one; without words, empty."""
    windows, out = window_hashes(hashes, k), []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= k:
            h = np.sort(windows[s : e - k + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif e > s:
            out.append(window_hashes(hashes[s:e], e - s))
        else:
            out.append(np.zeros(0, "u8"))
    return out
