"""XXH64 of many byte ranges at once, in numpy."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def lane(acc: np.ndarray, k: np.ndarray) -> np.ndarray:
    return rotl(acc + k * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hashes of data[start:end] for each pair; data must go on for 8 bytes after the last end."""
    data = np.ascontiguousarray(data)
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    halves = np.ndarray((max(0, len(data) - 3),), "<u4", data, strides=(1,))
    seed64 = np.uint64(seed)
    size, at = (end - start).astype(np.int64), start.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        acc = np.full(len(at), seed64 + P5, np.uint64)
        big = np.flatnonzero(size >= 32)
        if len(big):
            lanes = [np.full(len(big), x, np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            left, pos = size[big] // 32, at[big]
            order = np.argsort(-left, kind="stable")
            back, left, pos = big[order], left[order], pos[order]
            n = len(left)
            for turn in range(int(left[0])):
                n = int(np.searchsorted(-left[:n], -turn, "left"))  # those with a stripe left
                for k in range(4):
                    lanes[k][:n] = lane(lanes[k][:n], words[pos[:n] + 8 * k])
                pos[:n] += 32
            total = rotl(lanes[0], 1) + rotl(lanes[1], 7) + rotl(lanes[2], 12) + rotl(lanes[3], 18)
            for x in lanes:
                total = (total ^ lane(np.zeros_like(x), x)) * P1 + P4
            acc[back], at[back] = total, pos
        acc += size.astype(np.uint64)
        rest = end - at
        for k in range(3):
            use = np.flatnonzero(rest >= 8)
            if not len(use):
                break
            acc[use] = rotl(acc[use] ^ lane(np.uint64(0), words[at[use]]), 27) * P1 + P4
            at[use] += 8
            rest[use] -= 8
        use = np.flatnonzero(rest >= 4)
        acc[use] = rotl(acc[use] ^ (halves[at[use]].astype(np.uint64) * P1), 23) * P2 + P3
        at[use] += 4
        rest[use] -= 4
        for k in range(3):
            use = np.flatnonzero(rest > 0)
            if not len(use):
                break
            acc[use] = rotl(acc[use] ^ (data[at[use]].astype(np.uint64) * P5), 11) * P1
            at[use] += 1
            rest[use] -= 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        return acc ^ (acc >> np.uint64(32))
