"""Brute-force versions that several test modules use."""

import hashlib
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().lower().split()


def brute_repeats(texts, length):
    """n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def brute_first(texts, length):
    """What is left of each distinct text if strings go that start earlier too, in it or in a text of a lesser MD5."""
    seen, left = set(), {}
    for t in sorted(set(texts), key=lambda t: hashlib.md5(t).digest()):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(t[i : i + length])
        left[t] = bytes(np.frombuffer(t, np.uint8)[~gone])
    return left


def brute_simhash(text, width=3):
    w = words(text)
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
