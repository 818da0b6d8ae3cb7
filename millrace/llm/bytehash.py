"""Hashes of byte ranges and of runs of words, over a whole batch of texts at once."""

from __future__ import annotations

import re

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_GAP = re.compile(rb"[ \t-\r]")
#: Bytes that are hashed together; the arrays that this takes have some 60 bytes for each.
PIECE = 2**19

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(raw: np.ndarray) -> np.ndarray:
    """Running sums of (byte + 1) * base**i, one more than there are bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=out[1:])
    return out


def ranges(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of raw[lo:hi] that doesn't depend on where it stands."""
    inverse = powers(_INVERSE, len(total))
    return mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, in one go, and where each text's end."""
    raw = _LOWER[np.frombuffer(b"\n".join([*raws, b""]), np.uint8)]
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    return ranges(sums(raw), start, end), np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))


def _long_word(raw: bytes) -> np.ndarray:
    """The hash of one word as `ranges` gives it, added up from its pieces."""
    total = len(raw)
    for lo in range(0, len(raw), PIECE):
        part = _LOWER[np.frombuffer(raw[lo : lo + PIECE], np.uint8)]
        total += int(sums(part)[-1]) * pow(_BASE, lo, 2**64)
    return mix(np.array([total % 2**64], np.uint64))


def _long_text(raw: bytes) -> np.ndarray:
    """Hashes of the words of one text, in pieces that end before white space."""
    found, at = [], 0
    while at < len(raw):
        gap = _GAP.search(raw, min(len(raw), at + PIECE))
        end = gap.start() if gap else len(raw)
        if end - at > 2 * PIECE:
            near = raw[at : at + PIECE]
            word = at + 1 + max(near.rfind(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            found += [_words([raw[at:word]])[0], _long_word(raw[word:end])]
        else:
            found.append(_words([raw[at:end]])[0])
        at = end
    return np.concatenate(found)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lowered) and where each text's begin.

    About PIECE bytes are hashed at a time, so that neither many long texts nor one take much memory.
    """
    found, first, n = [], [np.zeros(1, np.int64)], 0
    group: list[bytes] = []
    size = 0

    def add(words: np.ndarray, ends: np.ndarray) -> None:
        nonlocal n
        found.append(words), first.append(n + ends)
        n += len(words)

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        if group and size + len(raw) >= PIECE:
            add(*_words(group))
            group, size = [], 0
        if len(raw) >= PIECE:
            words = _long_text(raw)
            add(words, np.array([len(words)]))
        else:
            group.append(raw)
            size += len(raw) + 1
    if group:
        add(*_words(group))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(first)


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; of fewer words, of all."""
    n = len(words)
    runs = max(0, n - width + 1)
    run = np.zeros(runs, np.uint64)
    for k in range(width):
        run = run * np.uint64(_BASE) + words[k : k + runs]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in words[a:b]:
                    h = h * np.uint64(_BASE) + x
                out.append(mix(np.array([h ^ np.uint64((b - a) * 0x51ED27)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
