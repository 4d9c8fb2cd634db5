"""Search of the window of a text that is most similar to one of many phrases.

Three bounds of growing sharpness leave few windows for the exact ratio: letters in common (one matrix product per phrase length,
over all phrases and starts), the longest common subsequence (bit-parallel, over all surviving starts and window lengths at once),
then the ratio itself, highest bound first, until no open bound reaches the best ratio.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

ENOUGH = 0.98
BLOCK = 8192
#: Phrases longer than a machine word have no subsequence bound.
WORD = 63

Hit = tuple[float, int, int, int]


class PhraseSearch:
    """Windows of ``size - 3`` (at least 3) to ``size + 4`` characters for every phrase."""

    def __init__(self, phrases: tuple[str, ...]):
        self.phrases = phrases
        letters = sorted({c for p in phrases for c in p})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.size = np.array([len(p) for p in phrases], dtype=np.int64)
        pairs = [(self.code[c], k) for c in letters for k in range(1, max(p.count(c) for p in phrases) + 1)]
        self.letter, self.times = (np.array([x[i] for x in pairs], dtype=np.int32) for i in (0, 1))
        self.wants = np.array([[p.count(letters[a - 1]) >= k for a, k in pairs] for p in phrases], dtype=np.float32)
        self.mask = np.zeros((len(phrases), len(letters) + 1), dtype=np.uint64)
        for i, p in enumerate(phrases):
            for j, c in enumerate(p[:WORD]):
                self.mask[i, self.code[c]] |= np.uint64(1 << j)
        self.low = np.array([(1 << min(len(p), WORD)) - 1 for p in phrases], dtype=np.uint64)

    def best(self, body: str, least: float) -> Hit | None:
        """(ratio, phrase, start, end) of the most similar window, at least ``least``. Ties go to the earliest phrase, then the
        shortest window, then the first one; among windows of ``ENOUGH`` or more that order alone counts. A phrase that the text
        contains counts where it stands first."""
        there = {i: body.find(p) for i, p in enumerate(self.phrases)}
        done: list[tuple[float, int, int, int]] = [(1.0, i, len(self.phrases[i]), at) for i, at in there.items() if at >= 0]
        codes = np.fromiter((self.code.get(c, 0) for c in body), np.int32, len(body))
        found = [self._block(codes, at, min(at + BLOCK, len(body)), least, there) for at in range(0, len(body), BLOCK)]
        bound, phrase, length, start = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4))
        top = max((d[0] for d in done), default=0.0)
        ratios: dict[tuple[int, str], float] = {}
        matchers: dict[int, SequenceMatcher] = {}
        for k in np.lexsort((start, length, phrase, -bound)):
            if bound[k] < min(max(top, least), ENOUGH):
                break
            i, n, at = int(phrase[k]), int(length[k]), int(start[k])
            window = body[at : at + n]
            if (i, window) not in ratios:
                m = matchers.setdefault(i, SequenceMatcher(None, self.phrases[i], autojunk=False))
                m.set_seq2(window)
                ratios[i, window] = m.ratio()
            if (score := ratios[i, window]) >= least and score > 0:
                done.append((score, i, n, at))
                top = max(top, score)
        if not done:
            return None
        sure = [d for d in done if d[0] >= ENOUGH]
        score, i, n, at = min(sure, key=lambda d: d[1:]) if sure else min(done, key=lambda d: (-d[0], *d[1:]))
        return score, i, at, at + n

    def _block(self, codes: np.ndarray, begin: int, end: int, least: float, there: dict[int, int]) -> tuple[np.ndarray, ...]:
        """Bounds of the windows that start in [begin, end): (bound, phrase, length, start) of those whose bounds reach ``least``."""
        total, starts = len(codes), np.arange(begin, end)
        open_ = np.array([there[i] < 0 and n > 0 for i, n in enumerate(self.size)])
        longest = int(self.size.max(initial=0)) + 4
        part = codes[begin : min(end + longest, total)]
        running = np.zeros((self.mask.shape[1], len(part) + 1), dtype=np.int32)
        for c in range(1, self.mask.shape[1]):
            np.cumsum(part == c, out=running[c, 1:])
        phrases, places = [], []
        for size in np.unique(self.size[open_]):
            own = np.flatnonzero(open_ & (self.size == size))
            use = np.flatnonzero(self.wants[own].any(axis=0))
            ends = np.minimum(starts + size + 4, total) - begin
            held = running[self.letter[use]][:, ends] - running[self.letter[use]][:, starts - begin]
            common = self.wants[np.ix_(own, use)] @ (held >= self.times[use][:, None]).astype(np.float32)
            at = np.nonzero(common >= least * (size + max(3, size - 3)) / 2 - 1e-3)
            phrases.append(own[at[0]])
            places.append(starts[at[1]])
        phrase, place = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (phrases, places))
        size, rest = self.size[phrase], np.full(len(phrase), 2**64 - 1, dtype=np.uint64)
        out: list[tuple[np.ndarray, ...]] = []
        for n in range(1, int(size.max(initial=0)) + 5):
            seen = place + n <= total
            match = rest & self.mask[phrase, np.where(seen, codes[np.minimum(place + n - 1, total - 1)], 0)]
            rest = (rest + match) | (rest - match)
            fits = np.flatnonzero(seen & (n >= np.maximum(3, size - 3)) & (n <= size + 4))
            same = np.where(size[fits] > WORD, np.minimum(size[fits], n), np.minimum(size[fits], WORD) - np.bitwise_count(rest[fits] & self.low[phrase[fits]]))
            bound = 2.0 * same / (size[fits] + n)
            keep = (bound >= least - 1e-9) & (bound > 0)
            out.append((bound[keep], phrase[fits][keep], np.full(int(keep.sum()), n), place[fits][keep]))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(4))


@lru_cache(maxsize=8)
def phrase_search(phrases: tuple[str, ...]) -> PhraseSearch:
    return PhraseSearch(phrases)
