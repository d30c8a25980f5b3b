"""Seeded draws equal to Python's own generator, for many seeds at once: one column of state for each seed, all arithmetic on whole rows."""

from __future__ import annotations

import numpy as np

#: Words of state and distance of the twist, and the constants of seeding, twist and tempering of MT19937 (fixed values).
WORDS, AHEAD = 624, 397
START, GROW, FIRST_MIX, SECOND_MIX = 19650218, 1812433253, 1664525, 1566083941
TWIST, UPPER, LOWER = 0x9908B0DF, 0x80000000, 0x7FFFFFFF
TEMPER = ((7, 0x9D2C5680), (15, 0xEFC60000))

_U = np.uint32


def _spread(word: np.ndarray, factor: int) -> np.ndarray:
    return (word ^ (word >> _U(30))) * _U(factor)


class Draws:
    """The generators of random.Random(seed) for an array of 64-bit seeds; each method draws once from every one of them.

    A draw that a seed rejects is repeated for that seed alone, so seeds move on at their own pace, as they would one by one."""

    def __init__(self, seeds: np.ndarray):
        size = np.abs(np.asarray(seeds, np.int64)).astype(np.uint64)  # the least long's size wraps to itself, which is right as an unsigned one
        key = np.stack([size & np.uint64(0xFFFFFFFF), size >> np.uint64(32)]).astype(_U)
        two = key[1] > 0
        one = np.zeros(WORDS, _U)
        with np.errstate(over="ignore"):
            one[0] = START
            for i in range(1, WORDS):
                one[i] = _spread(one[i - 1 : i], GROW)[0] + _U(i)
            state = np.repeat(one[:, None], size.size, axis=1)
            at = 1
            for step in range(WORDS):
                odd = two & (step % 2 == 1)
                state[at] = (state[at] ^ _spread(state[at - 1], FIRST_MIX)) + np.where(odd, key[1] + _U(1), key[0])
                at = self._wrapped(state, at)
            for _ in range(WORDS - 1):
                state[at] = (state[at] ^ _spread(state[at - 1], SECOND_MIX)) - _U(at)
                at = self._wrapped(state, at)
        state[0] = UPPER
        self.state, self.told, self.at = state, np.zeros((0, size.size), _U), np.zeros(size.size, np.int64)

    @staticmethod
    def _wrapped(state: np.ndarray, at: int) -> int:
        if at + 1 < WORDS:
            return at + 1
        state[0] = state[WORDS - 1]
        return 1

    def _more(self) -> None:
        """Another 624 words of every seed."""
        old, new = self.state, np.empty_like(self.state)
        twisted = lambda a, b: (y := (a & _U(UPPER)) | (b & _U(LOWER))) >> _U(1) ^ (y & _U(1)) * _U(TWIST)
        early, last = WORDS - AHEAD, WORDS - 1
        new[:early] = old[AHEAD:] ^ twisted(old[:early], old[1 : early + 1])
        new[early : 2 * early] = new[:early] ^ twisted(old[early : 2 * early], old[early + 1 : 2 * early + 1])
        new[2 * early : last] = new[early : last - early] ^ twisted(old[2 * early : last], old[2 * early + 1 :])
        new[last] = new[last - early] ^ twisted(old[last], new[0])
        self.state = new
        y = new ^ new >> _U(11)
        for shift, mask in TEMPER:
            y = y ^ (y << _U(shift) & _U(mask))
        self.told = np.concatenate([self.told, y ^ y >> _U(18)])

    def _words(self, who: np.ndarray) -> np.ndarray:
        while who.size and self.at[who].max() >= len(self.told):
            self._more()
        out = self.told[self.at[who], who]
        self.at[who] += 1
        return out

    def bits(self, k: int, who: np.ndarray) -> np.ndarray:
        """k bits (at most 32) of the seeds at the places `who`."""
        return (self._words(who) >> _U(32 - k)).astype(np.int64)

    def below(self, n: int, who: np.ndarray | None = None) -> np.ndarray:
        """A number from 0 to n - 1, of every seed or of those at the places `who`."""
        who = np.arange(self.at.size) if who is None else who
        out, open_ = np.empty(who.size, np.int64), np.arange(who.size)
        while open_.size:
            out[open_] = self.bits(n.bit_length(), who[open_])
            open_ = open_[out[open_] >= n]
        return out

    def between(self, low: int, high: int) -> np.ndarray:
        """A number from low to high, both included."""
        return low + self.below(high - low + 1)

    def uniform(self, low: float, high: float) -> np.ndarray:
        """A double from low to high, of 53 bits."""
        every = np.arange(self.at.size)
        a, b = self._words(every) >> _U(5), self._words(every) >> _U(6)
        return low + (high - low) * ((a.astype(np.float64) * (1 << 26) + b) / (1 << 53))

    def texts(self, alphabet: str, length: int, who: np.ndarray | None = None) -> np.ndarray:
        """A text of characters of the alphabet."""
        letters = np.array(list(alphabet))
        drawn = [self.below(len(alphabet), who) for _ in range(length)]
        return letters[np.stack(drawn, axis=1)].view(f"<U{length}").ravel().astype(object)  # a row's characters stand side by side: they are its text
