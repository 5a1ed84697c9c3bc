"""Consistent weighted sampling: for a term and a sample number the variables r, c ~ Gamma(2, 1) and b ~ Uniform are
drawn from a hash alone. For weight w: t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)); the sample is the
term (with its t) of the smallest a. Two weighted sets agree in a sample with probability equal to their generalised
Jaccard similarity. The smallest a itself names (term, t), so signatures are made of its bits.

The draws: with e, f, g, h exponential, r = e + f is Gamma(2, 1) and e / r is uniform and independent of it, so it
serves as 1 - b; c = g + h. For weight 1 then t = 0 and a = c exp(-e), which needs one uniform and one logarithm.
"""

from __future__ import annotations

import numpy as np

from emberline.llm.word_hashes import mix64

U32 = np.uint32


def sample_keys(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    k = mix64(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return k[:samples].astype(U32), k[samples:].astype(U32)


class Sampler:
    """Signatures of weighted sets; ``block`` terms at a time through arrays that stay in the processor's cache."""

    def __init__(self, samples: int, seed: int, block: int = 512) -> None:
        self.keys, self.block, self.samples = sample_keys(samples, seed), block, samples
        self.h, self.b, self.x = (np.empty((block, samples), U32) for _ in range(3))
        self.c, self.u = (np.empty((block, samples), np.float32) for _ in range(2))

    def draws(self, terms: np.ndarray, logs: np.ndarray | None) -> np.ndarray:
        """a (terms, samples) for at most ``block`` terms."""
        n = len(terms)
        h, b, x, c, u = self.h[:n], self.b[:n], self.x[:n], self.c[:n], self.u[:n]
        np.bitwise_xor(terms.astype(U32)[:, None], self.keys[0], out=h)
        for mult, shift in ((0x7FEB352D, 15), (0x846CA68B, 16)):
            np.multiply(h, U32(mult), out=h)
            np.right_shift(h, U32(shift), out=x)
            np.bitwise_xor(h, x, out=h)
        np.bitwise_xor((terms >> np.uint64(32)).astype(U32)[:, None], self.keys[1], out=b)
        np.add(b, h, out=b)
        np.multiply(b, U32(0x9E3779B1), out=b)
        np.right_shift(b, U32(15), out=x)
        np.bitwise_xor(b, x, out=b)
        np.multiply(b, U32(0x2C1B3C6D), out=b)
        # c = -ln(u v), the halves of h being u and v
        np.right_shift(h, U32(16), out=x)
        np.copyto(c, x, casting="unsafe")
        np.bitwise_and(h, U32(0xFFFF), out=x)
        np.copyto(u, x, casting="unsafe")
        c += np.float32(0.5)
        u += np.float32(0.5)
        c *= u
        c *= np.float32(2.0 ** -32)
        np.log(c, out=c)
        np.negative(c, out=c)
        np.right_shift(b, U32(8), out=x)
        np.copyto(u, x, casting="unsafe")
        u += np.float32(0.5)
        u *= np.float32(2.0 ** -24)
        if logs is None:
            c *= u
            return c
        plain = u.copy()  # exp(-e)
        np.log(u, out=u)
        np.multiply(h, U32(0x85EBCA6B), out=h)
        np.bitwise_xor(h, b, out=h)
        np.multiply(h, U32(0xC2B2AE35), out=h)
        np.right_shift(h, U32(8), out=h)
        f = h.astype(np.float32)
        f += np.float32(0.5)
        f *= np.float32(2.0 ** -24)
        np.log(f, out=f)
        f += u  # -r
        u /= f  # 1 - b
        t = logs.astype(np.float32)[:, None] / f
        t += u
        np.negative(t, out=t)
        t += np.float32(1)
        np.floor(t, out=t)
        same = t == 0
        t += u
        t *= f
        np.exp(t, out=t)
        np.copyto(t, plain, where=same)  # t = 0: bit by bit what weight 1 gives
        c *= t
        return c

    def smallest(self, terms: np.ndarray, logs: np.ndarray | None, cuts: np.ndarray) -> np.ndarray:
        """The smallest a (sets, samples) of the sets terms[cuts[i]:cuts[i + 1]]; infinite for an empty set.
        ``logs``: the logarithms of the weights, none where all are 1."""
        out = np.full((len(cuts) - 1, self.samples), np.inf, np.float32)
        for lo in range(0, len(terms), self.block):
            hi = min(len(terms), lo + self.block)
            a = self.draws(terms[lo:hi], None if logs is None else logs[lo:hi])
            first, last = int(np.searchsorted(cuts, lo, side="right")) - 1, int(np.searchsorted(cuts, hi, side="left"))
            for i in range(first, last):
                p, q = max(int(cuts[i]), lo) - lo, min(int(cuts[i + 1]), hi) - lo
                if q > p:
                    np.minimum(out[i], a[p:q].min(axis=0), out=out[i])
        return out


def fold16(a: np.ndarray) -> np.ndarray:
    """16 bits of each sample; equal samples stay equal and others meet by chance once in 65,536."""
    h = a.view(U32).copy()
    for mult, shift in ((0x7FEB352D, 15), (0x846CA68B, 16)):
        h *= U32(mult)
        h ^= h >> U32(shift)
    return (h >> U32(16)).astype(np.uint16)
