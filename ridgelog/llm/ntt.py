"""Exact integer correlation by number-theoretic transforms over matrices of equally long rows."""

from functools import lru_cache

import numpy as np

#: fixed values: primes with many roots of unity of two-power order, and a generator of each (15*2^27+1, 7*2^26+1, 5*2^25+1)
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: the longest transform that all of them have
LONGEST = 1 << 25


@lru_cache(maxsize=256)
def _roots(prime: int, generator: int, size: int, inverse: bool) -> np.ndarray:
    """The powers 0 .. size/2-1 of a root of unity of order ``size``."""
    root = pow(generator, (prime - 1) // size, prime)
    root = pow(root, prime - 2, prime) if inverse else root
    powers = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < len(powers):  # doubling: the next stretch is the known one times a power
        step = np.uint64(pow(root, done, prime))
        powers[done : 2 * done] = powers[:done] * step % np.uint64(prime)
        done *= 2
    return powers


def _forward(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The transform of every row, its values in bit-reversed order (decimation in frequency)."""
    p, count, size = np.uint64(prime), len(rows), rows.shape[1]
    width = size
    while width > 1:
        half = width // 2
        parts = rows.reshape(count, size // width, 2, half)
        upper, lower = parts[:, :, 0], parts[:, :, 1]
        out = np.empty_like(parts)
        np.remainder(upper + lower, p, out=out[:, :, 0])
        np.remainder((upper + (p - lower)) * _roots(prime, generator, width, False), p, out=out[:, :, 1])
        rows, width = out.reshape(count, size), half
    return rows


def _backward(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of ``_forward``: from bit-reversed values back to the natural order (decimation in time)."""
    p, count, size = np.uint64(prime), len(rows), rows.shape[1]
    width = 2
    while width <= size:
        half = width // 2
        parts = rows.reshape(count, size // width, 2, half)
        upper, lower = parts[:, :, 0], parts[:, :, 1] * _roots(prime, generator, width, True) % p
        out = np.empty_like(parts)
        np.remainder(upper + lower, p, out=out[:, :, 0])
        np.remainder(upper + (p - lower), p, out=out[:, :, 1])
        rows, width = out.reshape(count, size), width * 2
    return rows * np.uint64(pow(size, prime - 2, prime)) % p


def squared_differences(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a pattern occurs: for every row ``j`` and shift ``t``, whether ``sum((pattern[j, i] - text[j, i + t])²)`` is zero.

    ``pattern`` has ``B`` columns, a power of two, and ``text`` ``2 B``; shifts are 0 .. ``B - 1``, for which a cyclic
    correlation of length ``2 B`` has no overlap. The sum is ``Σ pattern² - 2 Σ pattern text + Σ text²``, computed modulo as many
    primes as its greatest possible value needs, so that zero means zero. Values are integers from 0.
    """
    count, size = text.shape
    block = pattern.shape[1]
    most = int(max(pattern.max(initial=0), text.max(initial=0)))
    bound, product, primes = block * most * most, 1, []
    for prime, generator in PRIMES:
        primes.append((prime, generator))
        product *= prime
        if product > bound:
            break
    else:
        raise ValueError("values too large for an exact result")
    zero = np.ones((count, block), bool)
    for prime, generator in primes:
        p = np.uint64(prime)
        own, other = pattern.astype(np.uint64) % p, text.astype(np.uint64) % p
        turned = np.zeros((count, size), np.uint64)
        turned[:, 0] = own[:, 0]
        turned[:, size - block + 1 :] = own[:, :0:-1]  # pattern at -i, so that the product correlates
        spectrum = _forward(turned, prime, generator) * _forward(other, prime, generator) % p
        cross = _backward(spectrum, prime, generator)[:, :block]
        squares = np.concatenate([np.zeros((count, 1), np.uint64), np.cumsum(other * other % p, axis=1)], axis=1)
        windows = (squares[:, block : 2 * block] - squares[:, :block]) % p
        total = ((own * own % p).sum(axis=1) % p)[:, None] + windows
        zero &= total % p == 2 * cross % p
    return zero
