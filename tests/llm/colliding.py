"""Two different strings that polynomial hashes modulo 2**64 with an odd base can't tell apart."""

import numpy as np


def pair(first: int = 64) -> tuple[str, str]:
    """Printable ASCII; their difference is a multiple of 2**64 wherever the hash is taken."""
    poly = np.array([1], dtype=int)
    for i in (*range(8), *range(5)):
        factor = np.zeros((1 << i) + 1, dtype=int)
        factor[0], factor[-1] = -1, 1
        poly = np.convolve(poly, factor)
    a, b = np.maximum(poly, 0) + first, np.maximum(-poly, 0) + first
    return "".join(map(chr, a)), "".join(map(chr, b))
