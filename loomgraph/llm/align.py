"""Banded alignment of word sequences: edit distance by bit-parallel bands."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence


#: Edits that the first band allows for; it widens by WIDER until the distance lies inside.
NARROW, WIDER = 32, 8


def edit_distance(a: Sequence, b: Sequence, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is larger.

    Common ends are cut off first.  A bound by counts of equal elements comes
    next.  What is left is aligned inside a band of diagonals, which starts
    narrow, so the cost follows the distance that is found.
    """
    if len(a) < len(b):
        a, b = b, a
    lo, n, m = 0, len(a), len(b)
    while lo < m and a[lo] == b[lo]:
        lo += 1
    while m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    most = min(most, n)
    if n - (Counter(a) & Counter(b)).total() > most:
        return most + 1
    band = max(NARROW, n - m)
    while band < most:
        found = _in_band(a, b, band)
        if found <= band:
            return found
        band *= WIDER
    return _in_band(a, b, most)


class _Places:
    """Where elements stand in a sequence, as bits of a window of it.

    A frequent element has a mask of the whole sequence, which costs a bit for
    each place; others have a list.  So all take memory in proportion to the
    sequence: there are at most RARE masks.
    """

    RARE = 320

    def __init__(self, a: Sequence):
        self.lists: dict = {}
        for i, x in enumerate(a):
            self.lists.setdefault(x, []).append(i)
        self.masks = {}
        for x in [x for x, at in self.lists.items() if len(at) > max(8, len(a) // self.RARE)]:
            bits = bytearray(len(a) // 8 + 1)
            for i in self.lists.pop(x):
                bits[i >> 3] |= 1 << (i & 7)
            self.masks[x] = int.from_bytes(bits, "little")

    def window(self, x, at: int, width: int) -> int:
        """Bit d is set if x stands at ``at`` + d, for d < width."""
        if x in self.masks:
            bits = self.masks[x]
            return (bits >> at if at >= 0 else bits << -at) & ((1 << width) - 1)
        own = self.lists.get(x)
        if not own:
            return 0
        bits = 0
        for i in own[bisect_left(own, at) : bisect_left(own, at + width)] if len(own) > 1 else own:
            if 0 <= i - at < width:
                bits |= 1 << (i - at)
        return bits


def _in_band(a: Sequence, b: Sequence, most: int) -> int:
    """Edit distance if it is ``most`` or less, else ``most`` + 1; ``a`` is the longer one, by ``most`` at most.

    The band has the 2 * ``most`` + 1 diagonals that a path of that cost can
    reach.  It is one Python integer, a bit for each diagonal, which slides
    down one row for each element of ``b`` (Hyyro's diagonal form of Myers'
    algorithm).
    """
    n, m = len(a), len(b)
    where = _Places(a)
    # Bit d of the band at row j stands for element j - most + d of a.  Elements
    # before a's first match nothing and cost nothing to skip along the top edge.
    width = 2 * most + 1
    full, middle = (1 << width) - 1, 1 << most
    plus, minus = full & ~((1 << most) - 1), 0
    cost, at = 0, -most
    for j in range(m):
        same = where.window(b[j], at, width)
        zero = ((((same & plus) + plus) ^ plus) | same | minus) & full
        across_up = minus | (~(zero | plus) & full)
        across_down = zero & plus
        # The middle bit follows the main diagonal: a step costs 1 unless it is a zero step.
        if not zero & middle:
            cost += 1
        shifted = zero >> 1
        plus = across_down | (~(shifted | across_up) & full)
        minus = shifted & across_up
        at += 1
    # From (m, m) on the main diagonal along the last row to (n, m).
    for d in range(1, n - m + 1):
        bit = 1 << (most + d - 1)
        if plus & bit:
            cost += 1
        elif minus & bit:
            cost -= 1
    return min(cost, most + 1)


def similarity(a: Sequence, b: Sequence, least: float) -> float:
    """1 - edit distance / longer length, or 0.0 where that is below ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    found = edit_distance(a, b, most)
    return 1 - found / longer if found <= most else 0.0
