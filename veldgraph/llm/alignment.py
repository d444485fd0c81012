"""Banded alignment of word sequences, bit-parallel over the band's diagonals."""

from __future__ import annotations

from collections import Counter


def _banded(a: list, b: list, limit: int) -> int:
    """Edit distance of ``a`` and ``b`` (len(a) >= len(b)) if at most ``limit``, else limit + 1.

    One integer holds the vertical differences of the 2 * limit + 1 cells of a
    column that lie within ``limit`` of the diagonal (Hyyrö 2003); it moves down
    a row with each column.
    """
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    limit = min(limit, n)  # no distance is larger
    width = 2 * limit + 2
    full = (1 << width) - 1
    # Where each word stands, in blocks of bits no narrower than the band: a column's cells lie in two of them.
    block = max(width, 1024)
    blocks: list[dict] = [{} for _ in range(n // block + 2)]
    for i, x in enumerate(a):
        at = blocks[i // block]
        at[x] = at.get(x, 0) | (1 << i % block)
    last = len(blocks) - 2
    vp = full & ~((1 << (width - limit - 1)) - 1)
    vn = 0
    start = limit + 1 - width
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    distance = limit
    worst = limit + m - (n - limit)
    for j, y in enumerate(b):
        if start < 0:
            mask = blocks[0].get(y, 0) << -start & full
        else:
            k, shift = divmod(start, block)
            mask = (blocks[k].get(y, 0) >> shift | blocks[k + 1].get(y, 0) << block - shift) & full if k <= last else 0
        start += 1
        d0 = ((((mask & vp) + vp) ^ vp) | mask | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < n - limit:
            distance += not d0 & diagonal
        else:
            distance += bool(hp & horizontal)
            distance -= bool(hn & horizontal)
            horizontal >>= 1
        if distance > worst:
            return limit + 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
    return min(distance, limit + 1)


def edit_distance(a: list, b: list, limit: int) -> int:
    """Number of words to insert, delete or replace, if at most ``limit``; else limit + 1."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not b:
        return min(len(a), limit + 1)
    x, y = Counter(a), Counter(b)
    common = sum(min(n, y[w]) for w, n in x.items() if w in y)
    if len(a) - common > limit:
        return limit + 1
    band = 8
    while True:  # a band that turns out wide enough gives the distance
        band = min(band, limit)
        if (d := _banded(a, b, band)) <= band or band == limit:
            return d
        band *= 4


def allowed(a: int, b: int, similarity: float) -> int:
    """The largest distance at which texts of ``a`` and ``b`` words are alike."""
    return int((1 - similarity) * max(a, b) + 1e-9)


def alike(a: list, b: list, similarity: float) -> bool:
    """Whether 1 - distance / length of the longer is at least ``similarity``."""
    limit = allowed(len(a), len(b), similarity)
    return edit_distance(a, b, limit) <= limit
