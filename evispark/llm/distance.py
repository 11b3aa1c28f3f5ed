"""Edit distances on short strings."""

from __future__ import annotations


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or most + 1 if there are more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    while la and lb and a[0] == b[0]:
        a, b, la, lb = a[1:], b[1:], la - 1, lb - 1
    while la and lb and a[-1] == b[-1]:
        a, b, la, lb = a[:-1], b[:-1], la - 1, lb - 1
    if not la or not lb:
        return min(la + lb, most + 1)
    before, last = [0] * (lb + 1), list(range(lb + 1))
    for i in range(1, la + 1):
        row = [i] + [most + 1] * lb
        for j in range(max(1, i - most), min(lb, i + most) + 1):
            cost = a[i - 1] != b[j - 1]
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            row[j] = v
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[lb], most + 1)


def allowed(n: int) -> int:
    """Edits that a word of n letters may differ by: none up to 3, one up to 5, else two."""
    return 0 if n <= 3 else 1 if n <= 5 else 2
