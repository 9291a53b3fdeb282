"""Column expressions over token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.vectors import _c

ColumnOrName = Column | str

# Token ids of the text that ends a prompt, per model family.
PROMPT_END_PATTERNS = {
    "llama3": [128009, 128006, 78191, 128007, 271],
    "gemma2": [107, 108, 106, 2516, 108],
}
NOT_FOUND = 1_000_000_000


def truncate(ids: ColumnOrName, n: int, side: str = "right") -> Column:
    """Keep the first n ids (right) or the last n ids (left)."""
    a = _c(ids)
    if side == "right":
        return F.slice(a, 1, n)
    if side == "left":
        return F.slice(a, F.greatest(F.size(a) - F.lit(n), F.lit(0)) + 1, n)
    raise ValueError(f"side must be 'right' or 'left', not {side!r}")


def pad(ids: ColumnOrName, n: int, pad_id: int) -> Column:
    """Right-pad to length n with pad_id (longer arrays are left alone)."""
    a = _c(ids)
    missing = F.greatest(F.lit(n) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(pad_id), missing))


def pad_to(ids: ColumnOrName, n: ColumnOrName, pad_id: int) -> Column:
    """T2 with a length column: right-pad to ``n`` (a column) with pad_id."""
    a = _c(ids)
    missing = F.greatest(_c(n) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(pad_id), missing))


def pad_mask(ids: ColumnOrName, n: int) -> Column:
    """T2 mask: 1 for every original id, 0 for every padded slot."""
    a = _c(ids)
    missing = F.greatest(F.lit(n) - F.size(a), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(a)), F.array_repeat(F.lit(0), missing))


def last_token_index(ids: ColumnOrName, pad_id: int) -> Column:
    """(index of the first pad) - 1, modulo the length.

    No pad gives the last index; a pad in front gives length - 1; an empty
    array gives null.
    """
    a = _c(ids)
    first = F.greatest(F.array_position(a, pad_id), F.lit(1)) - 2
    return F.when(F.size(a) > 0, F.pmod(first, F.size(a))).cast("int")


def find_last(ids: ColumnOrName, pattern: list[int]) -> Column:
    """T4: 0-based start of the last occurrence of ``pattern``; null if absent.

    The m shifted copies of the array are zipped once, so the lambda only
    looks at its own element: O(m * length) per row.
    """
    a = _c(ids)
    m = len(pattern)
    n = F.size(a)
    shifted = [F.slice(a, i + 1, F.greatest(n - i, F.lit(0))).alias(f"s{i}") for i in range(m)]
    z = F.arrays_zip(*shifted)

    def hit(t, j):
        cond = None
        for i, v in enumerate(pattern):
            c = t[f"s{i}"] == F.lit(int(v))
            cond = c if cond is None else cond & c
        return F.when(F.coalesce(cond, F.lit(False)), j)

    return F.when(n >= m, F.array_max(F.transform(z, hit))).cast("int")


def prompt_length(ids: ColumnOrName, family: str) -> Column:
    """T4 as the prompt length: absent pattern gives the not-found sentinel."""
    return F.coalesce(find_last(ids, PROMPT_END_PATTERNS[family]), F.lit(NOT_FOUND))


def mask_double_bos(ids: ColumnOrName, mask: ColumnOrName, bos_id: int) -> Column:
    """T5: if the first unmasked token and the next one (clamped to the end)
    are both BOS, mask out the first of them (rebuilt with slices, no
    per-element lambda)."""
    a, m = _c(ids), _c(mask)
    start = F.greatest(F.array_position(m, 1) - 1, F.lit(0)).cast("int")
    second = F.greatest(F.least(start + 1, F.size(a) - 1), F.lit(0))
    double = (F.size(a) > 0) & (F.try_element_at(a, (start + 1).cast("int")) == F.lit(bos_id)) & (
        F.try_element_at(a, (second + 1).cast("int")) == F.lit(bos_id))
    rebuilt = F.concat(F.slice(m, 1, start), F.array(F.lit(0)),
                       F.slice(m, start + 2, F.greatest(F.size(m) - start - 1, F.lit(0))))
    return F.when(F.coalesce(double, F.lit(False)), rebuilt).otherwise(m)
