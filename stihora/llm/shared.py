"""What several operators need: written tables, and folding inside the JVM."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from stihora.storage import written

from .arrays import fold_char

__all__ = ["fold_maps", "folded", "folded_words", "written"]


@lru_cache(1)
def fold_maps() -> tuple[str, str]:
    """Characters and what they fold to, for translate(); those that vanish stand last, without a counterpart."""
    blocks = (range(0x80, 0x590), range(0x1E00, 0x2070), range(0x3000, 0x3001), range(0xFE00, 0xFE10), range(0xFF00, 0xFF5F), range(0xFEFF, 0xFF00))
    gone, some = [], []
    for c in [*range(0x61, 0x7B), *(c for b in blocks for c in b)]:
        f = fold_char(chr(c))
        if not f:
            gone.append(chr(c))
        elif f != chr(c):
            some.append((chr(c), f))
    return "".join(a for a, _ in some) + "".join(gone), "".join(b for _, b in some)


def folded(text: Column) -> Column:
    """Comparison form of a text as an expression: case, marks, look-alikes, full-width and invisible characters are gone."""
    return F.translate(F.lower(text), *fold_maps())


def folded_words(text: Column) -> Column:
    """The words of a text in comparison form."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), 0)
