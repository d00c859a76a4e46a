"""Full case folding of names as a column expression."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _letters() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one letter, those letters in the same order, and what longer folds there are."""
    folds = {c: c.casefold() for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"}
    single = {c: f for c, f in folds.items() if len(f) == 1 and f != c}
    return "".join(single), "".join(single.values()), {c: f for c, f in folds.items() if len(f) > 1}


def casefolded(text: Column) -> Column:
    """``text`` with every letter folded: capitals, final sigma and long s by one letter, sharp s and ligatures by two
    or three.  Names without letters of the second kind, nearly all, are not taken apart."""
    before, after, longer = _letters()
    plain = F.translate(text, before, after)
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    letters = F.transform(F.split(plain, ""), lambda c: F.coalesce(F.element_at(table, c), c))
    return F.when(F.rlike(plain, F.lit(f"[{''.join(longer)}]")), F.array_join(letters, "")).otherwise(plain)
