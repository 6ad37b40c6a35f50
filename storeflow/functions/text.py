"""Text repair expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT_CHAR = "\ufffd"


def repair_text(c: Column, unicode_spaces: bool = False) -> Column:
    """U+FFFD -> space, every whitespace run -> one space, trim spaces.

    ``\\s`` is ASCII whitespace; ``unicode_spaces=True`` also folds Unicode
    spaces such as the no-break space.
    """
    spaced = F.replace(c, F.lit(REPLACEMENT_CHAR), F.lit(" "))
    if unicode_spaces:
        return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))
    # Most texts have single spaces only; the pattern would leave them alone.
    wide = spaced.contains("  ")
    for space in "\t\n\v\f\r":
        wide = wide | spaced.contains(space)
    return F.trim(F.when(wide, F.regexp_replace(spaced, r"\s+", " ")).otherwise(spaced))


def has_replacement_char(c: Column) -> Column:
    return c.contains(REPLACEMENT_CHAR)
