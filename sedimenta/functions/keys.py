"""Column expressions that bring identifiers and labels into one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands around identifiers: angle brackets and blanks of any kind.
OUTER = "<> \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def message_key(c: Column) -> Column:
    """What a message identifier names: without blanks and angle brackets around it, the
    part behind the last @ in lower case. Null where nothing is left."""
    bare = F.trim(c, F.lit(OUTER))
    host = F.substring_index(bare, "@", -1)
    return F.when(bare == "", None).when(
        F.contains(bare, F.lit("@")), F.concat(F.left(bare, F.length(bare) - F.length(host)), F.lower(host))
    ).otherwise(bare)


def label_key(c: Column) -> Column:
    """A label without letter case, outer blanks and what joins its words. Null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
