"""Where a chunk's words stand on a page: by anchors of its words in texts without blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out before an anchor, words of an anchor, and its least characters.
OFFSETS = (0, 8, 20)
LENGTHS = (30, 15, 8)
LEAST = 16
TAIL, HEAD, REACH = 10, 6, 600


def locate(page: Column, words: Column) -> Column:
    """(start, end) of a chunk (array of words) on a page (words joined), from 0; null where no anchor of it stands.

    The whole chunk is tried first, then anchors of falling length at growing
    offsets. Behind a partial anchor the match goes on to the chunk's last words
    if these follow, and before one that left words out it begins at the first
    words if they are near.
    """
    n = F.size(words)
    part = lambda at, size: F.array_join(F.slice(words, F.lit(at + 1), size), "")

    def anchor(at: int, size: Column) -> Column:
        said = part(at, size)
        start = F.instr(page, said) - 1
        ok = (F.lit(at) + size <= n) & (F.length(said) >= LEAST) & (start >= 0)
        return F.when(ok, F.struct(start.alias("start"), (start + F.length(said)).alias("end"), F.lit(at).alias("at"), (size < n).alias("partial")))

    tries = [anchor(0, n)] + [anchor(at, F.lit(size)) for at in OFFSETS for size in LENGTHS]
    hit = F.coalesce(*tries)
    tail = F.array_join(F.slice(words, F.greatest(n - TAIL + 1, F.lit(1)), F.lit(TAIL)), "")
    behind = F.position(tail, page, hit["end"] + 1)
    end = F.when(hit["partial"] & (behind > 0), behind - 1 + F.length(tail)).otherwise(hit["end"])
    head = part(0, F.lit(HEAD))
    before = F.substring(page, F.greatest(hit["start"] - REACH + 2, F.lit(1)), F.least(hit["start"] + F.length(head), F.lit(REACH - 1) + F.length(head)))
    # the last place of the first words that is not behind the anchor
    from_end = F.instr(F.reverse(before), F.reverse(head))
    at = F.greatest(hit["start"] - REACH + 2, F.lit(1)) + F.length(before) - from_end - F.length(head)
    start = F.when((hit["at"] > 0) & (from_end > 0), at).otherwise(hit["start"])
    return F.when((page != "") & (n > 0) & hit.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
