"""Long answers as parts of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS

# What marks a part that goes on, and a code block that does.
CONTINUED, FENCE_CONTINUED = "\n\n_(계속...)_", "\n```\n*(계속)*"
#: Where a text may be cut, best first, and the share of the limit that must lie before the mark (of a closed code block, before its end).
FENCE_END = re.compile(r"```\s*\n")
CUTS = [("\n\n", 0.5), ("\n", 0.5), (". ", 0.5), ("! ", 0.5), ("? ", 0.5), (" ", 0.3)]


def _cut_at(head: str) -> int:
    fence = max((m.end() for m in FENCE_END.finditer(head)), default=-1)
    if fence > 0.5 * len(head):
        return fence
    marks = ((head.rfind(mark), mark, least) for mark, least in CUTS)
    return next((at + len(mark) for at, mark, least in marks if at > least * len(head)), len(head))


def parts_of(text: str | None, limit: int = DEFAULTS.message_chars) -> Iterator[str]:
    """Parts of at most ``limit`` characters before a closing mark. A code block that a cut falls into is closed and opened again."""
    rest = text or ""
    while len(rest) > limit:
        at = _cut_at(rest[:limit])
        part, rest = rest[:at].rstrip(), rest[at:].lstrip()
        fences = re.findall(r"```(\w*)", part)
        if len(fences) % 2:
            reopened = f"```{fences[-1]}\n" + rest if rest else rest
            if len(reopened) >= at + len(rest):  # a block whose opening alone fills a part can't be kept together
                yield part
                continue
            part, rest = part.rstrip() + FENCE_CONTINUED, reopened
        if part:
            yield part
    if rest or not text:
        yield rest


def message_parts(limit: int = DEFAULTS.message_chars):
    """A Column function text -> array of parts; null counts as empty."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(parts_of(t, limit)))

    return split


def numbered(parts: Column) -> Column:
    """Parts of a message of several with (i/n) in front."""
    n = F.size(parts)
    return F.when(n < 2, parts).otherwise(F.transform(parts, lambda p, i: F.concat(F.lit("("), i + 1, F.lit("/"), n, F.lit(")\n"), p)))


def response_parts(text: Column, sources: Column, limit: int = DEFAULTS.message_chars) -> Column:
    """Fixed-width parts with a notice that more follows; the last one has the source section."""
    width = limit - len(CONTINUED)
    text, sources = F.coalesce(text, F.lit("")), F.coalesce(sources, F.lit(""))
    full = F.greatest(F.lit(0), F.ceil((F.length(text) + F.length(sources) - limit) / width)).cast("int")
    before = F.transform(F.sequence(F.lit(1), F.greatest(full, F.lit(1))), lambda i: F.concat(F.substr(text, (i - 1) * width + 1, F.lit(width)), F.lit(CONTINUED)))
    last = F.array(F.concat(F.substr(text, full * width + 1), sources))
    return F.when(full == 0, last).otherwise(F.concat(before, last))
