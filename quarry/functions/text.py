"""Text analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[^\p{L}\p{N}]+"
CLS, SEP, MASK, PAD, QUERY, DOC = "[CLS]", "[SEP]", "[MASK]", "[PAD]", "[Q]", "[D]"


def pieces(text: Column) -> Column:
    """``tokens``, and the empty ones before the first and behind the last separator."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.filter(pieces(text), lambda t: t != "")


def truncated(text: Column, limit: int) -> Column:
    return F.slice(tokens(text), 1, limit)


def passage(title: Column, contents: Column) -> Column:
    """Title, a blank, contents; the blank leads when the title is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(contents, F.lit("")))


def passage_pair(title: Column, contents: Column, limit: int) -> Column:
    """``[CLS] title [SEP] contents [SEP]`` cut to ``limit`` tokens, the last of them a separator."""
    body = F.concat(tokens(title), F.array(F.lit(SEP)), tokens(contents))
    return F.concat(F.array(F.lit(CLS)), F.slice(body, 1, limit - 2), F.array(F.lit(SEP)))


def late_query(text: Column, limit: int) -> Column:
    """Query tokens padded with masks to ``limit``: the masks are encoded too, which augments the query."""
    used = truncated(text, limit - 3)
    return F.concat(F.array(F.lit(CLS), F.lit(QUERY)), used, F.array(F.lit(SEP)), F.array_repeat(F.lit(MASK), F.lit(limit - 3) - F.size(used)))


def late_doc(text: Column, limit: int) -> Column:
    """Passage tokens padded to ``limit``."""
    used = truncated(text, limit - 3)
    return F.concat(F.array(F.lit(CLS), F.lit(DOC)), used, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), F.lit(limit - 3) - F.size(used)))


def attention(padded: Column) -> Column:
    """1 for a token, 0 for padding."""
    return F.transform(padded, lambda t: (t != PAD).cast("int"))
