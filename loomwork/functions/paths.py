"""File keys and statuses as the inventory tables write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say a file is gone, and words that take it back (fixed values).
GONE = "删|移除|(?i:delet|remov|gone|erased|dropped)"
NOT_GONE = "未删|没删|恢复|(?i:not (deleted|removed)|undelet|restored)"


def file_key(directory: Column, name: Column) -> Column:
    """Directory, ``/`` and name with single ``/`` as the only separator.

    Null name: null key (such a line names no file). Null directory: root.
    """
    raw = F.concat(F.coalesce(directory, F.lit("")), F.lit("/"), name)
    return F.regexp_replace(F.translate(raw, "\\", "/"), "/+", "/")


def says_deleted(status: Column) -> Column:
    """True where a status, in whatever wording, says the file was deleted; null counts as no."""
    return F.coalesce(status.rlike(GONE) & ~status.rlike(NOT_GONE), F.lit(False))


def content_id(md5: Column) -> Column:
    """Content hash with letter case and outer blanks aside; blank is null."""
    m = F.lower(F.trim(md5))
    return F.when(m != "", m)
