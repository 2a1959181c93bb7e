"""Portable paths, alias keys and ancestors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PATH, MAX_COMPONENT, MAX_DEPTH = 1024, 240, 32
#: Device names that no component may have as its stem.
DEVICES = frozenset(["con", "prn", "aux", "nul", "clock$", "conin$", "conout$", *(f"com{i}" for i in "123456789¹²³"), *(f"lpt{i}" for i in "123456789¹²³")])


def portable(path: Column) -> Column:
    """Relative, with /, no empty, . or .. component, no NUL, backslash or colon, at most 1024 bytes."""
    parts = F.split(path, "/")
    fine = (F.octet_length(path).between(1, MAX_PATH)) & ~path.rlike(r"[\x00\\:]") & F.forall(parts, lambda x: ~x.isin("", ".", ".."))
    return F.coalesce(fine, F.lit(False))


def ancestors(path: Column) -> Column:
    """All proper path prefixes that end at a component."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def alias(component: str) -> str | None:
    """What names of equal files on any system have in common; null for a component that is not portable."""
    if not component or any(c in '<>:"/\\|?*' or ord(c) < 32 for c in component) or component[-1] in " ." or len(component.encode()) > MAX_COMPONENT:
        return None
    normal = unicodedata.normalize("NFC", component)
    return None if normal.split(".", 1)[0].casefold() in DEVICES else normal.casefold()


@F.pandas_udf(T.StringType())
def alias_key(paths: pd.Series) -> pd.Series:
    """The alias keys of a path's components, joined by /; null if any is not portable."""

    def key(path):
        keys = [alias(x) for x in path.split("/")]
        return None if None in keys else "/".join(keys)

    return paths.map(key, na_action="ignore")


@F.pandas_udf(T.StringType())
def subject_key(texts: pd.Series) -> pd.Series:
    """NFKC and case folding: spellings of one subject agree."""
    return texts.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")
