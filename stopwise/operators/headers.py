"""Header normalisation: one projection, whatever the number of columns."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

# Characters each mode turns into "_" one for one.
REPLACED = {"basic": " .", "hyphen": " .-", "strict": " .-"}


def normalized(name: str, mode: str = "basic") -> str:
    out = name.strip().lower().translate({ord(ch): "_" for ch in REPLACED[mode]})
    if mode == "strict":
        out = re.sub("_+", "_", re.sub("[^a-z0-9_]", "_", out))
    return out


def normalize_headers(df: DataFrame, mode: str = "basic") -> DataFrame:
    """Rename all columns. ``mode`` is ``basic``, ``hyphen`` or ``strict``.

    Two headers that end up equal are an error, since one of them would be lost later.
    """
    names = [normalized(c, mode) for c in df.columns]
    clashes = [n for n, count in Counter(names).items() if count > 1]
    if clashes:
        raise ValueError(f"headers collide after normalisation: {clashes}")
    return df.toDF(*names)
