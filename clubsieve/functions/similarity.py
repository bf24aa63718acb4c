"""Sequence similarity: no built-in function has this measure, so it runs as Arrow batches."""
from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from . import fixed_values as fv


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts; each distinct pair of a batch is computed once."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a.fillna(""), b.fillna("")):
        if (x, y) not in seen:
            seen[x, y] = SequenceMatcher(None, x, y, autojunk=False).ratio()
        out.append(seen[x, y])
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def tab_score(text: pd.Series) -> pd.Series:
    """0.8 for a known tab word inside the text, else the best similarity of at least 0.5."""
    def one(t: str) -> float:
        t = t.lower().strip()
        near = (0.8 if w in t else SequenceMatcher(None, t, w, autojunk=False).ratio() for w in fv.TAB_WORDS)
        return max((r for r in near if r >= 0.5), default=0.0)

    text = text.fillna("")
    return text.map({t: one(t) for t in text.unique()})


def venue_confidence(name: Column, city: Column, found_name: Column, found_address: Column,
                     types: Column, ratings: Column) -> Column:
    """0..100 from name similarity, city in the address, place type and ratings."""
    near = F.bround(ratio(F.lower(name), F.lower(F.coalesce(found_name, F.lit("")))) * 40, 0).cast("int")
    in_city = F.coalesce((city != "") & F.lower(found_address).contains(F.lower(city)), F.lit(False))
    sporty = F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(t) for t in fv.SPORTS_PLACE_TYPES])),
                        F.lit(False))
    score = (near + F.when(in_city, 30).otherwise(0) + F.when(sporty, 20).otherwise(0)
             + F.when(ratings > 0, 10).otherwise(0))
    return F.when(found_name.isNull(), 0).otherwise(score)
