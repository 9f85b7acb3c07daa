"""Feature registry and assembly of wide training tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookups import join_all

# A feature turns a spine and the tables around it into spine keys plus columns.
Feature = Callable[[DataFrame, Any], DataFrame]

FEATURES: dict[str, Feature] = {}


def feature(name: str):
    """Register a feature under a name."""

    def register(fn: Feature) -> Feature:
        if name in FEATURES:
            raise ValueError(f"feature {name} registered twice")
        FEATURES[name] = fn
        return fn

    return register


def assemble(spine: DataFrame, tables: Any, names: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Left joins of the named features on the spine key.

    All joins share one key, so the growing side is shuffled once and each
    feature once.
    """
    return join_all(spine, [FEATURES[n](spine, tables) for n in names], on)


def tag(df: DataFrame, keys: Sequence[str], text: str, tagger: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Entities of a text column by a user-supplied tagger, in Arrow batches.

    ``tagger`` maps a series of texts to a series of ``[(label, start, end)]``
    lists.  Output: keys, label, start, end, entity.
    """
    source = df.select(*keys, F.col(text).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = pdf.assign(_span=tagger(pdf["_text"])).explode("_span").dropna(subset=["_span"])
            parts = pd.DataFrame(spans["_span"].tolist(), columns=["label", "start", "end"], index=spans.index)
            entity = [t[a:b] for t, a, b in zip(spans["_text"], parts["start"], parts["end"])]
            yield pd.concat([spans[list(keys)], parts.astype({"start": "int32", "end": "int32"})], axis=1).assign(entity=entity)

    fields = [f"{k} {source.schema[k].dataType.simpleString()}" for k in keys]
    return source.mapInPandas(run, ", ".join([*fields, "label string", "start int", "`end` int", "entity string"]))
