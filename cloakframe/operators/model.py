"""Hook for a user-supplied name model (E9, U2). None ships with the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloakframe.options import PRIORITY, TYPE_NAME

Found = list[tuple[str, int, int, float]]  # (entity_type, start, end, score)
Model = Callable[[list[str]], list[Found]]  # all texts of an Arrow batch at once


def each_text(model: Callable[[str], Found]) -> Model:
    """A model that takes one text at a time."""
    return lambda texts: [model(t) for t in texts]


def model_spans(
    leaves: DataFrame, keys: list[str], text: str, load: Callable[[], Model]
) -> DataFrame:
    """Span rows of a model, loaded once per task and fed Arrow batches."""
    schema = T.StructType(
        [leaves.schema[k] for k in keys]
        + [
            T.StructField("entity_type", T.StringType()), T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()),
            T.StructField("score", T.DoubleType()), T.StructField("source", T.StringType()),
            T.StructField("priority", T.IntegerType()), T.StructField("type_ord", T.IntegerType()),
            T.StructField("value_ord", T.IntegerType()),
        ]
    )

    # Plain values only, so executors need not have this package.
    names, priority, well_formed = schema.names, PRIORITY["model"], TYPE_NAME

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = []
            full = [row for row in batch.itertuples(index=False, name=None) if row[-1]]
            for row, found in zip(full, model([row[-1] for row in full]), strict=True):
                *key, content = row
                for entity_type, start, end, score in found:
                    if not well_formed.match(entity_type):
                        raise ValueError(f"entity type must match [A-Z_]+: {entity_type!r}")
                    rows.append((*key, entity_type, start, end, content[start:end], float(score), "model", priority, 0, 0))
            yield pd.DataFrame(rows, columns=names)

    return leaves.select(*keys, text).mapInPandas(run, schema)
