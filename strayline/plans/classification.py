"""Classification job: split, fit, score the held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.functions.text import hash_unit
from strayline.operators.classification import make_pipeline, result_columns
from strayline.operators.newton import fit_logistic, scored
from strayline.operators.sampling import hash_split, random_split
from strayline.roles import Roles


def run(
    df: DataFrame,
    roles: Roles,
    algorithm: str = "LogisticRegression",
    standardize: bool = False,
    train_share: float = 0.8,
    seed: int = 0,
    split_key: str | None = None,
    **params,
) -> DataFrame:
    """Not standardised by default, unlike cleaning.

    ``newton`` as the algorithm takes Newton steps on the standardised features instead of
    MLlib's estimator; ``steps`` and ``regularisation`` are its parameters. With
    ``split_key`` the rows held out hang on a hash of that column.
    """
    rows, label = df.select(*roles.columns), roles.labels[0]
    if algorithm.lower() == "newton":
        held = hash_unit(split_key or roles.id[0], seed=seed) >= train_share
        known = rows.withColumn("_train", F.when(~held, F.col(label)))
        model = fit_logistic(known, roles.features, "_train", (params.get("regularisation", 0.0),), steps=params.get("steps", 12))[0]
        return scored(rows.filter(held), model).select(*result_columns(roles))
    if split_key is not None:
        train, test = hash_split(rows, split_key, train_share, seed)
    else:
        train, test = random_split(rows, (train_share, 1 - train_share), seed)
    pipeline = make_pipeline(roles.features, label, algorithm, standardize, **params)
    return pipeline.fit(train).transform(test).select(*result_columns(roles))
