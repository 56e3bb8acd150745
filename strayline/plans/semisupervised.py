"""Label propagation job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strayline.operators.propagation import label_propagation
from strayline.roles import Roles

# What the job uses unless told otherwise.
DEFAULTS = {
    "sigma": 0.42,
    "tol": 0.01,
    "k": 2,
    "max_iters": 5,
    "eval_type": None,
    "standardize": True,
    "priors": None,
}


def run(df: DataFrame, roles: Roles, **params) -> DataFrame:
    return label_propagation(
        df,
        id_col=roles.id[0],
        label_col=roles.labels[0],
        feature_cols=roles.features,
        **{**DEFAULTS, **params},
    )
