"""Registered queries over the driver tables: each has a Spark form and,
where the semantics allow, an equivalent DuckDB SQL oracle."""

from riskweave.plans.catalog import REGISTRY, register  # noqa: F401
from riskweave.plans import (  # noqa: F401  (import registers the queries)
    q_rfm, q_profile, q_features, q_categorical, q_quality, q_correlation, q_prepare, q_woe, q_segments, q_model,
)
