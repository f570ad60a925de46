"""Property-graph analytics on Spark DataFrames."""

from __future__ import annotations

import os
from typing import Any


def share_path(spark: Any) -> None:
    """Lets Python workers import this package from where the driver has it, whatever their working folder.

    On a cluster the same path must be there, or the package be installed or shipped with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *[p for p in paths if p]])
