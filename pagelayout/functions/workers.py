"""Getting the package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

import pagelayout

_shipped: set[str] = set()
_loaded: dict[str, object] = {}
X = TypeVar("X")


def per_worker(load: Callable[[], X]) -> Callable[[], X]:
    """`load`, run at most once in a worker process: later tasks there get what it returned. What it raises is raised."""
    name = uuid.uuid4().hex

    def get() -> X:
        from pagelayout.functions import workers

        if name not in workers._loaded:
            workers._loaded[name] = load()
        return workers._loaded[name]

    return get


def ship(spark: SparkSession) -> None:
    """Where workers can't import this package (it is neither installed nor on PYTHONPATH), send it to them, once an application."""
    home = os.path.dirname(os.path.abspath(pagelayout.__file__))
    root = os.path.dirname(home)
    path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in path or os.getcwd() == root or "site-packages" in root or app in _shipped:
        return
    # the driver serves the file to executors as long as it lives
    folder = tempfile.mkdtemp(prefix="pagelayout-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "pagelayout"), "zip", root, os.path.basename(home)))
    _shipped.add(app)
