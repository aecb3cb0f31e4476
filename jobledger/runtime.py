"""Makes the library importable in Python workers."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Bytes of one batch that goes to a Python worker, where the session has Spark's default of 64 MB: long texts then can't fill a worker.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_KEY).rstrip("b") == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a Spark context; the driver serves the file itself."""
    context = spark.sparkContext
    bound_batches(spark)
    if getattr(context, "_jobledger_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="jobledger")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
        top = importlib.util.find_spec("corpus_pipeline")
        if top and top.origin:
            z.write(top.origin, "corpus_pipeline.py")
    context.addPyFile(str(target))
    context._jobledger_shipped = True
