"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can
    import it wherever they run and whatever their path is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="quillwork-package-"))  # the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "quillwork_package.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(folder / "quillwork_package.zip"))
    _shipped.add(context.applicationId)
