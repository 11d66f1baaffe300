"""The package itself, sent to workers that cannot import it."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import hirelake
from hirelake.llm import files
from hirelake.session import shared_dir

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: puts the package's sources into the shared folder and on the workers' path.

    A session started elsewhere than in the repository, without it in PYTHONPATH, needs this for the
    functions that run in tasks.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(hirelake.__file__).parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent).as_posix())
    path = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}.zip"
    system, folder = files.opened(path.rpartition("/")[0])
    system.create_dir(folder, recursive=True)
    with files.output(path) as stream:
        stream.write(held.getvalue())
    context.addPyFile(path)
    _sent.add(context.applicationId)
