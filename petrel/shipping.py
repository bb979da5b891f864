"""Makes the package importable in Python workers, whatever their search path is."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, which shares its folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application, by way of the shared folder if there is one."""
    context = spark.sparkContext
    if getattr(context, "_petrel_shipped", False):
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{shared or 'file://' + tempfile.gettempdir()}/petrel/source-{uuid.uuid4().hex}"
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/petrel_src.zip", compression=None) as out:
        out.write(data.getvalue())
    context.addPyFile(f"{folder}/petrel_src.zip")
    context._petrel_shipped = True
