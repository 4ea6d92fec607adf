"""Gives executors this package, for sessions whose Python workers cannot import it by path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors of this session, once (sc.addPyFile)."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="postsieve-")) / "postsieve_sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, f"{home.name}/{source.relative_to(home)}")
        top = home.parent / "corpus_pipeline.py"
        if top.exists():
            z.write(top, top.name)
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
