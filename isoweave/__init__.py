"""isoweave: gridded, time-resolved data as DataFrames."""

from pathlib import Path


def reachable(spark: object) -> None:
    """Puts this package's folder on the path of the Python workers that later functions start, wherever the session was started."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    path = environment.get("PYTHONPATH", "")
    if root not in path.split(":"):
        environment["PYTHONPATH"] = f"{root}:{path}" if path else root
