"""Session settings that the plans rely on."""

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "foliospark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers need no installation."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        import atexit
        import shutil
        import tempfile
        from pathlib import Path

        package = Path(__file__).resolve().parent
        if package.is_dir():
            folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            context.addPyFile(shutil.make_archive(f"{folder}/foliospark_package", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
    return spark
