"""CSV folders."""

from __future__ import annotations

import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schemas

#: Quotes are doubled and fields may hold line feeds, as other CSV tools write them.
CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a CSV file or folder. Large files are read in splits, unless a field holds a line break: then some line
    has an odd number of quotes, and each file is read whole in one task. A pass over the lines tells."""
    line = F.col("value")
    odd = F.pmod(F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))), F.lit(2)) == 1
    blank = (line != "") & line.rlike(r"^[\x00-\x20]+$")  # lost where lines are split first
    several = not spark.read.text(path).where(odd | blank).isEmpty()
    return spark.read.schema(schema).options(**(CSV | {"multiLine": str(several).lower()})).csv(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs become JSON, as CSV has no place for them."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(path)


def replace_csv(df: DataFrame, path: str) -> None:
    """Write the rows beside ``path``, which they may be read from, and swap the two once all are written."""
    spark, aside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    write_csv(df, f"{aside}.new")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    now, old, new = hadoop(path), hadoop(f"{aside}.old"), hadoop(f"{aside}.new")
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(now)
    if had and not fs.rename(now, old):
        raise OSError(f"cannot move {path}")
    try:
        done = fs.rename(new, now)
    except Py4JJavaError:
        done = False
    if not done:
        if had:
            fs.rename(old, now)
        raise OSError(f"cannot replace {path}")
    fs.delete(old, True)


def listing_name(rows: int, now: datetime, stem: str = "documents") -> str:
    return f"{stem}_{rows}docs_{now:%Y%m%d_%H%M%S}.csv"


# The two sample rows of a document listing.
SAMPLE = [
    ("September 29, 2024", "Remarks by the Vice President at a Campaign Event in Las Vegas, Nevada", "{site}/documents/remarks-the-vice-president-campaign-event-las-vegas-nevada-0", "Kamala Harris", "{site}/people/other/kamala-harris", 1, 0),
    ("September 27, 2024", "Remarks by the Vice President at a Campaign Event in Douglas, Arizona", "{site}/documents/remarks-the-vice-president-campaign-event-douglas-arizona", "Kamala Harris", "{site}/people/other/kamala-harris", 1, 0),
]


def sample_listing(spark: SparkSession, site: str) -> DataFrame:
    return spark.createDataFrame([tuple(v.format(site=site) if isinstance(v, str) else v for v in row) for row in SAMPLE], schemas.DOCUMENT_LISTING)
