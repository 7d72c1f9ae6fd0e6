"""Java functions for work that is a loop over single values, node by node, and so neither a column
expression nor an array operation.

Their source lies beside this file.  Spark's own compiler (Janino, part of every Spark) compiles
it on the driver; the classes go into a jar in the shared scratch folder, which executors fetch.
"""

from __future__ import annotations

import io
import pkgutil
import threading
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.sources.files import scratch_path

_added: set[tuple[str, str]] = set()       # (application, class)
_adding = threading.Lock()


def _add(spark: SparkSession, name: str) -> None:
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(pkgutil.get_data(__name__, f"{name}.java").decode())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as jar:
        for found, code in compiler.getBytecodes().items():
            jar.writestr(f"{found.replace('.', '/')}.class", bytes(code))
    path = f"{scratch_path(spark, name)}.jar"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    spark.sql(f"ADD JAR '{path}'")


def with_call(df: DataFrame, column: str, name: str, args: list[str]) -> DataFrame:
    """``df`` with the binary result of the two-argument Java function ``name``."""
    spark = df.sparkSession
    with _adding:
        if (spark.sparkContext.applicationId, name) not in _added:
            _add(spark, name)
            _added.add((spark.sparkContext.applicationId, name))
    made = spark._jsparkSession.sharedState().jarClassLoader().loadClass(f"prismlake.{name}")
    none = spark.sparkContext._gateway.new_array
    instance = made.getDeclaredConstructor(none(spark._jvm.java.lang.Class, 0)).newInstance(none(spark._jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(name, instance, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL("binary"))
    return df.withColumn(column, F.call_function(name, *args))
