"""Contents of files as rows of bounded parts.

``binaryFile`` gives a file as one value, which ends at 2 GB and is held several times
over by its task.  Spark has no reader of a file's ranges, and Python workers do not
reach its file systems, so the reader and the digest are the Java functions in
``FileParts.java``: the driver compiles them with the compiler that Spark brings for
its generated code (no JDK needed) and adds them to the session once.
"""

from __future__ import annotations

import hashlib
import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PART_BYTES = 256 << 10                     # below half a G1 region, whatever the heap


def _java(spark: SparkSession, name: str, *args):
    """An instance of a class of ``FileParts.java``."""
    source = pkgutil.get_data("stagecraft.sources", "FileParts.java")
    jar = f"stagecraft-{hashlib.sha256(source).hexdigest()[:16]}.jar"
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    if jar not in spark._jsc.sc().listJars().mkString(","):
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(loader)
        compiler.cook(source.decode())
        path = os.path.join(tempfile.mkdtemp(prefix="stagecraft-jar-"), jar)
        with zipfile.ZipFile(path, "w") as z:
            for c, code in compiler.getBytecodes().items():
                z.writestr(c.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{path}'")
    given = spark._sc._gateway.new_array(spark._jvm.Object, len(args))
    for i, a in enumerate(args):
        given[i] = a
    return loader.loadClass(name).getConstructors()[0].newInstance(given)


def _partitions(df: DataFrame, function, fields: list[T.StructField]) -> DataFrame:
    spark = df.sparkSession
    schema = spark._jsparkSession.parseDataType(T.StructType(fields).json())
    return DataFrame(df._jdf.mapPartitions(function, spark._jvm.org.apache.spark.sql.Encoders.row(schema)), spark)


def read_parts(files: DataFrame, path: str, size: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``files`` with a row per part: ``offset`` and ``content``, at most ``part_bytes``
    of the file at ``path`` (``size`` bytes long).  The parts of a file are in order and
    in one partition; an empty file has one empty part."""
    if part_bytes < 1:
        raise ValueError("part_bytes must be positive")
    spark = files.sparkSession
    conf = spark._jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    reader = _java(spark, "stagecraft.FileParts", spark._jsc.broadcast(conf), files.columns.index(path),
                   files.columns.index(size), part_bytes)
    return _partitions(files, reader, [*files.schema.fields, T.StructField("offset", T.LongType()),
                                       T.StructField("content", T.BinaryType())])


def md5_of_parts(parts: DataFrame, *names: str, size: str = "size") -> DataFrame:
    """(``names``, ``size``, ``md5``) per file of ``read_parts`` rows, as ``md5(content)``
    of the whole file.  One file is digested by the task that reads it, a part at a time
    (MD5 takes its bytes in order); parts that were dealt anew raise an error."""
    rows = parts.select(*names, size, "offset", "content")
    return _partitions(rows, _java(parts.sparkSession, "stagecraft.FileParts$Md5"),
                       [*rows.schema.fields[:-2], T.StructField("md5", T.StringType())])
