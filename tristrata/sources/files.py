"""Folders on whatever file system Hadoop knows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none when it does not exist."""
    fs, hadoop_path = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []


def read_text(spark: SparkSession, path: str) -> str:
    """Content of a small file."""
    fs, hadoop_path = _file_system(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def modified_at(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 at which a file or folder was changed last."""
    fs, hadoop_path = _file_system(spark, path)
    return fs.getFileStatus(hadoop_path).getModificationTime() / 1000


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is either there as a whole or not at all; raises FileExistsError if it exists.

    Of several writers one succeeds: HDFS does not rename onto a file, and on a local disk a link to one is refused. A
    store whose renames replace files has one writer only.
    """
    fs, hadoop_path = _file_system(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(hadoop_path.getParent(), f".{hadoop_path.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            nio = spark._jvm.java.nio.file
            source, target = (nio.Paths.get(fs.makeQualified(p).toUri()) for p in (hidden, hadoop_path))
            try:
                nio.Files.createLink(target, source)
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise
                raise FileExistsError(path) from error
        elif fs.exists(hadoop_path) or not fs.rename(hidden, hadoop_path):
            raise FileExistsError(path)
    finally:
        fs.delete(hidden, False)
