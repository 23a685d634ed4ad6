"""Manifests: numbered JSON files that say which folders make up a stored table.

A run writes folders that no manifest names yet and then publishes the next manifest, which is there as a whole or not
at all. Of several writers that publish one number a single one succeeds; the others read what it made of the table and
try the next number, or repeat their run. The last two manifests stay readable. What only older ones name is removed;
folders that no manifest ever named belong to runs that are under way, or that broke off: ``remove_strays`` is for those.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from tristrata.sources.files import delete_path, folder_names, modified_at, publish_text, read_text

#: Manifests that stay readable.
KEPT = 2


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = folder_names(spark, f"{path}/manifests")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _file(path: str, number: int) -> str:
    return f"{path}/manifests/{number:012d}.json"


def newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; 0 and nothing before the first."""
    while numbers := _numbers(spark, path):
        try:
            return numbers[-1], json.loads(read_text(spark, _file(path, numbers[-1])))
        except Exception as error:  # removed meanwhile, as two newer ones came
            if "FileNotFound" not in str(error) or _numbers(spark, path)[-1:] == numbers[-1:]:
                raise
    return 0, {}


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Publish manifest ``number``; raises FileExistsError if another writer has."""
    publish_text(spark, _file(path, number), json.dumps(content))


def remove_unnamed(spark: SparkSession, path: str, folders: Callable[[dict], Iterable[str]]) -> None:
    """Remove all manifests but the last two, and ``folders`` below ``path`` that only those name."""
    numbers = _numbers(spark, path)
    named = {f for n in numbers[-KEPT:] for f in folders(json.loads(read_text(spark, _file(path, n))))}
    for n in numbers[:-KEPT]:
        for folder in set(folders(json.loads(read_text(spark, _file(path, n))))) - named:
            delete_path(spark, f"{path}/{folder}")
        delete_path(spark, _file(path, n))


def remove_strays(spark: SparkSession, path: str, parents: Iterable[str], folders: Callable[[dict], Iterable[str]], older_than_hours: float = 24) -> list[str]:
    """Remove folders below the ``parents`` that no manifest names and that have not changed for that long."""
    named = {f for n in _numbers(spark, path) for f in folders(json.loads(read_text(spark, _file(path, n))))}
    parts = {f[:i] for f in named for i in range(len(f) + 1) if i == len(f) or f[i] == "/"}
    strays = [f"{parent}/{name}" for parent in parents for name in folder_names(spark, f"{path}/{parent}") if f"{parent}/{name}" not in parts]
    old = [s for s in strays if modified_at(spark, f"{path}/{s}") < time.time() - 3600 * older_than_hours]
    for stray in old:
        delete_path(spark, f"{path}/{stray}")
    return old
