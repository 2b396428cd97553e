"""A list of commits: numbered small files, each created once, by whoever comes first."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitList:
    """Commits under ``path``, in any store that Spark writes to.

    A commit is written apart and then renamed to its number, which fails where that exists
    already; in a store whose rename is one step no two writers can create the same number,
    and no reader sees half a commit. A reader that keeps what :meth:`newest` gave it is not
    touched by later commits.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def newest(self) -> tuple[int, dict | None]:
        """The newest commit and its number; 0 and none before the first."""
        folder = self._file(f"{self.path}/commits")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return 0, None
        names = [status.getPath().getName() for status in store.listStatus(folder)]
        number = max((int(name) for name in names if name.isdigit()), default=0)
        if not number:
            return 0, None
        text = self.spark.read.text(f"{self.path}/commits/{number:09}", wholetext=True).first()["value"]
        return number, json.loads(text)

    def create(self, number: int, content: dict) -> bool:
        """Whether the commit of that number could be created."""
        draft, target = self._file(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._file(
            f"{self.path}/commits/{number:09}")
        store = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        draft, target = store.makeQualified(draft), store.makeQualified(target)
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        store.mkdirs(target.getParent())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.toString():
                return False
            raise
        return True
