"""A folder elsewhere, by any URI that the cluster's file systems know: what a sync needs of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LISTING = "path string, name string, is_dir boolean, size long, modified_ms long"


class Remote:
    """Operations under one root. Paths are relative to it and may not leave it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):  # noqa: ANN202
        if ".." in path.split("/"):
            raise ValueError(f"{path} leaves the root")
        return self._fs.Path(f"{self.root}/{path.lstrip('/')}" if path.strip("/") else self.root)

    def _files(self, path):  # noqa: ANN001, ANN202
        return path.getFileSystem(self._conf)

    def ping(self) -> bool:
        """Whether the root can be reached and is there."""
        try:
            p = self._path("")
            return self._files(p).exists(p)
        except Exception:  # noqa: BLE001
            return False

    def make(self, path: str = "") -> None:
        """The folder and all above it."""
        p = self._path(path)
        self._files(p).mkdirs(p)

    def properties(self, path: str) -> dict | None:
        p = self._path(path)
        if not self._files(p).exists(p):
            return None
        s = self._files(p).getFileStatus(p)
        return {"path": path, "name": s.getPath().getName(), "is_dir": s.isDirectory(), "size": s.getLen(), "modified_ms": s.getModificationTime()}

    def listed(self, path: str = "", create: bool = False) -> DataFrame:
        """path, name, is_dir, size, modified_ms of a folder's entries; a missing folder is made if asked for, and empty."""
        p = self._path(path)
        if not self._files(p).exists(p):
            if not create:
                raise FileNotFoundError(path)
            self.make(path)
        rows = [(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in self._files(p).listStatus(p)]
        return self.spark.createDataFrame(rows, _LISTING)

    def write(self, path: str, content: bytes) -> None:
        """Puts a small file there, in place of one of that name."""
        p = self._path(path)
        out = self._files(p).create(p, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def upload(self, local: str, path: str, replace: bool = True) -> None:
        p = self._path(path)
        self._files(p).copyFromLocalFile(False, replace, self._fs.Path(local), p)

    def download(self, path: str, local: str) -> None:
        p = self._path(path)
        self._files(p).copyToLocalFile(False, p, self._fs.Path(local), True)

    def remove(self, path: str) -> bool:
        p = self._path(path)
        return self._files(p).delete(p, True)


def apply(remote: Remote, plan: DataFrame, local: str, folder: str) -> dict[str, int]:
    """Carries out a sync plan (name, action) between a local folder and a remote one; how often each action was done.

    Rows come one at a time; a few files are moved at once. Names come from both sides, so one that is more than a file's name is refused before anything is done with it.
    """
    import os
    from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

    def do(name: str, action: str) -> str:
        if name in ("", ".", "..") or "/" in name or "\\" in name or "\0" in name:
            raise ValueError(f"{name!r} is no file name")
        if action == "upload":
            remote.upload(os.path.join(local, name), f"{folder}/{name}")
        elif action == "download":
            remote.download(f"{folder}/{name}", os.path.join(local, name))
        if action in ("deleteRemote", "deleteBoth"):
            remote.remove(f"{folder}/{name}")
        if action in ("deleteLocal", "deleteBoth"):
            os.remove(os.path.join(local, name))
        return action

    done: dict[str, int] = {}
    going: set[Future[str]] = set()

    def settle(some: set[Future[str]]) -> None:
        for f in some:
            action = f.result()
            done[action] = done.get(action, 0) + 1

    with ThreadPoolExecutor(8) as pool:
        for r in plan.toLocalIterator():
            if len(going) >= 32:
                some, going = wait(going, return_when=FIRST_COMPLETED)
                settle(some)
            going.add(pool.submit(do, r["name"], r["action"]))
        settle(going)
    return done
