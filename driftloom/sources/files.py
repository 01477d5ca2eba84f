"""Small text files beside Spark's tables, through the file systems that Spark itself uses, so that both lie in one place on a cluster too."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _place(path: str):
    """(file system, path) of the active session; local files are read and written as they are, without checksum files beside them."""
    spark = SparkSession.active()
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    own = fs.Path(str(path))
    system = own.getFileSystem(conf)
    return (fs.FileSystem.getLocal(conf).getRawFileSystem() if system.getUri().getScheme() == "file" else system), own


def write_text(path: str, text: str) -> None:
    """Write a file by renaming a new one, so that readers never see half of it; folders are made."""
    system, own = _place(path)
    new = own.suffix(".new")
    out = system.create(new, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    system.delete(own, False)
    if not system.rename(new, own):
        raise OSError(f"cannot write {path}")


def create_text(path: str, text: str) -> bool:
    """Make a file with all its text at once, unless there is one: then False. Of several callers one succeeds, where a rename never replaces a file."""
    system, own = _place(path)
    new = f"{path}.{uuid.uuid4().hex}"
    write_text(new, text)
    try:
        if system.getUri().getScheme() == "file":  # there renaming would replace it, and a link does not
            try:
                os.link(_place(new)[1].toUri().getPath(), own.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not system.exists(own) and system.rename(_place(new)[1], own)
    finally:
        remove(new)


def move(path: str, to: str) -> None:
    """Put a file or folder in the place of another, which goes if it is there."""
    system, own = _place(to)
    system.mkdirs(own.getParent())
    system.delete(own, True)
    if not system.rename(_place(path)[1], own):
        raise OSError(f"cannot move {path} to {to}")


def listing(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files below a path, or of the file that it is, but for hidden ones."""
    system, own = _place(path)
    found, left = [], [system.getFileStatus(own)]
    while left:
        at = left.pop()
        if at.isDirectory():
            left += [x for x in system.listStatus(at.getPath()) if x.getPath().getName()[0] not in "._"]
        else:
            found.append((at.getPath().toString(), at.getLen(), at.getModificationTime()))
    return found


def read_text(path: str) -> str:
    system, own = _place(path)
    if not system.exists(own):
        raise FileNotFoundError(path)
    found = system.open(own)
    try:
        return SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()


def absolute(path: str) -> str:
    system, own = _place(path)
    return system.makeQualified(own).toString()


def exists(path: str) -> bool:
    system, own = _place(path)
    return system.exists(own)


def remove(path: str) -> None:
    """Remove a file or a folder with all it holds, if it is there."""
    system, own = _place(path)
    system.delete(own, True)


def names(path: str) -> list[str]:
    """The names of a folder's members."""
    system, own = _place(path)
    return sorted(x.getPath().getName() for x in system.listStatus(own))
