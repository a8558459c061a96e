"""Small files (catalogs, logs) on any file system that Arrow knows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``, which the cluster shares. For a local
    master without that setting, as in tests, a temporary folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def read_text(uri: str) -> str | None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as src:
        return src.read().decode()


def replace_text(uri: str, text: str) -> None:
    """Write a file whole: readers see the old one or the new one."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(text.encode())
    fs.move(temporary, path)


def create_text(uri: str, text: str) -> bool:
    """Write a file whole, unless it is there already: of several writers one succeeds.

    On a local file system a hard link decides; elsewhere, whoever looks first (object stores with
    one writer at a time, as the leader rule has it).
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(text.encode())
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(temporary, path)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete_file(temporary)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(temporary)
        return False
    fs.move(temporary, path)
    return True


def remove_file(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        fs.delete_file(path)


def copy_tree(source: str, target: str) -> None:
    """Copy a folder, file by file."""
    (fs, path), (to, where) = filesystem(source), filesystem(target)
    to.create_dir(where, recursive=True)
    pafs.copy_files(path, where, source_filesystem=fs, destination_filesystem=to)


def listed(uri: str) -> list[str]:
    """Names of the files in a folder, sorted; none if there is no folder."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return []
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File)


def remove_tree(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
