"""Files that tasks write to the shared folder, next to the tables that Spark writes.

A task names its file anew in every attempt and reports it in its output rows. Only rows of
successful attempts reach the staged manifest, so files of lost or repeated attempts are
never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

from worksrisk.session import Staging


def new_file(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def open_new(uri: str):
    """A stream to write; folders above are made. Any store that Arrow reaches by URI."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_stream(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def open_random(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def folder(stage: Staging, name: str) -> str:
    """A folder for tasks' files, as a URI that Arrow understands."""
    path = stage.path(name)
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not \
        path.startswith("file:///") else path


def one_task_each(manifest: DataFrame, n_files: int) -> DataFrame:
    """Rows of a manifest (one per file) dealt out so that files are read side by side."""
    return manifest.repartition(max(1, n_files))
