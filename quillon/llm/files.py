"""Files in the shared folder, written and read by executors through pyarrow's file systems."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file that appears under its name only when it is complete: written beside it, moved when closed without error."""

    def __init__(self, uri: str):
        self.fs, self.path = place(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.part = f"{posixpath.dirname(self.path)}/.{posixpath.basename(self.path)}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None, buffer_size=1 << 20)
        self.at = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.at += len(data)

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            try:
                self.fs.move(self.part, self.path)
            except OSError:  # a file system that does not replace: an earlier run of the task left the same file
                self.fs.delete_file(self.path)
                self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def open_file(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
