"""Small control files under a store's path, on any file system that pyarrow opens."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


class Files:
    """Read, list, create once and replace files below a root path or URI."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        uri = self.root if "://" in self.root or self.root.startswith("file:") else "file://" + os.path.abspath(self.root)
        self.uri = uri
        self.fs, self.base = fs.FileSystem.from_uri(uri)

    def read(self, path: str) -> str | None:
        """The text of a file, None if there is none."""
        try:
            with self.fs.open_input_stream(f"{self.base}/{path}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def list(self, path: str, recursive: bool = False) -> list[str]:
        """Files below a folder, in order of name, relative to the root."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{path}", recursive=recursive, allow_not_found=True))
        return sorted(os.path.relpath(x.path, self.base) for x in found if x.is_file)

    def _temporary(self, path: str, text: str) -> str:
        folder = f"{self.base}/{os.path.dirname(path)}"
        self.fs.create_dir(folder, recursive=True)
        name = f"{folder}/.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(name) as f:
            f.write(text.encode())
        return name

    def create(self, path: str, text: str) -> bool:
        """Make a file with this text, whole; False if it is there already (another writer was first)."""
        temporary, final = self._temporary(path, text), f"{self.base}/{path}"
        if isinstance(self.fs, fs.LocalFileSystem):
            try:
                os.link(temporary, final)  # fails if the name is taken
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
        if self.fs.get_file_info(final).type != fs.FileType.NotFound:
            self.fs.delete_file(temporary)
            return False
        try:
            self.fs.move(temporary, final)  # does not replace on HDFS
            return True
        except OSError:
            return False

    def replace(self, path: str, text: str) -> None:
        self.fs.move(self._temporary(path, text), f"{self.base}/{path}")

    def delete(self, path: str) -> None:
        try:
            self.fs.delete_file(f"{self.base}/{path}")
        except FileNotFoundError:
            pass
