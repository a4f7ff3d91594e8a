"""Files that tasks write and read directly, in the shared folder or any store that pyarrow can open by its URI."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str):
    """File system and path of a URI; a plain path is a local one."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def whole(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_stream(path) as file:
        return file.read()


def random_access(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)
