"""Opening files inside tasks, on any file system Arrow knows."""

from __future__ import annotations


def _place(path: str):
    from pyarrow import fs

    plain = path[5:] if path.startswith("file:") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)


def open_stream(path: str):
    """A file to read from its start to its end."""
    system, inner = _place(path)
    return system.open_input_stream(inner)


def open_file(path: str):
    """A file to seek in."""
    system, inner = _place(path)
    return system.open_input_file(inner)
