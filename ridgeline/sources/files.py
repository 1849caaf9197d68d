"""Binary files on any store that pyarrow reaches, written whole by the task that made them."""

from __future__ import annotations

import uuid

from pyarrow import fs


def save(folder: str, name: str, data: bytes) -> str:
    """Writes ``folder/name``; a repeated task writes the same bytes to the same name."""
    files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder.rstrip('/')}/{name}"


class Ranges:
    """A file that is open for reads by range."""

    def __init__(self, file):
        self.file = file

    def read_at(self, size: int, offset: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def open_at(path: str) -> Ranges:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return Ranges(files.open_input_file(inner))


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def join_files(path: str, pieces: list[bytes | str], chunk: int = 8 << 20) -> int:
    """One file of pieces, bytes or paths of files, in order; returns its size.

    It is copied under another name and moved when it is whole; what failed leaves nothing.
    Stores write a file from its start, so one process copies it, a chunk at a time.
    """
    files, target = _at(path)
    parent, _, name = target.rpartition("/")
    files.create_dir(parent or "/", recursive=True)
    hidden = f"{parent}/.{name}.{uuid.uuid4().hex}"
    try:
        with files.open_output_stream(hidden, compression=None) as out:
            for piece in pieces:
                if isinstance(piece, bytes):
                    out.write(piece)
                    continue
                source, inner = _at(piece)
                with source.open_input_stream(inner, compression=None) as part:
                    while data := part.read(chunk):
                        out.write(data)
            size = out.tell()
        files.move(hidden, target)
    except BaseException:
        if files.get_file_info(hidden).type != fs.FileType.NotFound:
            files.delete_file(hidden)
        raise
    return size


def remove(folder: str) -> None:
    files, path = _at(folder)
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)


def names_in(folder: str) -> list[str]:
    """Names of what a folder holds; none where it isn't there."""
    files, path = _at(folder)
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def size_of(path: str) -> int:
    files, inner = _at(path)
    info = files.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size
