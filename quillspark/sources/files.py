"""Files in folders that driver and executors share, as a task handles them."""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, content: bytes) -> None:
    """Writes a file as a whole or not at all: under a name of its own first. Doing it again changes nothing."""
    system, at = filesystem(folder)
    system.create_dir(at, recursive=True)
    part = f"{at}/.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(part, compression=None) as out:
            out.write(content)
        system.move(part, f"{at}/{name}")
    except BaseException:
        remove(folder, part.rsplit("/", 1)[-1])
        raise


def move(source: str, target: str, name: str) -> None:
    """Moves a file between folders of one file system; one that has been moved already stays."""
    (system, a), (_, b) = filesystem(source), filesystem(target)
    if system.get_file_info(f"{a}/{name}").type != fs.FileType.NotFound:
        system.move(f"{a}/{name}", f"{b}/{name}")
    elif system.get_file_info(f"{b}/{name}").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{source}/{name}")


def remove(folder: str, name: str) -> bool:
    """Whether the file was there."""
    system, at = filesystem(folder)
    if system.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
        return False
    system.delete_file(f"{at}/{name}")
    return True
