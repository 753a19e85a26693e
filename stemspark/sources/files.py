"""Files wherever the executors see them: local paths, and URIs of the file systems that pyarrow opens (file, hdfs, s3, gs and so on)."""

from __future__ import annotations

import fnmatch
import hashlib

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def size_of(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    system, own = located(path)
    info = system.get_file_info(own)
    return info.size if info.type == fs.FileType.File else None


def listed(pattern: str, suffix: str = "") -> list[str]:
    """The files of a folder (those that end with the suffix), or those whose name matches a pattern, in name order."""
    system, own = located(pattern)
    prefix = pattern[: len(pattern) - len(own)] if pattern.endswith(own) else ""
    if system.get_file_info(own).type == fs.FileType.Directory:
        folder, name = own, f"*{suffix}"
    else:
        folder, _, name = own.rpartition("/")
    found = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, name))


def read_range(path: str, start: int, size: int) -> bytes:
    system, own = located(path)
    with system.open_input_file(own) as f:
        f.seek(start)
        return f.read(size)


def write_whole(path: str, parts, mark: str = "") -> None:
    """Bytes, part by part, under a temporary name that is then moved: a reader sees all of a file or none. mark tells attempts apart."""
    system, own = located(path)
    system.create_dir(own.rpartition("/")[0] or ".", recursive=True)
    with system.open_output_stream(f"{own}{mark}.tmp") as out:
        for part in parts:
            out.write(part)
    system.move(f"{own}{mark}.tmp", own)


def sha256_of(path: str, block: int = 1 << 20) -> str:
    """Of a file of any size, block by block."""
    system, own = located(path)
    found = hashlib.sha256()
    with system.open_input_stream(own) as f:
        while part := f.read(block):
            found.update(part)
    return found.hexdigest()
