"""File systems by path, through Arrow: file, hdfs, s3, gs and plain local paths."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import pyarrow.fs as pafs


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it)."""
    if re.match(r"^file:/+", path):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", path).rstrip("/")
    if "://" in path:
        fs, at = pafs.FileSystem.from_uri(path)
        return fs, at.rstrip("/")
    return pafs.LocalFileSystem(), path.rstrip("/")


def listed(fs: pafs.FileSystem, folder: str, deep: bool = False) -> list[pafs.FileInfo]:
    """What a folder holds, by path; nothing if it isn't there."""
    return sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=deep)), key=lambda f: f.path)


def packed(files: list[tuple[int, tuple]], most_bytes: int, most_files: int) -> list[list[tuple]]:
    """Runs of files of so many bytes together, or so many files, at most; a larger file is alone."""
    out: list[list[tuple]] = []
    size = 0
    for n, f in files:
        if not out or size + n > most_bytes or len(out[-1]) == most_files:
            out.append([])
            size = 0
        out[-1].append(f)
        size += n
    return out


def as_folder(unit: str) -> str:
    """A unit's id as the name of a folder; unit_of takes it back. No name begins with a dot or an underscore."""
    name = quote(unit, safe=" +,=@-")
    return name.replace(".", "%2E").replace("_", "%5F")


def unit_of(folder: str) -> str:
    return unquote(folder)
