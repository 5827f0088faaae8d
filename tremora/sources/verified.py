"""Pinned research files: a git blob checksum gates what is written, and nothing else is."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremora.sources.fdsn import fetch


def blob_sha1(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def blob_sha1_column(content: Column) -> Column:
    """The same for a binary column."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def download_verified(url: str, expected: str, target: Path, get: Callable[[str], bytes] = fetch) -> Path:
    """One file, written only if its checksum is the pinned one."""
    content = get(url)
    if blob_sha1(content) != expected:
        raise ValueError(f"checksum of {url} is not the pinned one")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content)
    return target
