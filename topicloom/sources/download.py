"""Model files, checked against a digest and put in place at once."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.request


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def fetch(url: str, path: str, digest: str | None = None) -> str:
    """Downloads to ``path`` unless it is there already; a wrong digest is tried once more, then raises."""
    if os.path.exists(path) and (digest is None or sha256(path) == digest):
        return path
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    for last in (False, True):
        handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        os.close(handle)
        try:
            urllib.request.urlretrieve(url, part)
            if digest is None or sha256(part) == digest:
                os.replace(part, path)
                return path
            if last:
                raise ValueError(f"{url} doesn't have the digest {digest}")
        finally:
            if os.path.exists(part):
                os.remove(part)
    return path
