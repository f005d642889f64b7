"""Object keys and URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_path(*parts: str | None) -> str:
    """Join with exactly one ``/`` between parts; the first part may be absolute or a URI."""
    kept = [p for p in parts if p]
    if not kept:
        return ""
    head = kept[0].rstrip("/") or "/"
    tail = [p.strip("/") for p in kept[1:] if p.strip("/")]
    return "/".join([head.rstrip("/"), *tail]) if tail else head


def uri_container(uri: Column) -> Column:
    """Third ``/``-separated part: the container name in ``scheme://container/key``."""
    return F.try_element_at(F.split(uri, "/"), F.lit(3))


def is_inside(path: str, root: str) -> bool:
    """Whether ``path`` is ``root`` or lies below it."""
    return f"{path.rstrip('/')}/".startswith(f"{root.rstrip('/')}/")
