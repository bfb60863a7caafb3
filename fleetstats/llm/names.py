"""Internal column names that no table can clash with."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name, with underscores added until it differs from all taken ones; case does not tell names apart."""
    seen = {name.lower() for name in taken}
    out = []
    for name in wanted:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out
