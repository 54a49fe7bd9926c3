"""Differences between two nested results, with a tolerance for numbers: for tests and for comparing runs."""

from __future__ import annotations

from collections.abc import Iterator


def differences(a, b, tolerance: float = 1e-4, path: str = "") -> Iterator[tuple[str, object, object]]:
    """(path, left, right) of every place where two values of dicts, lists, numbers and texts differ."""
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if number(a) and number(b):
        if abs(a - b) > tolerance:
            yield path, a, b
    elif isinstance(a, dict) and isinstance(b, dict):
        for key in dict.fromkeys([*a, *b]):
            if key in a and key in b:
                yield from differences(a[key], b[key], tolerance, f"{path}.{key}")
            else:
                yield f"{path}.{key}", a.get(key), b.get(key)
    elif isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            yield f"{path}.length", len(a), len(b)
        for i, (x, y) in enumerate(zip(a, b, strict=False)):
            yield from differences(x, y, tolerance, f"{path}[{i}]")
    elif a != b:
        yield path, a, b
