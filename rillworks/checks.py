"""Checks of arguments on the driver."""

from __future__ import annotations

from typing import Any


def text(name: str, value: Any) -> str:
    """A text that is not empty."""
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} must be a text that is not empty")
    return value


def texts(name: str, value: Any) -> list[str]:
    """A list, not empty, of texts that are not empty."""
    if not isinstance(value, list) or not value:
        raise ValueError(f"{name} must be a list that is not empty")
    return [text(f"{name}[{i}]", v) for i, v in enumerate(value)]


def mapping(name: str, value: Any) -> dict[str, str]:
    """A dict, not empty, from and to texts that are not empty."""
    if not isinstance(value, dict) or not value:
        raise ValueError(f"{name} must be a dict that is not empty")
    return {text(f"a key of {name}", k): text(f"{name}[{k!r}]", v) for k, v in value.items()}
