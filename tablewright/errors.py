"""Errors raised on the driver, before any Spark job runs."""

from __future__ import annotations

import re
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import quote, unquote

_node: ContextVar[str | None] = ContextVar("node", default=None)
_MARK = re.compile(r"\[node=([^\]]*)\]")


@contextmanager
def building(node: str):
    """Data errors of expressions made in this context name the node."""
    token = _node.set(node)
    try:
        yield
    finally:
        _node.reset(token)


def marked(message: str) -> str:
    node = _node.get()
    return message if node is None else f"{message} [node={quote(node, safe='')}]"


def marked_node(message: str) -> str | None:
    """The node that a task's error names."""
    found = _MARK.search(message)
    return unquote(found[1]) if found else None


class TabularError(ValueError):
    """A request that does not fit its input schema, with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class LimitExceeded(TabularError):
    """An opt-in row, group or key budget was passed."""
