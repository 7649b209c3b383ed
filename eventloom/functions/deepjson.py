"""JSON text of any depth: the standard reader and writer follow some thousand levels only."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from contextlib import contextmanager

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.S)


# Built once: the standard call makes a writer per text.
_encode = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


def dump(value: object) -> str:
    """Canonical JSON: sorted keys, no spaces."""
    try:
        return _encode(value)
    except RecursionError:
        return _write(value)


def load(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return _read(text)


def _read(text: str) -> object:
    """Well-formed JSON onto a stack of open lists and objects."""
    open_: list = [[]]
    names: list[str | None] = []
    for token in _TOKEN.findall(text):
        if token in ",:":
            continue
        if token in "]}":
            value = open_.pop()
            name = names.pop()
        elif token in "[{":
            open_.append([] if token == "[" else {})
            names.append(None)
            continue
        elif isinstance(open_[-1], dict) and names[-1] is None:
            names[-1] = json.loads(token)
            continue
        else:
            value, name = json.loads(token), None
        if isinstance(open_[-1], dict):
            open_[-1][names[-1]] = value
            names[-1] = None
        else:
            open_[-1].append(value)
    return open_[0][0]


def _write(value: object) -> str:
    out: list[str] = []
    todo: list = [value]
    plain = object()  # marks a text that is written as it is
    while todo:
        v = todo.pop()
        if isinstance(v, tuple) and v and v[0] is plain:
            out.append(v[1])
        elif isinstance(v, (list, dict)):
            rows = [("", x) for x in v] if isinstance(v, list) else [(json.dumps(k, ensure_ascii=False) + ":", v[k]) for k in sorted(v)]
            ends = "[]" if isinstance(v, list) else "{}"
            todo.append((plain, ends[1]))
            for k in range(len(rows) - 1, -1, -1):
                head, x = rows[k]
                todo += [x, (plain, ("," if k else "") + head)]
            todo.append((plain, ends[0]))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


@contextmanager
def deep(levels: int):
    """Room for Python functions that call themselves so many times."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, levels + 1_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def apply_deep(fn: Callable, text: str, *rest):
    """``fn`` of a value read from a text, written again; recursion as deep as the text can be."""
    value = load(text)
    try:
        return dump(fn(value, *rest))
    except RecursionError:
        # Each level is a bracket of the text, or a step of the type.
        with deep(4 * len(text) + 10_000):
            return dump(fn(value, *rest))
