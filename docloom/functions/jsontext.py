"""Strict JSON reading that also copes with nesting of any depth."""

from __future__ import annotations

import json
import re


class Invalid(ValueError):
    """The text is no JSON."""


def _refuse(name: str) -> object:
    raise Invalid(name)


_decoder = json.JSONDecoder(parse_constant=_refuse)
_token = re.compile(r'[ \t\n\r]*(?:([\[\]{}:,])|"((?:[^"\\\x00-\x1f]|\\.)*)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.ASCII)


def loads(text: str | None) -> object:
    """The parsed value; ``Invalid`` for null, blank or broken text, NaN and infinities."""
    if text is None:
        raise Invalid("null")
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _flat(text)
    except (ValueError, OverflowError) as e:
        raise Invalid(str(e)) from None


def _flat(text: str) -> object:
    """As ``loads``, with an explicit stack instead of recursion."""
    at, stack, root, expect = 0, [], [], "value"
    key: str | None = None
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _token.match(text, at)
        if not m:
            raise Invalid(f"at {at}")
        at = m.end()
        mark, string, number, word = m.groups()
        if mark in ("]", "}"):
            if not stack or expect not in ("next", "first") or isinstance(stack[-1][0], list) != (mark == "]"):
                raise Invalid(f"at {at}")
            value, key = stack.pop()
            if isinstance(value, dict) and key is not None and expect == "colon":
                raise Invalid(f"at {at}")
            key = stack[-1][1] if stack else None
            expect = "next"
            continue
        if mark == ",":
            if expect != "next" or not stack:
                raise Invalid(f"at {at}")
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if mark == ":":
            if expect != "colon":
                raise Invalid(f"at {at}")
            expect = "value"
            continue
        inside = stack[-1][0] if stack else root
        if isinstance(inside, dict) and expect in ("key", "first"):
            if string is None:
                raise Invalid(f"at {at}")
            stack[-1] = (inside, _decoder.decode(f'"{string}"'))
            expect = "colon"
            continue
        if expect not in ("value", "first") or (not stack and root):
            raise Invalid(f"at {at}")
        value = {} if mark == "{" else [] if mark == "[" else _decoder.decode(f'"{string}"') if string is not None else _decoder.decode(number or word)
        if isinstance(inside, dict):
            inside[stack[-1][1]] = value
        else:
            inside.append(value)
        if mark:
            stack.append((value, None))
            expect = "first"
        else:
            expect = "next"
    if stack or len(root) != 1:
        raise Invalid("unfinished")
    return root[0]


def dumps(value: object) -> str:
    """The value as JSON, non-ASCII kept; nesting of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[str, object]] = [("value", value)]
    while todo:
        kind, x = todo.pop()
        if kind == "text":
            out.append(str(x))
        elif isinstance(x, dict) and x:
            parts: list[tuple[str, object]] = []
            for i, (k, v) in enumerate(x.items()):
                parts += [("text", (", " if i else "{") + json.dumps(k, ensure_ascii=False) + ": "), ("value", v)]
            todo += [("text", "}"), *reversed(parts)]
        elif isinstance(x, list) and x:
            parts = []
            for i, v in enumerate(x):
                parts += [("text", ", " if i else "["), ("value", v)]
            todo += [("text", "]"), *reversed(parts)]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
