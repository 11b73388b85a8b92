"""JSON of any depth.

The interpreter's decoder recurses and gives up on very deep documents. Those, and only those,
are read and written here with an explicit stack, token by token, with the same result.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", re.ASCII)
_BLANK = re.compile(r"[ \t\r\n]*")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _reject(word: str) -> object:
    raise ValueError(word)


_DECODER = json.JSONDecoder(parse_constant=_reject)


def loads(text: str) -> object:
    """The value of a complete JSON text; ValueError for anything else (NaN and the like too)."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        value, end = _read(text, _BLANK.match(text, 0).end())  # type: ignore[union-attr]
        if _BLANK.match(text, end).end() != len(text):  # type: ignore[union-attr]
            raise ValueError("more than one value") from None
        return value


def read_from(text: str, start: int) -> tuple[object, int]:
    """The value that begins at ``start`` and the place behind it; ValueError if there is none."""
    try:
        return _DECODER.raw_decode(text, start)
    except RecursionError:
        return _read(text, start)


def _scalar(text: str, at: int) -> tuple[object, int]:
    c = text[at : at + 1]
    if c == '"':
        return scanstring(text, at + 1, True)
    if c in _WORDS and text.startswith(_WORDS[c][0], at):
        return _WORDS[c][1], at + len(_WORDS[c][0])
    m = _NUMBER.match(text, at)
    if m is None:
        raise ValueError(f"no value at {at}")
    return (float if m[1] or m[2] else int)(m[0]), m.end()


def _read(text: str, at: int, starts: list[int] | None = None, done: list[int] | None = None) -> tuple[object, int]:
    """``starts`` and ``done`` take up where objects and lists begin that are open or complete."""
    blank = _BLANK.match
    stack: list[list | dict] = []
    names: list[str | None] = []
    starts = [] if starts is None else starts

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no name at {at}")
        out, at = scanstring(text, at + 1, True)
        at = blank(text, at).end()  # type: ignore[union-attr]
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return out, blank(text, at + 1).end()  # type: ignore[union-attr]

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            held: list | dict = {} if c == "{" else []
            starts.append(at)
            at = blank(text, at + 1).end()  # type: ignore[union-attr]
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                stack.append(held)
                key = None
                if c == "{":
                    key, at = name(at)
                names.append(key)
                continue
            value: object = held
            at += 1
            begun = starts.pop()
            if done is not None:
                done.append(begun)
        else:
            value, at = _scalar(text, at)
        while stack:
            top = stack[-1]
            if isinstance(top, dict):
                top[names[-1]] = value
            else:
                top.append(value)
            at = blank(text, at).end()  # type: ignore[union-attr]
            c = text[at : at + 1]
            if c == ",":
                at = blank(text, at + 1).end()  # type: ignore[union-attr]
                if isinstance(top, dict):
                    names[-1], at = name(at)
                break
            if c != ("}" if isinstance(top, dict) else "]"):
                raise ValueError(f"not closed at {at}")
            at += 1
            value = stack.pop()
            names.pop()
            begun = starts.pop()
            if done is not None:
                done.append(begun)
        else:
            return value, at


class _Unplaced(str):
    """A text whose errors have no line and column: the decoder would look through all that is
    before the place of each error, which for many errors takes time with the square of the length."""

    __slots__ = ()

    def count(self, *of: object) -> int:  # type: ignore[override]
        return 0

    def rfind(self, *of: object) -> int:  # type: ignore[override]
        return -1


def first_object(text: str) -> tuple[int, int] | None:
    """Where the first complete object of a text begins and ends. An object that fails is not
    tried again from those that were open inside it, as they fail at the same place."""
    at = text.find("{")
    text = _Unplaced(text)
    failed: set[int] = set()
    while at >= 0:
        if at not in failed:
            try:
                return at, _DECODER.raw_decode(text, at)[1]
            except (ValueError, RecursionError):
                starts: list[int] = []
                done: list[int] = []
                try:
                    return at, _read(text, at, starts, done)[1]
                except ValueError:
                    failed.update(starts)
                    inside = [x for x in done if text[x] == "{"]
                    if inside:
                        return min(inside), _read(text, min(inside))[1]
        at = text.find("{", at + 1)
    return None


def dumps(value: object) -> str:
    """Compact JSON text of a value, not limited to ASCII."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        out: list[str] = []
        stack: list[object] = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, _Text):
                out.append(v.text)
            elif isinstance(v, dict):
                parts: list[object] = [_Text("}")]
                for i, (k, x) in reversed(list(enumerate(v.items()))):
                    parts += [x, _Text(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":")]
                stack += [*parts, _Text("{")]
            elif isinstance(v, list):
                parts = [_Text("]")]
                for i, x in reversed(list(enumerate(v))):
                    parts += [x, _Text(",")] if i else [x]
                stack += [*parts, _Text("[")]
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)


class _Text:
    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = text
