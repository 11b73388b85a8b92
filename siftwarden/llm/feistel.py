"""Keyed permutations of numbers, letters and dates within their format.

A balanced Feistel network over decimal (or alphabetic) strings: each half is shifted by a
keyed hash of the other, modulo the half's own domain, so that the result has as many digits
as the input, equal inputs give equal outputs, and the key's holder can invert it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

ROUNDS = 10
_FIRST_DAY, _DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31


def _mix(key: bytes, tweak: bytes, step: int, length: int, value: int, domain: int) -> int:
    body = tweak + bytes((step, length)) + value.to_bytes(16, "big")
    return int.from_bytes(blake2b(body, digest_size=16, key=key[:64]).digest(), "big") % domain


def permute(value: int, length: int, radix: int, key: bytes, tweak: bytes = b"", inverse: bool = False) -> int:
    """Permutes 0 <= value < radix ** length."""
    if length < 2:
        domain = radix**length
        shift = _mix(key, tweak, 255, length, 0, domain)
        return (value - shift if inverse else value + shift) % domain
    low = length // 2
    size_a, size_b = radix ** (length - low), radix**low
    a, b = divmod(value, size_b)
    for step in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        sign = -1 if inverse else 1
        if step % 2 == 0:
            a = (a + sign * _mix(key, tweak, step, length, b, size_a)) % size_a
        else:
            b = (b + sign * _mix(key, tweak, step, length, a, size_b)) % size_b
    return a * size_b + b


def _string(text: str, alphabet: str, key: bytes, tweak: bytes, inverse: bool) -> str:
    radix, value = len(alphabet), 0
    for c in text:
        value = value * radix + alphabet.index(c)
    value, out = permute(value, len(text), radix, key, tweak, inverse), []
    for _ in text:
        value, digit = divmod(value, radix)
        out.append(alphabet[digit])
    return "".join(reversed(out))


_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=1 << 16)
def permute_number(text: str, key: bytes, keep: int = 0, inverse: bool = False) -> str:
    """Permutes the ASCII digits and capitals of an identifier in place; all else stays.

    ``keep``: leading digits (a country prefix) that are left alone. The separators do not
    count, so one number in two notations keeps one pseudonym.
    """
    digits = [i for i, c in enumerate(text) if c in _DIGITS][keep:]
    letters = [i for i, c in enumerate(text) if c in _LETTERS]
    out = list(text)
    for places, alphabet, tweak in ((digits, _DIGITS, b"n"), (letters, _LETTERS, b"l")):
        if places:
            for i, c in zip(places, _string("".join(text[i] for i in places), alphabet, key, tweak, inverse), strict=True):
                out[i] = c
    return "".join(out)


def permute_date(day: date, key: bytes, inverse: bool = False) -> date:
    """Permutes a day among those from 1900 to 2099 by walking the cycle; others stay."""
    at = (day - _FIRST_DAY).days
    if not 0 <= at < _DAYS:
        return day
    while True:
        at = permute(at, 5, 10, key, b"d", inverse)
        if at < _DAYS:
            return _FIRST_DAY + timedelta(days=at)


# -- identity numbers: validated, and as valid after as before ---------------------------------

# The check letters of Spanish identity numbers, by remainder.
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _spanish_letter(text: str) -> str:
    return _CHECK_LETTERS[int(text[:-1].replace("X", "0", 1).replace("Y", "1", 1).replace("Z", "2", 1)) % 23]


def _german_digit(digits: str) -> str:
    """Check digit of a tax number (ISO 7064, modulus 11, 10)."""
    product = 10
    for c in digits[:-1]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return str((11 - product) % 10)


def _social_security(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


#: (form, check): ``check`` gives the last character that a number must have, or says whether
#: its digits are in range.
_FORMS: list[tuple[re.Pattern, Callable[[str], str | bool]]] = [
    (re.compile(r"[XYZ]\d{7}[A-Z]|\d{8}[A-Z]"), _spanish_letter),
    (re.compile(r"\d{11}"), _german_digit),
    (re.compile(r"\d{9}"), _social_security),
]
_SEPARATORS = re.compile(r"[ ./-]")


def is_valid(text: str) -> bool | None:
    """Whether a number meets the check of its form; None for forms without one."""
    bare = _SEPARATORS.sub("", text)
    for form, check in _FORMS:
        if form.fullmatch(bare):
            held = check(bare)
            return held if isinstance(held, bool) else held == bare[-1]
    return None


@lru_cache(maxsize=1 << 16)
def permute_identifier(text: str, key: bytes, inverse: bool = False) -> str:
    """Permutes an identity number within its form and within its class: a valid number becomes a
    valid one, an invalid one stays invalid.

    A check character is no part of a valid number's payload: the payload is permuted, the first letter
    of its own small alphabet stays, and the check character is made anew. In the other classes
    the permutation is walked until the class is met again.
    """
    valid = is_valid(text)
    bare = _SEPARATORS.sub("", text)
    if valid and len(bare) != 9 or valid and bare[-1] in _LETTERS:
        at = max(i for i, c in enumerate(text) if c in _DIGITS or c in _LETTERS)
        head = text[:at]
        lead = 1 if head[:1] in _LETTERS else 0
        moved = head[:lead] + permute_number(head[lead:], key, 0, inverse)
        for form, check in _FORMS:
            if form.fullmatch(_SEPARATORS.sub("", moved) + bare[-1]):
                return moved + str(check(_SEPARATORS.sub("", moved) + bare[-1])) + text[at + 1 :]
    out = text
    while True:
        out = permute_number(out, key, 0, inverse)
        if is_valid(out) == valid:
            return out


_WRITTEN = re.compile(r"(\d{4})-(\d\d)-(\d\d)|(\d{1,2})/(\d{1,2})/(\d{4})|(\d{1,2})\.(\d{1,2})\.(\d{4})")


def permute_written_date(text: str, key: bytes, inverse: bool = False) -> str:
    """A date in the form it is written in (slashes: month first, dots: day first), permuted as
    ``permute_date`` does; what is no date is permuted digit by digit."""
    m = _WRITTEN.fullmatch(text)
    try:
        y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[6], m[4], m[5]) if m[4] else (m[9], m[8], m[7])  # type: ignore[index]
        day = permute_date(date(int(y), int(mo), int(d)), key, inverse)
    except (TypeError, ValueError):
        return permute_number(text, key, 0, inverse)
    return day.isoformat() if m[1] else f"{day.month:02d}/{day.day:02d}/{day.year}" if m[4] else f"{day.day:02d}.{day.month:02d}.{day.year}"  # type: ignore[index]


@lru_cache(maxsize=1 << 16)
def code(text: str, key: bytes) -> str:
    """An eight-letter keyed code for values without a numeric format."""
    value = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=5, key=key[:64]).digest(), "big")
    value = permute(value % 10**12, 12, 10, key, b"c")
    out = []
    for _ in range(8):
        value, k = divmod(value, 32)
        out.append("abcdefghijkmnpqrstuvwxyz23456789"[k])
    return "".join(out)
