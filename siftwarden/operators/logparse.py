"""Log texts of many programs into entries with timestamp, level, component and message.

The head of a line is masked token by token: a date and clock, a level word, a number, a
bracket, a name with a colon and so on become types. The types route the line through a tree of
fixed depth; a leaf is a sequence of types. In a first pass over all texts the leaves are
counted (``learn``), and leaves that agree but for the tokens behind their header are merged into one template. Then each
template is mapped once: which position is the time, the level, the component, and where the
message begins. In the second pass every line takes its fields from its template's positions.

The counts decide what a single line cannot tell: a level word in lower case without any
punctuation is a level where that position holds one in nearly all lines of the leaf, else it is
message. Counts are sums over all rows, so results do not depend on how rows are spread over
tasks or in which order they come. Lines without a header continue the entry before them.
Objects in JSON, on one line or on several, and key=value lines are read by their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import deepjson
from siftwarden.functions.arrow import text_array

ENTRY_SCHEMA = "table_name string, row_key string, first_line bigint, last_line bigint, entry_ts string, entry_level string, component string, message string, template string"

# Level words of common log libraries, syslog severities and severity letters.
LEVELS = {
    "trace": "debug", "verbose": "debug", "debug": "debug", "dbg": "debug", "fine": "debug", "finer": "debug", "finest": "debug", "trc": "debug", "vrb": "debug",
    "info": "info", "information": "info", "informational": "info", "inf": "info", "notice": "info", "ntc": "info", "note": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn",
    "error": "error", "err": "error", "severe": "error",
    "critical": "critical", "crit": "critical", "crt": "critical", "fatal": "critical", "ftl": "critical", "alert": "critical", "alr": "critical", "emergency": "critical", "emerg": "critical", "emg": "critical", "panic": "critical",
}
SEVERITIES = ["critical", "critical", "critical", "error", "warn", "info", "info", "debug"]
LETTERS = {"T": "debug", "V": "debug", "D": "debug", "I": "info", "N": "info", "W": "warn", "E": "error", "C": "critical", "F": "critical"}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "eventtime", "event_time", "datetime", "date", "@time", "t", "when")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "log_level", "sev", "level_name", "levelname")
COMPONENT_KEYS = ("component", "logger", "service", "svc", "module", "provider", "source", "program", "app", "logger_name", "comp")
MESSAGE_KEYS = ("message", "msg")

# -- time -----------------------------------------------------------------------------------

_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,]\d+)?\s*(Z|z|UTC|GMT|[+-]\d\d:?\d\d)?$")


def _utc(y: int, mo: int, d: int, h: int, mi: int, s: int, zone: str | None = None) -> str:
    try:
        at = datetime(y, mo, d, h, mi, min(s, 59))
        if zone and zone[0] in "+-":
            away = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
            at = at - away if zone[0] == "+" else at + away
        return at.strftime("%Y-%m-%dT%H:%M:%S") if at.year > 999 else ""
    except (ValueError, OverflowError):
        return ""


def iso_time(text: str) -> str:
    m = _ISO.match(text.strip())
    return _utc(*map(int, m.groups()[:6]), m[7]) if m else ""


def epoch_time(value: float) -> str:
    """Seconds, milliseconds, micro- or nanoseconds since 1970, told apart by magnitude."""
    for limit, unit in ((1e11, 1), (1e14, 10**3), (1e17, 10**6), (1e20, 10**9)):
        if 0 <= value < limit:
            whole = int(value // unit)
            return (datetime(1970, 1, 1) + timedelta(seconds=whole)).strftime("%Y-%m-%dT%H:%M:%S")
    return ""


def any_time(value: object) -> str:
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, int | float):
        return epoch_time(value)
    text = str(value).strip()
    if re.fullmatch(r"\d{9,19}(\.\d+)?", text):
        return epoch_time(int(text) if "." not in text else float(text))
    if out := iso_time(text):
        return out
    return _stamp_of(m) if (m := _STAMP.fullmatch(text)) else ""


def level_of(word: object) -> str:
    return LEVELS.get(str(word).strip().lower(), "") if word is not None else ""


def _yearless(month: int, day: str, h: str, mi: str, s: str) -> str:
    return "--" + full[5:] if (full := _utc(2000, month, int(day), int(h), int(mi), int(s))) else ""


def _half_day(hour: str, half: str | None) -> int:
    h = int(hour)
    return h if not half else h % 12 + 12 * (half.upper() == "PM")


# -- tokens of a header and their types -------------------------------------------------------

_WORD = "|".join(sorted(LEVELS, key=len, reverse=True))
_HOUR = r"(?P<h{0}>\d{{1,2}}):(?P<i{0}>\d\d):(?P<s{0}>\d\d)(?:[.,]\d+)?(?: ?(?P<half{0}>[AaPp][Mm])\b)?"
_ZONE = r"(?: ?(?P<z{0}>Z|UTC|GMT|[+-]\d\d:?\d\d)\b)?"
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_DATES = [
    r"(?P<y0>\d{4})[-/.](?P<m0>\d{1,2})[-/.](?P<d0>\d{1,2})[T ]+",
    r"(?P<m1>\d{1,2})/(?P<d1>\d{1,2})/(?P<y1>\d{4}),? +",
    r"(?P<d2>\d{1,2})\.(?P<m2>\d{1,2})\.(?P<y2>\d{4}),? +",
    r"(?:(?:mon|tue|wed|thu|fri|sat|sun)\w*,? +)?(?P<d3>\d{1,2})[/ -](?P<m3>" + _MONTH + r")\w*[/ -](?P<y3>\d{4})[: ]+",
    r"(?P<w4>(?:mon|tue|wed|thu|fri|sat|sun)\w*,? +)?(?P<m4>" + _MONTH + r")\w*\.? +(?P<d4>\d{1,2})(?:,? +(?P<y4>\d{4}))?,? +",
    r"(?P<m5>\d\d)-(?P<d5>\d\d) +",
]
_STAMP = re.compile("|".join(f"(?:{d}{_HOUR.format(i)}{'(?: (?P<e4>[0-9]{4})(?![0-9:]))?' if i == 4 else ''}{_ZONE.format(i)})" for i, d in enumerate(_DATES)) + r"|(?P<epoch>\d{10}(?:\d{3})?(?:\.\d+)?)(?=[\])]? +\[?(?:" + _WORD + r")\b)", re.I)
_PRIORITY = re.compile(r"<(\d{1,3})>")
_VERSIONED = re.compile(r"<(\d{1,3})>\d{1,2} (\S+) \S+ (\S+) \S+ \S+ (?:-|(?:\[(?:[^\]\\\"]|\"(?:[^\"\\]|\\.)*\"|\\.)*\])+)(?: |$)")
_LETTER_TIME = re.compile(r"([TVDINWECF])(\d\d)(\d\d) (\d{1,2}):(\d\d):(\d\d)(?:\.\d+)?(?=\s)")
_CLIENT = re.compile(r"[\w.:-]+ \S+ \S+ (?=\[\d{1,2}/" + _MONTH + "/)", re.I)
_LEVEL_FIRST = re.compile(r"[\[(<]?(" + _WORD + r")[\])>]?:?[ \t|-]+(?=[\[(]?[\dA-Z])", re.I)
_LEVEL_NAME = re.compile(r"(" + _WORD.upper() + r"):([A-Za-z_][\w.]*):")
_LETTER_TAG = re.compile(r"([VDIWEF])/([^\s(:]+)\s*\(\s*\d+\): ?")
_BRACKET_END = re.compile(r"[^\])]{0,8}[\])]")
_SYSLOG = re.compile(r"\S+ ([^\s:\[]+)(?:\[\d*\])?:(?: |$)?")
_FILE = re.compile(r"([^\s:\[\]]+)(?::\d+)?\]")
_SEPARATOR = re.compile(r"[|:,]|[-–](?=\s)")
_BLANKS = re.compile(r"\s*")
_BRACKETS = re.compile(r"[\[(]([^\])]*)[\])]")
_SKIPPED = re.compile(r"[\d\s:#.-]*|(?:pid|tid|thread|client)\b.*|.*(?:thread|exec|worker|pool|main|http)\b.*|.*-\d+", re.I)
_LEVEL_TOKEN = re.compile(r"(" + _WORD + r")(?=[\s:|,\]]|$)", re.I)
_PUNCTUATED = re.compile(r"[:|,]|\s+[-|\[]")
_NUMBER_TOKEN = re.compile(r"(?:\d+(?:#\d+)?|pid[= ]\d+|0x[0-9a-f]+)(?=[\s:|,]|$)", re.I)
_NAME = r"([A-Za-z_][\w.$@/-]*?)"
_NAMED = re.compile(r"(?!(?:LOG|DETAIL|HINT|STATEMENT|CONTEXT|QUERY):)" + _NAME + r"(?:\[[\w.:#-]*\]|\(\d*\))?(?::\w*)*?(?::\d+)?(?::(?=\s|$)|(?=\s+[-|](?:\s|$)))")
_HOSTED = re.compile(r"(?:[\w.:-]*[\d.-][\w.:-]*\s+" + _NAME + r"(?:\[\d*\])?|[\w.-]+\s+" + _NAME + r"\[\d+\]):(?=\s|$)")
_DOTTED = re.compile(r"([A-Za-z_$][\w$]*(?:[.][A-Za-z_$][\w$]*)+)(?:\[\d*\]|:\d+)?(?=\s)")
_SLASH_LEVEL = re.compile(_NAME + r"(?:\[\d*\])?(?:/(?i:(" + _WORD + r"))|\.(" + _WORD.upper() + r")):")
_PIPED = re.compile(r"([A-Za-z][\w ]*)=((?:(?! \| ?[A-Za-z][\w ]*=).)*)", re.S)
_LETTER = re.compile(r"([VDIWEF])(?=\s)")

#: Types. Those that start a header come first; WORD and WEAK may end it.
VERSIONED, PRIORITY, LETTER_TIME, TIME, YEARLESS, CLIENT, FIRST, LEVEL_NAME, LETTER_TAG = "versioned priority letter-time time yearless-time client level-first level-name letter-tag".split()
LEVEL, WEAK, NUMBER, SKIP, BRACKET_LEVEL, MODULE_LEVEL, BRACKET_NAME, NAMED, HOSTED, FILE, DOTTED, SLASH_LEVEL, PIPED, LETTER, SEPARATOR, WORD = (
    "level weak-level number skipped bracket-level module-level bracket-name name host-name file dotted-name name-level pair letter separator word".split()
)
_HOSTS = ((HOSTED, _HOSTED),)
_NAMES = ((SLASH_LEVEL, _SLASH_LEVEL), (NAMED, _NAMED), *_HOSTS, (DOTTED, _DOTTED))
#: Tokens of a header that are typed.
DEPTH = 10
#: (type, what was matched, end).
Token = tuple[str, re.Match | None, int]


def _stamp_of(m: re.Match) -> str:
    if m["epoch"]:
        return any_time(m["epoch"])
    i = next(k for k in range(len(_DATES)) if m[f"h{k}"])
    month, day, year = m[f"m{i}"], m[f"d{i}"], None if i == 5 else m[f"y{i}"] or (m["e4"] if i == 4 else None)
    mo = int(month) if month.isdigit() else MONTHS[month[:3].lower()]
    h = str(_half_day(m[f"h{i}"], m[f"half{i}"]))
    if year is None:
        return _yearless(mo, day, h, m[f"i{i}"], m[f"s{i}"])
    return _utc(int(year), mo, int(day), int(h), int(m[f"i{i}"]), int(m[f"s{i}"]), m[f"z{i}"])


def _time_token(line: str, at: int) -> Token | None:
    """A date and clock, in brackets or not. Behind a clock without weekday or bracket a number
    of four digits is no year."""
    bracket = line[at : at + 1] in ("[", "(")
    m = _STAMP.match(line, at + bracket)
    if m is None:
        return None
    end = m.end()
    if bracket:
        close = _BRACKET_END.match(line, end)
        return (TIME, m, close.end()) if close else None
    yearless = bool(m["m4"]) and not m["y4"]
    if yearless and not m["w4"] and (m["e4"] or m["z4"]):
        m = _STAMP.match(line, at, m.end("half4") if m["half4"] else m.end("s4"))
        end = m.end()  # type: ignore[union-attr]
        if fraction := re.compile(r"[.,]\d+").match(line, end):
            end = fraction.end()
    if line[end : end + 1].isalnum():
        return None
    return YEARLESS if yearless and not m["e4"] else TIME, m, end  # type: ignore[index]


def _start(line: str) -> list[Token] | None:
    """The tokens that begin a header; None if the line has none."""
    c = line[0]
    if c == "<":
        if m := _VERSIONED.match(line):
            return [(VERSIONED, m, m.end())]
        if (m := _PRIORITY.match(line)) and (t := _time_token(line, m.end())):
            return [(PRIORITY, m, m.end()), t]
    if t := _time_token(line, 0):
        return [t]
    if m := _LETTER_TIME.match(line):
        return [(LETTER_TIME, m, m.end())]
    if (m := _LEVEL_FIRST.match(line)) and (t := _time_token(line, m.end())):
        return [(FIRST, m, m.end()), t]
    if m := _LEVEL_NAME.match(line):
        return [(LEVEL_NAME, m, m.end())]
    if m := _LETTER_TAG.match(line):
        return [(LETTER_TAG, m, m.end())]
    if (m := _CLIENT.match(line)) and (t := _time_token(line, m.end())):
        return [(CLIENT, m, m.end()), t]
    return None


def _next(line: str, at: int, before: list[Token]) -> Token:
    """The token at a place, by its own form and, for a few, by the one before it."""
    c, last = line[at], before[-1][0]
    if c in "[(" and (m := _BRACKETS.match(line, at)):
        inner = m[1].strip()
        head, _, tail = inner.rpartition(":")
        kind = BRACKET_LEVEL if level_of(inner) else MODULE_LEVEL if head and level_of(tail) else SKIP if _SKIPPED.fullmatch(inner) else BRACKET_NAME
        return kind, m, m.end()
    if c in "|:,-–" and (m := _SEPARATOR.match(line, at)):
        return SEPARATOR, m, m.end()
    if last == YEARLESS and (m := _SYSLOG.match(line, at)):
        return HOSTED, m, m.end()
    if before[0][0] == LETTER_TIME and (m := _FILE.match(line, at)):
        return FILE, m, m.end()
    if last == SEPARATOR and line[before[-1][2] - 1] == "|" and (m := _PIPED.match(line, at)):
        return PIPED, m, m.end()
    named = c.isalpha() or c in "_$"
    if named and (m := _LEVEL_TOKEN.match(line, at)):
        return LEVEL if m[1].isupper() or _PUNCTUATED.match(line, m.end()) else WEAK, m, m.end()
    if c in "0123456789pP" and (m := _NUMBER_TOKEN.match(line, at)):
        return SKIP if line[m.end() : m.end() + 1] == ":" else NUMBER, m, m.end()
    for kind, pattern in _NAMES if named else _HOSTS:
        if m := pattern.match(line, at):
            # A name that a dash follows is not closed as one with a colon is.
            return DOTTED if kind == NAMED and line[m.end() - 1] != ":" else kind, m, m.end()
    if named and (m := _LETTER.match(line, at)):
        return LETTER, m, m.end()
    return WORD, None, at


def tokens_of(line: str, depth: int = DEPTH) -> list[Token] | None:
    """The typed tokens of a line's head, up to the first plain word; None if no header begins."""
    out = _start(line)
    if out is None:
        return None
    while len(out) < depth:
        at = _BLANKS.match(line, out[-1][2]).end()  # type: ignore[union-attr]
        if at >= len(line):
            break
        token = _next(line, at, out)
        out.append(token)
        if token[0] == WORD:
            break
    return out


# -- templates: what the positions mean -------------------------------------------------------


#: A number before one of these is an id of the header, else it begins the message.
_BEHIND_NUMBERS = (NUMBER, LEVEL, WEAK, BRACKET_LEVEL, MODULE_LEVEL, BRACKET_NAME, SKIP, LETTER, FILE)


class Template:
    """The roles of a leaf's positions. ``names``: positions of components in order of preference;
    ``end``: the first position of the message."""

    __slots__ = ("end", "level", "name", "pairs", "text", "time")

    def __init__(self, types: tuple[str, ...], is_level: Callable[[int], bool]) -> None:
        self.time = next((i for i, t in enumerate(types) if t in (VERSIONED, LETTER_TIME, TIME, YEARLESS)), None)
        self.level = next((i for i, t in enumerate(types) if t in (VERSIONED, PRIORITY, LETTER_TIME, FIRST, LEVEL_NAME, LETTER_TAG)), None)
        name = next((i for i, t in enumerate(types) if t in (VERSIONED, LEVEL_NAME, LETTER_TAG)), None)
        held: int | None = None
        closed = False
        begin = max(x for x in (self.time, self.level) if x is not None) + 1
        self.pairs: list[int] = []
        i = begin if types[0] not in (VERSIONED, LEVEL_NAME, LETTER_TAG, CLIENT) else len(types)
        self.end = begin if types[0] in (VERSIONED, LEVEL_NAME, LETTER_TAG, CLIENT) else len(types)
        while i < len(types):
            t, after = types[i], types[i + 1 : i + 2]
            if closed and t in (SKIP, NUMBER, BRACKET_NAME):
                self.end = i
                break
            if t in (SEPARATOR, SKIP):
                pass
            elif t == BRACKET_LEVEL:
                self.level = i if self.level is None else self.level
            elif t == MODULE_LEVEL:
                if self.level is None:
                    self.level, name = i, i if name is None else name
            elif t == BRACKET_NAME:
                held = i if held is None else held
            elif t == PIPED:
                self.pairs.append(i)
            elif t == FILE and name is None:
                name = i
            elif t == LEVEL and self.level is None or t == WEAK and self.level is None and is_level(i):
                self.level = i
            elif t == NUMBER and next((x for x in types[i + 1 :] if x != SEPARATOR), WORD) in _BEHIND_NUMBERS:
                pass
            elif t == LETTER and self.level is None and after == (NAMED,):
                self.level = i
            elif t == SLASH_LEVEL and name is None and self.level is None:
                name = self.level = i
            elif t in (NAMED, HOSTED, DOTTED) and name is None:
                name = i
            else:
                self.end = i
                break
            closed = closed or t in (NAMED, HOSTED, FILE, SLASH_LEVEL)
            i += 1
        self.name = held if name is None else name
        self.text = " ".join([*(f"<{t}>" for t in types[: self.end]), "<*>"])

    def fields(self, line: str, tokens: list[Token]) -> tuple[str, str, str, str]:
        """(time, level, component, message) of a line of this template."""
        time = level = name = ""
        if self.time is not None:
            kind, m, _ = tokens[self.time]
            if kind == VERSIONED:
                time = iso_time(m[2])  # type: ignore[index]
            elif kind == LETTER_TIME:
                time = _yearless(int(m[2]), *(m[i] for i in (3, 4, 5, 6)))  # type: ignore[index]
            else:
                time = _stamp_of(m)  # type: ignore[arg-type]
        if self.level is not None:
            level = _level_in(*tokens[self.level][:2])
        if self.name is not None:
            name = _name_in(*tokens[self.name][:2])
        begin = tokens[self.end - 1][2] if self.end else 0
        message = line[_BLANKS.match(line, begin).end() :]  # type: ignore[union-attr]
        for i in self.pairs:
            m = tokens[i][1]
            key, value = m[1].strip().lower(), m[2].strip()  # type: ignore[index]
            if key in LEVEL_KEYS and not level:
                level = level_of(value)
            elif key in COMPONENT_KEYS and not name:
                name = value
            elif key in MESSAGE_KEYS:
                message = line[m.start(2) :]  # type: ignore[union-attr]
                break
        return time, level, name, message


def _level_in(kind: str, m: re.Match) -> str:
    if kind in (VERSIONED, PRIORITY):
        return SEVERITIES[int(m[1]) % 8]
    if kind in (LETTER_TIME, LETTER_TAG, LETTER):
        return LETTERS[m[1]]
    if kind == MODULE_LEVEL:
        return level_of(m[1].rpartition(":")[2])
    return level_of(m[2] or m[3]) if kind == SLASH_LEVEL else level_of(m[1])


def _name_in(kind: str, m: re.Match) -> str:
    if kind == VERSIONED:
        return "" if m[3] == "-" else m[3]
    if kind in (LEVEL_NAME, LETTER_TAG):
        return m[2]
    if kind == MODULE_LEVEL:
        return m[1].strip().rpartition(":")[0]
    if kind == BRACKET_NAME:
        return m[1].strip()
    return m[1] or (m[2] if kind == HOSTED and m.re is _HOSTED else "")


# -- pairs ----------------------------------------------------------------------------------

_PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)(?:\s+|$)')


def pairs_of(line: str) -> dict[str, str] | None:
    """key=value pairs that fill the head of a line (a quoted value may hold anything)."""
    out, at = {}, 0
    while m := _PAIR.match(line, at):
        value = m[2]
        out.setdefault(m[1].lower(), re.sub(r"\\(.)", r"\1", value[1:-1]) if value[:1] == '"' else value)
        at = m.end()
    return out if len(out) > 1 and at == len(line) or len(out) > 2 else None


def named_fields(found: dict) -> tuple[str, str, str, str] | None:
    """(time, level, component, message) of an object or of pairs; None if it is no entry."""
    low = {str(k).lower(): v for k, v in found.items()}

    def first(keys: tuple[str, ...]) -> object:
        return next((low[k] for k in keys if low.get(k) not in (None, "") and not isinstance(low[k], dict | list)), None)

    ts, level, component, message = (first(k) for k in (TIME_KEYS, LEVEL_KEYS, COMPONENT_KEYS, MESSAGE_KEYS))
    if ts is None and level is None:
        return None
    return any_time(ts), level_of(level), "" if component is None else str(component).strip(), "" if message is None else str(message)


# -- the tree -------------------------------------------------------------------------------

Key = tuple[str, ...]


class TemplateTree:
    """Leaves (sequences of types) with their counts, and the template of each.

    ``share``, ``support``: a level word without case or punctuation to tell it is a level if at
    least that share of the lines that agree up to there have a level in its place, and so many
    lines do.
    """

    def __init__(self, share: float = 0.9, support: int = 20) -> None:
        self.share, self.support = share, support
        #: Lines of a leaf.
        self.counts: Counter[Key] = Counter()
        #: Lines by the types before a position, and those of them with a level there.
        self.before: Counter[Key] = Counter()
        self.levels: Counter[Key] = Counter()
        self.templates: dict[Key, Template] = {}

    def learn(self, key: Key, n: int = 1) -> None:
        self.counts[key] += n
        for i in range(1, len(key)):
            self.before[key[:i]] += n
            self.levels[key[:i]] += n * (key[i] in (LEVEL, WEAK))

    def template(self, key: Key) -> Template:
        found = self.templates.get(key)
        if found is None:

            def is_level(i: int) -> bool:
                n = self.before[key[:i]]
                return n >= self.support and self.levels[key[:i]] >= self.share * n

            found = self.templates[key] = Template(key, is_level)
        return found

    def merged(self) -> dict[str, int]:
        """Templates with their lines: leaves that agree up to the message are one."""
        out: Counter[str] = Counter()
        for key, n in self.counts.items():
            out[self.template(key).text] += n
        return dict(out)

    def fields(self, line: str) -> tuple[str, str, str, str, str] | None:
        """(time, level, component, message, template); None for a continuation."""
        tokens = tokens_of(line)
        if tokens is None:
            return None
        found = self.template(tuple(t[0] for t in tokens))
        return *found.fields(line, tokens), found.text


def keys_of(text: str | None) -> Iterator[Key]:
    """The leaves of the lines of a text that begin a header."""
    for line in (text or "").split("\n"):
        if line[:1] not in ("", " ", "\t", "\r", "{") and (tokens := tokens_of(line.rstrip())):
            yield tuple(t[0] for t in tokens)


def parse(text: str | None, tree: TemplateTree | None = None) -> list[tuple[int, int, str, str, str, str]]:
    """Entries of a text: (first line, last line, time, level, component, message).

    Null, empty and blank texts have none. A text without any header is one entry with ''
    fields; so are lines before the first header. Without a tree, the text's own lines are
    learned first.
    """
    return [e[:6] for e in entries_of(text, tree)]


def entries_of(text: str | None, tree: TemplateTree | None = None) -> list[tuple]:
    """As ``parse``, with the template of the header: '' for JSON, pairs and texts without one."""
    if text is None or not text.strip():
        return []
    if tree is None:
        tree = TemplateTree()
        for key in keys_of(text):
            tree.learn(key)
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    entries: list[list] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        end, found = i, None
        if line[:1] not in ("", " ", "\t"):
            if line[0] == "{":
                found, end = _object(lines, i)
            elif (m := re.match(r"[A-Za-z_@][\w.@-]*=", line)) and (pairs := pairs_of(line)):
                found = named_fields(pairs)
            if found is None:
                end = i
                found = tree.fields(line.rstrip())
            else:
                found = (*found, "")
        if found:
            entries.append([i, end, *found[:3], [found[3]], found[4]])
        elif line.strip():
            if entries:
                entries[-1][1] = i
                entries[-1][5].append(line)
            else:
                entries.append([i, i, "", "", "", [line], ""])
        i = end + 1
    return [(e[0] + 1, e[1] + 1, e[2], e[3], e[4], "\n".join(e[5]), e[6]) for e in entries]


_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"')


def _object(lines: list[str], i: int) -> tuple[tuple[str, str, str, str] | None, int]:
    """The JSON object that starts at a line, on this or several lines, and its last line."""
    one = lines[i].rstrip()
    if one.endswith("}"):
        try:
            value = deepjson.loads(one)
            return (named_fields(value) if isinstance(value, dict) else None), i
        except ValueError:
            pass
    if one.strip() != "{" and not one.endswith((",", "{", "[")):
        return None, i
    depth = 0
    for j in range(i, len(lines)):
        bare = _QUOTED.sub("", lines[j])
        depth += bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
        if depth <= 0:
            try:
                value = deepjson.loads("\n".join(lines[i : j + 1]))
            except ValueError:
                return None, i
            return (named_fields(value) if isinstance(value, dict) else None), j
    return None, i


def message_template(message: str) -> str:
    """A message's first line with its variables masked."""
    first = message.split("\n", 1)[0].split()
    return " ".join("<*>" if _DIGIT.search(t) else t for t in first)


_DIGIT = re.compile(r"\d")


# -- frames -----------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[Key] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(keys_of(text))
    held = sorted(counts.items())
    yield pa.RecordBatch.from_arrays([pa.array([" ".join(k) for k, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["leaf", "n"])


def learned(*texts: DataFrame) -> TemplateTree:
    """The tree of all lines of frames with a column ``text``.

    What comes to the driver are counts per leaf. Leaves are sequences of at most DEPTH types out of a
    fixed list that end at the first plain word, so their number does not grow with the rows.
    """
    tree = TemplateTree()
    frames = [t.select(F.col("text").cast("string")).where("text is not null").mapInArrow(_counted, "leaf string, n bigint") for t in texts]
    every = reduce(DataFrame.unionByName, frames).groupBy("leaf").agg(F.sum("n").alias("n"))
    for r in sorted(every.collect()):
        tree.learn(tuple(r.leaf.split(" ")), r.n)
    return tree


def _entries(counts: dict[Key, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree()
        for key, n in counts.items():
            tree.learn(key, n)
        names = ["table_name", "row_key", "first_line", "last_line", "entry_ts", "entry_level", "component", "message", "template"]
        for batch in batches:
            tables, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            rows: list[tuple] = []
            for table, key, text in zip(tables, keys, texts, strict=True):
                for e in entries_of(text, tree):
                    rows.append((table, key, *e[:6], f"{e[6]} {message_template(e[5])}".strip() if not e[6] else e[6].removesuffix("<*>") + message_template(e[5])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            arrays = [pa.array(c, pa.int64()) if i in (2, 3) else text_array(list(c)) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def log_entries(texts: DataFrame, table: str, key: str, text: str, tree: TemplateTree | None = None) -> DataFrame:
    """One row per log entry of ``text``: ENTRY_SCHEMA. Other columns are ignored, whatever
    their names are; null keys are kept as null. Repeated rows give repeated entries.

    ``tree``: templates learned from all texts that belong together (``learned``); without one
    those of this frame are learned first.
    """
    picked = texts.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(text).cast("string").alias("text")).where("text is not null")
    known = learned(picked) if tree is None else tree
    return picked.mapInArrow(_entries(dict(known.counts)), ENTRY_SCHEMA)
