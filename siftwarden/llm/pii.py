"""Personal information inside free text: found, typed and replaced.

One pass of an Aho-Corasick automaton over a whole batch finds the places worth a look (labels
and titles in several languages, given names, at-signs and their disguises, names of a reference
list); small anchored patterns then decide there. Phone numbers in written form need no label and
have a pattern of their own. Values are replaced by typed placeholders whose pseudonym is keyed:
numbers and birth dates are validated and permuted within their own format by a Feistel network,
others get a keyed code. Equal values therefore stay linked over documents, partitions and, with the same key,
runs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm import feistel

FOUND_SCHEMA = "table_name string, row_id bigint, pii_type string, pii_text string"
TEXT_SCHEMA = "table_name string, row_id bigint, redacted string, n_found int"
NAME, EMAIL, PHONE, ID, ADDRESS = "name", "email", "phone", "id_number", "street_address"
BIRTH_DATE = "birth_date"

# Words that announce a person, in en, de, fr, es.
TITLES = ("mr. ", "mrs. ", "ms. ", "dr. ", "prof. ", "mr ", "mrs ", "herr ", "frau ", "mme ", "mlle ", "monsieur ", "madame ", "señor ", "señora ", "sr. ", "sra. ", "don ", "doña ")
NAME_LABELS = (
    "ticket owner: ", "ticket owner ", "owner: ", "reported by ", "handed over to ", "spoke with ", "badge of ", "caller ", "patient ", "contact: ", "assigned to ", "approved by ", "requested by ", "signed by ", "on behalf of ",
    "gemeldet von ", "anrufer ", "anruferin ", "patientin ", "bearbeiter ", "bearbeiter: ", "übergeben an ", "gesprochen mit ", "name: ", "name=",
    "signalé par ", "le patient ", "la patiente ", "remis à ", "appelant ", "transmis à ",
    "avisó ", "la paciente ", "el paciente ", "informado por ", "llamó ", "entregado a ", "habló con ", "avisada por ", "avisado por ",
)
PHONE_LABELS = ("tel ", "tel. ", "tel: ", "tel.: ", "tel=", "telefon ", "telefon: ", "phone=", "phone ", "phone: ", "mobile: ", "mobile ", "mobile=", "cell ", "cell: ", "fax ", "fax: ", "fax=", "call back on ", "reached at ", "llamar al ", "teléfono ", "rappeler au ", "téléphone ", "joignable au ", "rückruf unter ", "erreichbar unter ", "handy ", "móvil ", "call ")
ID_LABELS = (
    "ssn", "social security no.", "social security number", "social security", "mrn", "medical record number", "medical record no.", "medical record", "passport no.", "passport number", "passport", "reisepass", "pasaporte", "passeport",
    "national id", "nie", "dni", "nif", "driver licence", "driver license", "driver's licence", "driver's license", "driving licence", "führerschein", "dl#", "dl ", "steuer-id", "steuernummer", "tax id", "tax number", "personalausweis", "krankenaktennummer", "expediente", "permis de conduire", "numéro fiscal",
)
ADDRESS_LABELS = ("adresse ", "adresse: ", "domicilio ", "domicilio: ", "wohnhaft ", "wohnhaft in ", "home address ", "home address: ", "lives at ", "ships to ", "addr: ", "addr=", "address: ", "address ", "anschrift ", "anschrift: ", "device returned from ", "returned from ", "dirección ", "dirección: ", "demeurant ", "habite ", "vive en ", "wohnt ", "resides at ")
BIRTH_LABELS = ("date of birth ", "date of birth: ", "dob ", "dob: ", "dob=", "born on ", "geboren am ", "geburtsdatum ", "geburtsdatum: ", "né le ", "née le ", "date de naissance ", "date de naissance: ", "fecha de nacimiento ", "fecha de nacimiento: ", "nacido el ", "nacida el ")
# Frequent given names that are hardly words of their own, in several languages.
GIVEN_NAMES = """alejandro alexander alice amanda amelia andrea andreas angela anna antonio barbara beatriz benjamin bernd brigitte camille carlos carmen caroline catherine cécile
charlotte chiara christian christina christine christoph claire claudia daniel david diego dmitri dominik eduardo elena elizabeth emily emma enrique erik eva fabian fatima felipe fernando
florian françois françoise gabriel gabriela georg george giovanni giulia gonzalo guillaume hannah hans heike heinrich helena helmut ibrahim ingrid isabel isabella ivan jacob jacques james jan jana jean
jennifer jessica joan johann johanna john jonas jorge josé joseph juan julia julien jürgen karin karl katharina katherine kevin klaus kristina laura lena leonardo lisa louise lucas lucía ludwig
luis magdalena manuel marcel marco margaret maria maría marie mario markus marta martin martina mateo matthew matthias michael michel miguel mohamed monika natalia nathalie nicolas nicole
oliver olivia pablo pascal patricia paul paula peter petra philipp philippe pierre rafael ralf raquel rebecca renate ricardo richard robert roberto sabine samuel sandra santiago sarah
sebastian sergio simone sofia sophie stefan stefanie stephen susan susanne teresa thérèse thomas timothy ulrich ursula valentina vanessa véronique victoria vincent walter werner william wolfgang yasmin yvonne""".split()
NO_FAMILY = """server service cluster node database db street road avenue university hospital clinic bank group team systems software labs corp inc ltd gmbh january february march april may june july
august september october november december monday tuesday wednesday thursday friday saturday sunday error warning info debug failed was is has and or the""".split()
AT_SIGNS = ("@", "%40", "[at]", "(at)", "{at}", "<at>")

_UP = "A-ZÀ-ÖØ-ÞĀŁŚŠŽŐŰ"
_LETTER = r"[^\W\d_]"
_N = rf"[{_UP}](?:{_LETTER}|['’-](?={_LETTER}))+"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|M|Sr|Sra)\.? )?"
_NAME = re.compile(rf"{_TITLE}((?:{_N} [{_UP}]\. {_N})|(?:[{_UP}]\. {_N})|(?:{_N}, {_N}(?: [{_UP}]\.(?!\w))?)|(?:{_N} {_N}))(?![\w@])")
_LOCAL = re.compile(r"[A-Za-z0-9À-ÿ](?:[\w.+-]*[\w+-])? ?$")
_DOMAIN = re.compile(r" ?[A-Za-z0-9][\w-]*(?:(?:\.| ?(?:\[dot\]|\(dot\)|\{dot\}) ?)[A-Za-z0-9][\w-]*)+", re.I)
_PHONE_US = re.compile(r"(?<![\w.+/-])(?:\+1[ .-]?|001[ .-]?|1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+/-])\+1\d{10}(?!\w)")
_PHONE_INTL = re.compile(r"(?<![\w.+/-])(?:\+|00)[1-9]\d{0,2}(?:(?: \(0\) ?| ?/ ?| |-|\.)\(?\d{1,5}\)?){2,5}(?![\w-])|(?<![\w.+/-])\+[1-9]\d{8,13}(?!\w)")
_PHONE_BARE = re.compile(r"(?:\+|00)?\(?\d[\d ()./-]{5,18}\d(?!\w)")
_ID_LEAD = re.compile(r"(?:[ .:=#-]|no\.|nr\.|n\.º|nº|number|num\.){0,6}", re.I)
_ID_VALUE = re.compile(
    r"\d{3}([- ]?)\d{2}\1\d{4}(?![\w-])|\d{2} \d{3} \d{3} \d{3}(?!\w)|[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])|[A-Z]{0,3}\d[A-Z\d]{4,16}(?!\w)|[A-Z]?\d{2,4}(?:[-/ .]\d{2,5}){1,4}[A-Z]?(?!\w)"
)
_TOWN = rf"[{_UP}](?:{_LETTER}|['’-])+(?: [{_UP}](?:{_LETTER}|['’-])+(?![\w\d]))?(?!\w)"
_WORDS = rf"[{_UP}](?:{_LETTER}|['’-])*\.?(?: [{_UP}](?:{_LETTER}|['’-])*\.?)*"
_ADDRESS = re.compile(
    rf"(?:Flat|FLAT|Unit|Apt\.?|Apartment) \d+\w?, \d+\w? {_WORDS}, {_TOWN} [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}(?!\w)"
    rf"|\d+\w? {_WORDS}, {_TOWN} [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}(?!\w)"
    rf"|\d+\w?(?: (?:bis|ter|quater))?,? (?i:rue|avenue|place|chemin|impasse|boulevard|allée|quai|route) (?:(?:des|de la|du|de|aux) |de l['’]|d['’])?{_WORDS}, \d{{5}} {_TOWN}"
    rf"|(?i:Calle|Avenida|Plaza|Paseo|Camino|C/) ?(?:(?:de la|de los|de las|del|de) )?{_WORDS},? \d+\w?(?:, [\w.ºª° ]{{1,10}}?)?, \d{{5}} {_TOWN}"
    rf"|(?:(?:Am|An der|Auf der|Auf dem|Im|In der|Zum|Zur|Alte|Alter|Unter den) )?{_WORDS} \d+ ?[a-zA-Z]?, (?:[A-Z]{{1,2}}-)?\d{{5}} {_TOWN}"
    rf"|\d+\w? (?:[NSEW]\. |North |South |East |West )?{_WORDS}(?:,? (?:Unit|Apt\.?|Suite|Ste\.?|No\.|#) ?\w+)?, {_TOWN}(?:,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?| \d{{5}}(?:-\d{{4}})?)?"
)


class Finder:
    """Finds personal information in a batch of texts. ``roster``: (given, family) names.

    ``open_names``: a capitalised word after or before a given part is a candidate for a list
    that is elsewhere; candidates come out with the type ``CANDIDATE``.
    """

    def __init__(self, roster: Iterable[tuple[str | None, str | None]] = (), open_names: bool = False) -> None:
        import ahocorasick

        found: dict[str, set[str]] = {}
        for kind, words in ((NAME, TITLES + NAME_LABELS), (PHONE, PHONE_LABELS), (ID, ID_LABELS), (ADDRESS, ADDRESS_LABELS), (EMAIL, AT_SIGNS), (BIRTH_DATE, BIRTH_LABELS), ("given", tuple(g + " " for g in GIVEN_NAMES))):
            for w in words:
                found.setdefault(w, set()).add(kind)
        for _, family in roster:
            if family and family.strip():
                found.setdefault(family.strip().lower(), set()).add("roster")
        self.open_names = open_names
        self.automaton = ahocorasick.Automaton()
        for w, kinds in found.items():
            self.automaton.add_word(w, (len(w), tuple(sorted(kinds))))
        self.automaton.make_automaton()

    def spans(self, joined: str) -> list[tuple[int, int, str]]:
        """(start, end, type) in a text or in texts joined by NUL, without overlaps."""
        low = joined.lower()
        if len(low) != len(joined):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in joined)
        out: list[tuple[int, int, str]] = []
        for last, (length, kinds) in self.automaton.iter(low):
            end, start = last + 1, last + 1 - length
            for kind in kinds:
                if kind == EMAIL:
                    if (m := _DOMAIN.match(joined, end)) and (n := _LOCAL.search(joined, max(0, start - 80), start)):
                        out.append((n.start(), m.end(), EMAIL))
                    continue
                if start and (joined[start - 1].isalnum() or joined[start - 1] == "_"):
                    continue
                if kind == NAME:
                    if (m := _NAME.match(joined, end)) and not _NO_NAME.search(m[1]):
                        out.append((m.start(1), m.end(1), NAME))
                elif kind == PHONE:
                    if (m := _PHONE_BARE.match(joined, end)) and sum(c.isdigit() for c in m[0]) > 6:
                        out.append((m.start(), m.end(), PHONE))
                elif kind == ID:
                    at = _ID_LEAD.match(joined, end).end()
                    if at > end or joined[end - 1] in "# ":
                        if m := _ID_VALUE.match(joined, at):
                            out.append((m.start(), m.end(), ID))
                elif kind == ADDRESS:
                    if m := _ADDRESS.match(joined, end):
                        out.append((m.start(), m.end(), ADDRESS))
                elif kind == BIRTH_DATE:
                    if m := _BIRTH.match(joined, end):
                        out.append((m.start(), m.end(), BIRTH_DATE))
                elif not joined[start : start + 1].isupper():
                    continue
                elif kind == "given":
                    if (m := _FAMILY_AFTER.match(joined, end)) and m[1].lower() not in NO_FAMILY and not _NO_NAME.search(m[0]):
                        out.append((start, m.end(), LISTED))
                elif not joined[end : end + 1].isalnum():
                    if span := self._listed(joined, start, end):
                        out.append(span)
        for pattern in (_PHONE_US, _PHONE_INTL):
            out += [(m.start(), m.end(), PHONE) for m in pattern.finditer(joined)]
        settled = _settle(out)
        return settled if not self.open_names else self._with_candidates(joined, settled)

    def _listed(self, text: str, start: int, end: int) -> tuple[int, int, str] | None:
        """The full name around a listed family name; a family name alone is no person."""
        before = _GIVEN_BEFORE.search(text, max(0, start - 48), start)
        if before and not _NO_NAME.search(before[1]):
            first, _, initial = before[1].rstrip().partition(" ")
            if first.lower() not in _COMMON:
                return before.start(1), end, LISTED
            if initial:  # a title or label before the initial is no given name
                return before.start(1) + len(first) + 1, end, LISTED
        if after := _GIVEN_AFTER.match(text, end):
            return start, after.end(), LISTED
        return None

    def _with_candidates(self, text: str, settled: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Adds every place that would be a name if its family were listed, unless it overlaps."""
        out, starts = list(settled), [s for s, _, _ in settled]
        for m in _CAPITAL.finditer(text):
            if span := self._listed(text, m.start(), m.end()):
                k = bisect_right(starts, span[0])
                if (k and settled[k - 1][1] > span[0]) or (k < len(settled) and settled[k][0] < span[1]):
                    continue
                out.append((span[0], span[1], f"{CANDIDATE}{m[0].lower()}"))
        return out


#: Type of a candidate, before its family name.
CANDIDATE = "?"
_CAPITAL = re.compile(rf"(?<![\w]){_N}(?!\w)")
_FAMILY_AFTER = re.compile(rf"(?:[{_UP}]\. )?({_N})(?![\w@])")
_BIRTH = re.compile(r"(?:\d{4}-\d\d-\d\d|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w)")
_GIVEN_BEFORE = re.compile(rf"(?<![\w.])({_N} (?:[{_UP}]\. )?|[{_UP}]\. )$")
_GIVEN_AFTER = re.compile(rf", {_N}(?: [{_UP}]\.(?!\w))?(?!\w)")
_NO_NAME = re.compile(r"\d")
_COMMON = set("the von der die das el la le les los las am im in an and und y et konto account user".split()) | {w.split()[-1].strip(".:=") for w in TITLES + NAME_LABELS}
#: A name that a list tells, not a label; it gives way to all that is told by its context.
LISTED = "listed"


def _settle(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Drops overlaps: the kind that is told by more context wins, then the longer span."""
    rank = {EMAIL: 0, ADDRESS: 1, ID: 2, BIRTH_DATE: 3, PHONE: 4, NAME: 5, LISTED: 6}
    kept: list[tuple[int, int, str]] = []
    by_start = sorted(set(spans), key=lambda s: (rank[s[2]], s[0] - s[1], s[0]))
    taken: list[tuple[int, int]] = []
    for s in by_start:
        i = bisect_right(taken, (s[0], 1 << 62))
        if (i and taken[i - 1][1] > s[0]) or (i < len(taken) and taken[i][0] < s[1]):
            continue
        taken.insert(i, (s[0], s[1]))
        kept.append(s)
    return sorted((a, b, NAME if kind == LISTED else kind) for a, b, kind in kept)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """A typed placeholder whose pseudonym depends on key and value alone."""
    if kind == PHONE:
        m = re.match(r"(?:\+|00)(\d{1,2})", value)
        keep = len(re.sub(r"\D", "", m[0])) if m else 0
        return f"{{PHONE_{feistel.permute_number(value, key, keep)}}}"
    if kind == ID:
        return f"{{ID_{feistel.permute_identifier(value, key)}}}"
    if kind == BIRTH_DATE:
        return f"{{BIRTH_DATE_{feistel.permute_written_date(value, key)}}}"
    plain = re.sub(r"\s+", " ", value).strip().lower()
    if kind == EMAIL:
        plain = re.sub(r" ?(?:\[at\]|\(at\)|\{at\}|<at>|%40|@) ?", "@", plain)
        plain = re.sub(r" ?[\[({]dot[\])}] ?", ".", plain)
    elif kind == NAME and ", " in plain:
        family, given = plain.split(", ", 1)
        plain = f"{given} {family}"
    return f"{{{ {NAME: 'NAME', EMAIL: 'EMAIL', ADDRESS: 'ADDRESS'}[kind] }_{feistel.code(plain, key)}}}"


_PIECE = 1 << 21


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], str]]:
    """Non-null texts joined by NUL, some megabytes at a time: (row numbers, starts, joined)."""
    rows: list[int] = []
    starts: list[int] = []
    parts: list[str] = []
    at = 0
    for i, t in enumerate(texts):
        if t:
            rows.append(i)
            starts.append(at)
            parts.append(t)
            at += len(t) + 1
            if at > _PIECE:
                yield rows, starts, "\0".join(parts)
                rows, starts, parts, at = [], [], [], 0
    if rows:
        yield rows, starts, "\0".join(parts)


def find_batch(finder: Finder, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, str]]:
    """(row, start, end, type, value) over a batch of texts."""
    for rows, starts, joined in _pieces(texts):
        for s, e, kind in finder.spans(joined):
            k = bisect_right(starts, s) - 1
            if k + 1 < len(starts) and e > starts[k + 1] - 1:
                continue
            yield rows[k], s - starts[k], e - starts[k], kind, joined[s:e]


_HELD: list = []


def _finder(roster, open_names: bool = False) -> Finder:
    """The automaton of a broadcast list, built once per worker process."""
    if not _HELD or _HELD[0] != (roster.value, open_names):
        _HELD[:] = [(roster.value, open_names), Finder(roster.value, open_names)]
    return _HELD[1]


def _find(roster, open_names: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(roster, open_names)
        for batch in batches:
            tables, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            once = dict.fromkeys((tables[r], ids[r], kind, value) for r, _, _, kind, value in find_batch(finder, batch.column(2).to_pylist()) if kind != BIRTH_DATE)
            columns = list(zip(*once, strict=True)) if once else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["table_name", "row_id", "pii_type", "pii_text"])

    return run


def _redact(roster, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(roster)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            parts: dict[int, list[str]] = {}
            done: dict[int, int] = {}
            counts = [0] * len(texts)
            for row, s, e, kind, value in find_batch(finder, texts):
                parts.setdefault(row, []).extend((texts[row][done.get(row, 0) : s], placeholder(kind, value, key)))
                done[row] = e
                counts[row] += 1
            for row, held in parts.items():
                texts[row] = "".join(held) + texts[row][done[row] :]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["table_name", "row_id", "redacted", "n_found"])

    return run


#: Names of a reference list that go to every task; longer lists are joined.
MOST_NAMES = 200_000


def roster_names(roster: DataFrame, most: int = MOST_NAMES) -> tuple | None:
    """(given, family) pairs of a reference list, or None if it has more than ``most``: then it
    does not go to every task, see ``find_pii``."""
    names = tuple((r[0], r[1]) for r in roster.select("given_name", "family_name").distinct().limit(most + 1).collect())
    return names if len(names) <= most else None


def _texts(df: DataFrame, table: str, key: str, text: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("text"))


def find_pii(df: DataFrame, table: str, key: str, text: str, roster: tuple = (), families: DataFrame | None = None) -> DataFrame:
    """FOUND_SCHEMA, each value once per row key. Null, empty and blank texts have none; null
    keys stay null; other columns are ignored whatever their names.

    ``roster``: (given, family) pairs that are sent to every task. ``families``: a reference list
    of any length instead, as a frame with ``family_name``; names that would count if they were listed are joined
    with it, and where two listed names overlap both come out.
    """
    context = df.sparkSession.sparkContext
    texts = _texts(df, table, key, text).where("length(text) > 0")
    if families is None:
        return texts.mapInArrow(_find(context.broadcast(tuple(roster))), FOUND_SCHEMA)
    found = texts.mapInArrow(_find(context.broadcast(()), True), FOUND_SCHEMA)
    listed = families.select(F.lower(F.trim("family_name")).alias("_family")).where("_family <> ''").distinct()
    is_candidate = F.col("pii_type").startswith(CANDIDATE)
    named = found.where(is_candidate).withColumn("_family", F.substring("pii_type", len(CANDIDATE) + 1, 1 << 30)).join(listed, "_family", "left_semi")
    return found.where(~is_candidate).unionByName(named.select("table_name", "row_id", F.lit(NAME).alias("pii_type"), "pii_text"))


def redact(df: DataFrame, table: str, key: str, text: str, pseudonym_key: bytes, roster: tuple = ()) -> DataFrame:
    """TEXT_SCHEMA, one row per input row: the text with typed placeholders, all else unchanged.

    ``pseudonym_key``: who has it can link and, for numbers and dates, invert; it has no default.
    """
    if not pseudonym_key:
        raise ValueError("a pseudonym key is needed")
    context = df.sparkSession.sparkContext
    return _texts(df, table, key, text).mapInArrow(_redact(context.broadcast(tuple(roster)), pseudonym_key), TEXT_SCHEMA)
