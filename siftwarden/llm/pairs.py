"""Broken prompt and answer pairs, with the first defect that fits.

``empty``: no content, whatever its wrapping. ``copy``: a suffix automaton of the prompt
measures how much of the answer is copied from it and which part of the prompt is given back.
``refusal``: an automaton over the whole prose of the answer, quotations left out, knows how
refusals are phrased. ``truncated``: a stack of delimiters is open at the end, or prose has no end.
``other_language``: stopwords of the answer's own prose vote for another language than those
of the instruction. The parser's error column is no evidence and is not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import deepjson

DEFECT_SCHEMA = "result_id bigint, defect string"
EMPTY, COPY, REFUSAL, TRUNCATED, OTHER = "empty", "copy", "refusal", "truncated", "other_language"

# -- what an answer holds -------------------------------------------------------------------

_INVISIBLE = re.compile("[​-‏  ⁠-⁤﻿­\x00]")
_FENCE = re.compile(r"^`{3,}[ \t]*[\w+-]*[ \t]*(?:\r?\n|$)|^`{3,}")
_NOTHING = {"", "null", "none", "nil", "undefined", "nan", "n/a", "na"}


def unwrapped(raw: str) -> str:
    """An answer without surrounding white space, invisible characters and code fences."""
    body = _INVISIBLE.sub("", raw).strip()
    while body.startswith("```"):
        body = _FENCE.sub("", body, count=1)
        body = re.sub(r"\s*`{3,}\s*$", "", body).strip()
    return body


def _leaves(value: object, out: list) -> list:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack.extend(reversed(v.values()))
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif v is not None:
            out.append(v)
    return out


_BAD = object()


def parsed(body: str) -> object:
    """The JSON value of a body, through quoted JSON; _BAD if it is none."""
    value: object = body
    while isinstance(value, str) and value[:1] in ("{", "[", '"') or value == "null":
        try:
            value = deepjson.loads(value)
        except ValueError:
            return _BAD if value is body else value
    return _BAD if value is body else value


def _has_content(leaf: object) -> bool:
    if isinstance(leaf, str):
        return unwrapped(leaf).lower() not in _NOTHING and any(c.isalnum() for c in leaf)
    return True


# -- copy -----------------------------------------------------------------------------------


class SuffixAutomaton:
    """All substrings of a text; each state knows its length and one place where it ends."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for i, c in enumerate(text):
            state = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(i + 1)
            self.end.append(i + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[state] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    self.end.append(self.end[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[state] = clone
            last = state

    def matches(self, other: str, least: int) -> Iterator[tuple[int, int, int]]:
        """Maximal common substrings of at least ``least``: (end in other, end here, length)."""
        state, size = 0, 0
        for i, c in enumerate(other):
            before, reached = size, state
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size <= before and before >= least:
                yield i, self.end[reached], before
        if size >= least:
            yield len(other), self.end[state], size


def _covered(spans: list[tuple[int, int]], low: int, high: int) -> int:
    total, at = 0, low
    for s, e in sorted(spans):
        s, e = max(s, at), min(e, high)
        if e > s:
            total += e - s
            at = e
    return total


_QUOTE_MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)


def _bare(text: str) -> str:
    return "".join((_QUOTE_MARK.sub("", text) if ">" in text else text).split()).lower()


LEAST = 24
#: The longest run of at least LEAST characters that may hold no more than one aligned block.
_A_BLOCK = 3 * (LEAST // 2) - 2


def copied_shares(prompt: str, answer: str, finding: tuple[int, int] | None = None, least: int = LEAST) -> tuple[float, float, float]:
    """(share of the answer copied, share of the prompt given back, share of its finding).

    Texts without white space and case; ``finding`` is the span of the finding in the prompt.
    Substrings shorter than ``least`` do not count.
    """
    if not prompt or not answer:
        return 0.0, 0.0, 0.0
    here, there = [], []
    for end, place, size in SuffixAutomaton(prompt).matches(answer, least):
        there.append((end - size, end))
        here.append((place - size, place))
    whole = _covered(here, *finding) / (finding[1] - finding[0]) if finding else 0.0
    return _covered(there, 0, len(answer)) / len(answer), _covered(here, 0, len(prompt)) / len(prompt), whole


def is_copy(prompt: str, variants: list[str], share: float = 0.9) -> bool:
    """True if the prompt, or its whole finding, is given back in one of the variants.

    A prompt of fewer than ``LEAST`` characters must make up that share of the answer. An answer
    shorter than that share of the prompt gives neither back. Then a cheap bound comes first. A run
    of ``LEAST`` or more characters holds aligned blocks of half that length, one for every
    ``_A_BLOCK`` characters at least. Of the runs that cover a part of the prompt, some cover it
    with no place in more than two of them. So, of the prompt's aligned blocks, the answer has
    at least one for every ``2 * _A_BLOCK`` characters that are given back.
    """
    bare = _bare(prompt)
    half = LEAST // 2
    span = None
    if len(bare) >= LEAST and (cut := deepjson.first_object(prompt)) and cut[1] - cut[0] > LEAST:
        head = len(_bare(prompt[: cut[0]]))
        span = (head, head + len(_bare(prompt[cut[0] : cut[1]])))
    must = share * min(len(bare), span[1] - span[0] if span else len(bare))
    for variant in variants:
        if 2 * len(variant) < must:  # lower case has at most twice as many characters
            continue
        answer = _bare(variant)
        if len(bare) < LEAST:
            # Too short for runs: the answer is the prompt and hardly anything else.
            if bare in answer and len(bare) >= share * len(answer):
                return True
            continue
        if len(answer) < must:
            continue
        blocks = sum(bare[i : i + half] in answer for i in range(0, len(bare) - half + 1, half))
        if blocks * 2 * _A_BLOCK < must:
            continue
        _, back, finding = copied_shares(bare, answer, span)
        if back >= share or finding >= share:
            return True
    return False


# -- refusal --------------------------------------------------------------------------------

# How refusals are phrased, in en, de, fr, es, ja. Each is a pattern over lower
# case with straight apostrophes; the first person or the request itself is always named.
REFUSALS = [
    r"\bi(?: am|'m)? ?(?:really |truly |very |so )?(?:sorry|afraid)\b[^.]{0,40}\b(?:can't|cannot|can not|unable|not able|won't|not permitted|not allowed|must)",
    r"\bi (?:can't|cannot|can not|could not|couldn't|won't|will not|am unable|am not able|must|have to|would rather not|shouldn't|should not)\b[^.]{0,25}\b(?:help|assist|answer|provide|comply|continue|evaluate|assess|analy[sz]e|judge|discuss|fulfil|fulfill|produce|process|respond|decline|refuse|share|support|complete|do (?:that|this)|engage)",
    r"\bi(?: am|'m) (?:unable|not able|not permitted|not allowed|not authori[sz]ed|not in a position|not comfortable|prohibited)\b",
    r"\bi (?:must|have to|need to|respectfully|politely|would like to)? ?(?:decline|refuse)\b(?! the\b)",
    r"\bi (?:don't|do not) feel comfortable\b",
    r"\bas an? (?:ai|language model|large language model|artificial intelligence|assistant|ai assistant)\b[^.]{0,40}\b(?:not|cannot|can't|unable|won't)\b",
    r"\b(?:this|your|the|that) (?:request|prompt|question|content) (?:goes against|violates|is against|is not something i|falls outside|cannot be|can't be|is outside)\b",
    r"\bagainst my (?:guidelines|policy|policies|principles|instructions|rules)\b",
    r"\bno answer can be given\b|\bfor safety reasons\b|\bnot something i(?:'m| am| can)\b|\bsomething i(?:'m| am) not (?:permitted|allowed|able)\b",
    r"\bit (?:would|is|wouldn't|would not)(?: not)? be (?:appropriate|right|proper|responsible) for me\b|\bit(?:'s| is) not appropriate for me\b",
    r"\bmy apologies\b[^.]{0,60}\b(?:can't|cannot|can|unable|not)\b|\bsorry, (?:but )?(?:that|this|i|no)\b[^.]{0,40}\b(?:not|can't|cannot|won't|unable)\b",
    r"\bals (?:ki|sprachmodell|ki-modell|assistent|ki-assistent|künstliche intelligenz)\b",
    r"\b(?:tut mir leid|bedaure|bedauere|entschuldigung|leider)\b[^.]{0,60}\b(?:kann|darf|möchte|werde)\b[^.]{0,30}\bnicht\b|\b(?:leider )?(?:kann|darf|möchte|werde) ich\b[^.]{0,40}\b(?:nicht|keine)\b|\bich (?:kann|darf|möchte|werde|muss)\b[^.]{0,50}\b(?:nicht (?:beantworten|helfen|bewerten|beurteilen|unterstützen|weiterhelfen|einschätzen)|keine (?:einschätzung|auskunft|antwort|bewertung)|ablehnen)\b|\bdarf ich nicht\b|\bnicht in der lage\b[^.]{0,30}\b(?:anfrage|bewerten|helfen)|\bdiese anfrage\b[^.]{0,40}\bnicht\b|\bverstößt gegen (?:meine|die) (?:richtlinien|regeln|vorgaben)\b|\bich bin nicht (?:berechtigt|befugt|in der lage)\b",
    r"\bje (?:ne )?(?:peux|puis|suis|dois|veux|souhaite)\b[^.]{0,25}\b(?:pas|refuser|décliner)\b[^.]{0,60}|\bje (?:refuse|décline)\b|\ben tant qu(?:e |')(?:ia|modèle|assistant|intelligence)|\bdésolé(?:e)?\b[^.]{0,60}\b(?:pas|impossible|aucune)\b|\bil (?:ne )?m'est (?:pas |impossible|interdit)|\bcette demande\b[^.]{0,40}\b(?:contraire|enfreint|ne (?:peut|respecte))",
    r"\bno (?:puedo|podré|me es posible|me está permitido|estoy autorizad[oa]|estoy en condiciones|soy capaz|debo|quiero)\b|\blo siento\b[^.]{0,60}\bno\b|\bcomo (?:modelo|ia|asistente|inteligencia)\b|\b(?:debo|tengo que|prefiero) (?:rechazar|declinar|negarme)|\besta (?:petición|solicitud)\b[^.]{0,40}\b(?:infringe|incumple|va en contra|no puede)|\bno puede darse respuesta\b|\bva en contra de mis\b",
    r"お答えできません|回答できません|お手伝いできません|対応できません|できかねます|申し訳(?:ありません|ございません)が|お断り",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))


def is_refusal(prose: str) -> bool:
    """True if the text declines anywhere. Quoted text does not count."""
    return _REFUSAL.search(_QUOTED.sub(" ", prose).replace("’", "'").lower()) is not None


# -- truncation -----------------------------------------------------------------------------

_DELIMITER = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
_CLOSED = re.compile(r"[.!?…。！？]['\"”»’)\]*_`]*$|[)\]}>\"”»`|]$")
_PAIRS = {"}": "{", "]": "["}


def is_cut(body: str) -> bool:
    """True if JSON has open delimiters at its end, or prose stops without an end mark."""
    if body[:1] in ("{", "["):
        stack = []
        for m in _DELIMITER.finditer(body):
            c = m[0]
            if c in ("{", "["):
                stack.append(c)
            elif c in _PAIRS:
                if stack and stack[-1] == _PAIRS[c]:
                    stack.pop()
            elif c == '"':
                return True
        return bool(stack)
    return _CLOSED.search(body) is None


# -- language -------------------------------------------------------------------------------

# Frequent words, and letters that few of the languages have.
STOPWORDS = {
    "en": "the and was were with from that this which for has have had been are is by although because what who how should of to on it its their they would could after before into only not without then please yet as at an or than near between if while there once until took opened within times since through under over about each other both more most found kept linked fired failed remains reported expires asked needs still against".split(),
    "de": "der die das und ist war wurde mit von dem den des ein eine einen einem für auf nicht sich auch nach bei aus zu zur zum im am als wird werden haben hat sind obwohl weil nachdem vor über unter durch noch keine diesem dieser diesen dieses diese bis bitte wir um an soll falls ab genau rund".split(),
    "fr": "le la les des du et est était une un avec pour dans par sur que qui au aux ce cette ces pas ne sont ont été sans mais ou sa son ses leur depuis après avant même quand plus d l s c n a à de en nous merci entre doit se".split(),
    "es": "el la los las del y es era una un con para en por que se al lo su sus no pero aunque sin desde hasta entre sobre tras como más está están fue ha han este esta estos tiene antes a de hacia según conviene debe hemos cerca falta todo toda todos todas sigue siguen cada muy también puede solo ya cuando donde porque".split(),
    "pt": "o os as um uma uns umas do da dos das no na nos nas ao aos à às e é foi são está não com para por pelo pela que se mais mas como em entre sobre após antes já sem embora então ou seu sua isso esta este foram pois de a".split(),
    "it": "il lo la i gli le un una uno di del della dei delle degli al alla ai alle e è sono era con per da dal dalla in nel nella nei su sul sulla che non si più ma come anche dopo prima già senza tra fra questo questa ha hanno stato stata perché quindi".split(),
    "nl": "de het een en is was zijn waren met van voor op in te om bij uit naar door over niet ook nog maar als dat die deze dit werd wordt hebben heeft omdat terwijl na tot geen meer vanaf onder er".split(),
    "pl": "i w z na do od po dla przez przy oraz się nie jest są był była było były że który która które ten ta to jak ale więc o za ze pod przed już tylko także jego jej ich ponieważ gdy".split(),
    "sv": "och i att det som en ett på är av för med den till inte om har de från vid var men eller efter innan under också när över blev utan mellan så kan".split(),
    "da": "og i at det som en et på er af for med den til ikke om har de fra ved var men eller efter før under også når over blev uden mellem så kan der".split(),
    "fi": "ja on ei se että joka oli ovat kuin mutta tai sekä kun myös vain jo ennen jälkeen mukaan ole olivat siitä sen tämä".split(),
    "cs": "a v z na do od po pro při se si je jsou byl byla bylo byly že který která které ten ta to jak ale o za ze pod před už jen také jeho její jejich protože když není podle".split(),
    "tr": "ve bir bu ile için da de olarak çok daha ama gibi kadar sonra önce her değil olan oldu ise veya göre".split(),
}
LETTERS = {"ja": "", "de": "ßäöü", "fr": "éèêœçàùûîâ", "es": "ñ¿¡óíáéú", "pt": "ãõçáéíóâê", "it": "òìàùè", "pl": "ąćęłńśźż", "sv": "åäö", "da": "æøå", "cs": "ěščřžýů", "tr": "ğışç", "fi": "äö", "nl": "ĳ"}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)
_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"\"[^\"]{12,}\"|«[^»]{12,}»|„[^“”]{12,}[“”]|“[^”]{12,}”")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[぀-ヿ一-鿿]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff぀-ヿ㐀-鿿]")
DIRECTIVES = {"en": r"\bin english\b|\bauf englisch\b|\ben anglais\b|\ben inglés\b", "de": r"\bauf deutsch\b|\bin german\b|\ben allemand\b|\ben alemán\b", "fr": r"\ben français\b|\bin french\b|\bauf französisch\b|\ben francés\b", "es": r"\ben español\b|\bin spanish\b|\bauf spanisch\b|\ben espagnol\b", "ja": r"日本語で|\bin japanese\b|\bauf japanisch\b"}
_DIRECTIVES = [(lang, re.compile(p, re.I)) for lang, p in DIRECTIVES.items()]


_CODED = re.compile(r"[\d_@]")
_LETTER_VOTES = {c: [lang for lang, cs in LETTERS.items() if c in cs] for cs in LETTERS.values() for c in cs}
_MARKED = re.compile("[" + "".join(_LETTER_VOTES) + "]")
_SCRIPTS = [("ru", re.compile("[\u0400-\u04ff]")), ("el", re.compile("[\u0370-\u03ff]")), ("ko", re.compile("[\uac00-\ud7af]")), ("ar", re.compile("[\u0600-\u06ff]")), ("he", re.compile("[\u0590-\u05ff]"))]


def votes(text: str) -> dict[str, float]:
    """Votes per language; a word or letter of several languages is shared between them."""
    low = text.lower()
    if _CODED.search(low):
        low = " ".join(w for w in low.split() if w.isalpha() or not _CODED.search(w))
    out = dict.fromkeys(STOPWORDS, 0.0)
    for w in _WORD.findall(low):
        if w in _VOTES:
            for lang in _VOTES[w]:
                out[lang] += 1 / len(_VOTES[w])
    if not text.isascii():
        for c in _MARKED.findall(low):
            for lang in _LETTER_VOTES[c]:
                out[lang] = out.get(lang, 0.0) + 0.7 / len(_LETTER_VOTES[c])
        for lang, script in _SCRIPTS:
            if n := len(script.findall(text)):
                out[lang] = n / 4
        letters = len(_HAN.findall(text))
        if letters > 5:
            out["ja" if _KANA.search(text) else "zh"] = letters / 2
    return out


def language(text: str) -> str:
    """The language with most votes (ties go to the first listed), '' without any vote."""
    found = votes(text)
    best = max(found, key=found.__getitem__)
    return best if found[best] > 0 else ""


def is_other_language(asked: str, prose: str, least: float = 0.5, lead: float = 1.5) -> bool:
    """True if the votes of another language are ``lead`` times those of the one asked for."""
    found = votes(prose)
    best = max(found.values())
    return best >= least and best > lead * found.get(asked, 0.0)


_INSTRUCTION_LANGUAGE: dict[str, str] = {}


def instruction_language(prompt: str) -> str:
    """Language of a prompt's instruction: a directive names it, else stopwords vote."""
    span = prompt.find("{")
    head = prompt[:span] if span > 0 else prompt
    known = _INSTRUCTION_LANGUAGE.get(head)
    if known is None:
        known = next((lang for lang, p in _DIRECTIVES if p.search(head)), "") or language(head)
        if len(_INSTRUCTION_LANGUAGE) < 10_000:  # a memo only
            _INSTRUCTION_LANGUAGE[head] = known
    return known


# -- together -------------------------------------------------------------------------------


def _is_prose(text: str) -> bool:
    """True for text of several words, or in a script that puts no spaces between them."""
    return " " in text or _UNSPACED.search(text) is not None


def defect(prompt: str, raw: str | None) -> str | None:
    """The first defect that fits, or None. A null answer is empty; a blank prompt is no pair."""
    body = "" if raw is None else unwrapped(raw)
    if body.lower() in _NOTHING or not any(c.isalnum() for c in body):
        return EMPTY
    value = parsed(body)
    leaves = [] if value is _BAD else _leaves(value, [])
    if value is not _BAD and not any(map(_has_content, leaves)):
        return EMPTY
    texts = [x for x in leaves if isinstance(x, str) and _is_prose(x)] if value is not _BAD else [body]
    if is_copy(prompt, [body, *(x for x in texts if x is not body)]):
        return COPY
    prose = " ".join(texts)
    if value is _BAD and body[:1] in ("{", "["):
        prose = " ".join(x for x in re.findall(r'"((?:[^"\\]|\\.)*)(?:"|$)', body) if _is_prose(x))
    if any(map(is_refusal, texts if value is not _BAD else [prose])):
        return REFUSAL
    if value is _BAD and is_cut(body):
        return TRUNCATED
    asked = instruction_language(prompt)
    return OTHER if asked and is_other_language(asked, _QUOTED.sub(" ", prose)) else None


def _defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds = [], []
        for i, prompt, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if kind := defect(prompt, raw):
                ids.append(i)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["result_id", "defect"])


def broken_pairs(results: DataFrame) -> DataFrame:
    """DEFECT_SCHEMA: defective pairs among model calls, each once.

    A pair has a non-blank prompt and source ``llm`` or ``fallback`` (trimmed, any case); other
    rows are filtered in the scan. Null ids are kept; extra columns are ignored.
    """
    blank = r"^[\s\p{Z}]*$"
    pairs = results.where(F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).isin("llm", "fallback") & F.col("prompt").isNotNull() & ~F.col("prompt").rlike(blank))
    return pairs.select(F.col("result_id").cast("bigint").alias("result_id"), F.col("prompt").cast("string").alias("p"), F.col("raw").cast("string").alias("r")).mapInArrow(_defects, DEFECT_SCHEMA).distinct()
