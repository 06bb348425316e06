"""Problem 1: sentence boundaries across languages and scripts.

Rules on the Unicode sentence-break properties, taken for all scripts from the property tables of the ``regex`` library:
terminators that end a sentence (STerm), the full stop whose effect depends on its surroundings (ATerm), closing marks
that belong to the sentence before them (Close) and separators (Sep). On top of them come

* abbreviations of the language that a passage is in, in three kinds: never last in a sentence, last only before a
  capital, abbreviation only before a number. The language is told by the common words around the full stop, or by those
  of the whole text; where there are none, and for titles and the like that many languages share, all lists hold;
* numbers: decimals, dates and German ordinals;
* quotations and parentheses, which are skipped as wholes; whether a sentence ends with the closing mark depends on
  where the quotation began and on what follows;
* lines: headings and list items are units, other line ends are white space unless a blank line follows;
* Thai, which has no terminator: a space between two Thai letters ends a sentence.

One regular expression finds the marks. Each is decided from its surroundings; pairs of brackets are matched in one pass
over a block, so that the scan stays linear in the text however long its sentences and quotations are.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by language, lower case, without the last full stop.
#: Never the last word of a sentence.
NEVER_LAST = {
    "en": "dr prof mr mrs ms st vs e.g i.e viz cf approx resp thm def eq fig figs sec secs chap ch pp vol ex prop cor rem lem w.r.t ca incl dept gen col sen rev hon mon tue wed thu fri sat sun jan feb apr jun jul aug sep sept oct nov dec",
    "de": "dr prof hr fr hrn frl bzw z.b z.t u.u d.h d.i s.o s.u m.e i.a i.d.r o.ä sog ggf evtl engl vgl abb abschn kap gem inkl exkl ca hrsg aufl bd tab bsp bspw ungef insb bes allg lat griech frz max min mind zw nr st str dipl ing nat o.b.d.a",
    "fr": "mme mlle m mm dr pr prof p.ex c.-à-d cf chap fig éd av env art vol janv févr avr juil sept oct nov déc",
    "es": "dr dra sr sra srta d da prof p.ej cf cap fig pág págs núm vol aprox ej ed art",
    "it": "sig sig.ra sigg dott prof ad.es p.es cfr fig pag pagg cap vol es art",
    "pt": "sr sra dr dra prof p.ex cf cap fig pág págs núm vol aprox ex art ed",
    "nl": "dr prof dhr mevr mr ir drs bijv d.w.z m.b.t t.o.v o.a i.p.v par blz fig nr hfst vgl zgn ca evt resp",
    "ru": "т.е т.к т.н проф акад доц см ср рис табл гл стр г-н г-жа им напр с п",
    "hi": "डॉ प्रो श्री सु",
    "ar": "د أ ص م ج",
    "th": "ดร ศ รศ ผศ นาย",
}
#: The last word of a sentence where a capital or no cased letter follows.
MAYBE_LAST = {
    "en": "etc al inc ltd co corp jr sr a.m p.m a.e i.i.d u.s u.k ph.d b.sc m.sc bros seq ibid",
    "de": "usw etc ff f u.a u.ä u.v.m o.g a.a.o a.d n.chr v.chr gmbh e.v",
    "fr": "etc",
    "es": "etc",
    "it": "ecc",
    "pt": "etc",
    "nl": "enz etc e.d e.a",
    "ru": "др пр т.д т.п г гг в вв",
}
#: Abbreviations only before a number; otherwise words of their own, or ends of a sentence.
BEFORE_NUMBER = {
    "en": "no nos p art par line",
    "de": "abs s art nr rn bl",
    "fr": "p n",
    "es": "p núm",
    "it": "p n",
    "pt": "p n",
    "nl": "p nr",
    "ru": "с п № ст",
}
#: Entries that are words of the language too: in lower case before a capital they end a sentence.
WORDS_TOO = {
    "en": "sat sun mon mar wed fri sec secs ex gen col sen rev hon prop rem cor fig figs",
    "fr": "art env",
    "es": "da art",
    "it": "es cap art",
    "pt": "art ex",
    "nl": "par",
}
#: Common words by which the language of a passage is told.
COMMON_WORDS = {
    "en": "the a an of and is are was were it this that these we you he she they in on at to for with not be as by from or but so if there then its his her what which will can has have do does all now one",
    "de": "der die das den dem des ein eine einen einem einer und ist sind war wir sie er es ich nicht mit von zu im in auf für auch sich dass wenn als wie was dann so nur noch hat wird werden kann bei aus nach über zum zur oder aber daraus",
    "fr": "le la les un une des du de et est sont était nous vous il elle ils elles on ce cette ces que qui dans en sur pour pas ne avec au aux par plus se sa son ses mais ou où donc si car comme",
    "es": "el la los las un una unos de del y es son era nosotros que en por para con no se su sus lo al como más pero o si ya hay esta este esto ella él cuando sobre entonces",
    "it": "il lo la i gli le un una di del della dei delle e è sono era noi che in per con non si su da al alla come più ma o se anche questo questa quando cosa ci nel nella dal",
    "pt": "o a os as um uma de do da dos das e é são era nós que em por para com não se seu sua no na nos nas ao à como mais mas ou também já isto este esta quando ele ela",
    "nl": "de het een en is zijn was waren we wij je hij zij ze dat die dit deze in op voor met van te aan niet ook als om er nog maar of dan bij naar uit over wordt worden kan heeft daarna wat",
}
#: Words before a German ordinal or date.
ORDINAL_CUES = frozenset("der die das dem den des am im zum zur vom beim und oder bis ab seit jeder jede jedes dieser diese dieses".split())
#: Lower-case words between which and a name initials stand.
NAME_LINKS = frozenset("and und et y e en и by par por da door".split())
#: Single lower-case letters that open an abbreviation of several parts.
PARTS = frozenset("zudpsmoivaeотсn")
#: Japanese particles and verbs that carry a sentence on after a quotation.
QUOTATIVE = ("と", "って", "という", "など", "を", "は", "が", "に", "の", "も", "で")
# End of the fixed values.

_EVERY = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def _having(name: str) -> str:
    return "".join(regex.findall(rf"\p{{Sentence_Break={name}}}", _EVERY))


def _by_word(table: dict[str, str]) -> dict[str, frozenset[str]]:
    """Languages of each entry."""
    langs: dict[str, set[str]] = {}
    for lang, words in table.items():
        for w in words.split():
            langs.setdefault(w, set()).add(lang)
    return {w: frozenset(x) for w, x in langs.items()}


_NEVER, _MAYBE, _NUMBER = _by_word(NEVER_LAST), _by_word(MAYBE_LAST), _by_word(BEFORE_NUMBER)
_SHORT = _NEVER.keys() | _MAYBE.keys() | _NUMBER.keys()
_WORD_TOO = {lang: frozenset(words.split()) for lang, words in WORDS_TOO.items()}
_COMMON: dict[str, tuple[str, ...]] = {}
for _lang, _words in COMMON_WORDS.items():
    for _w in _words.split():
        _COMMON[_w] = (*_COMMON.get(_w, ()), _lang)

# Terminators: STerm of the sentence-break property, the Tibetan strokes, full-width stop and ideographic half-width stop.
# Those that are written as ! and ? are, and full stops of all forms, need more evidence.
_SOFT_TERMS = ".!?…‼⁇⁈⁉"
_HARD_TERMS = "".join(sorted(set(_having("STerm")) - set(_SOFT_TERMS) | set("།༎．｡")))
_TERM = _HARD_TERMS + _SOFT_TERMS
_TERMS, _HARD = frozenset(_TERM), frozenset(_HARD_TERMS)
# Closing marks: those of Close that can stand at an end, which in some languages are those that open in others.
_CLOSERS = frozenset(c for c in _having("Close") if unicodedata.category(c) in ("Pe", "Pf")) | frozenset("\"'‘“›»")
#: Quotation marks to their closing marks; brackets of all scripts come on top of them.
_QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", '"': '"', "‚": "‘"}
_BRACKETS = {c: d for c in _having("Close") if unicodedata.category(c) == "Ps" and c not in "{„‚" and unicodedata.category(d := chr(ord(c) + (1 if unicodedata.category(chr(ord(c) + 1)) == "Pe" else 2))) == "Pe"}
_PAIRS = _BRACKETS | _QUOTES


def _marks(most: int) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of the marks up to a code point, for texts with and without Thai. Smaller classes are searched faster."""
    terms = re.escape("".join(c for c in _TERM if ord(c) <= most))
    mark = f"[{terms}{re.escape(''.join(c for c in _PAIRS if ord(c) <= most))}][{terms}]*+"
    return re.compile(mark), re.compile(rf"{mark}|(?<=[฀-๿])[ \t\xa0\u202f]+(?=[^\d\s])")


_MARKS = [(0x7F, *_marks(0x7F)), (0xFFFF, *_marks(0xFFFF)), (0x10FFFF, *_marks(0x10FFFF))]
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_LINE = re.compile(rf"\r\n|[\n\r\x0b\x0c{re.escape(_having('Sep'))}]")
_WORDS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s*")
_ITEM = re.compile(r"\s*(?:[-*+•·‣▪◦–—]|\d{1,3}[.)]|[^\W\d_][)]|\(\w{1,3}\))\s+(?=\S)")
_HEADING = re.compile(r"\s*(?:#{1,6}\s*\S|§+\s*\d|(?:\d{1,3}\.)+\d{1,3}\.?\s+[^\W\d_]|\d{1,3}[.)]\s+[^\W\d_]|(?:chapter|section|kapitel|abschnitt|chapitre|capítulo|capitolo|hoofdstuk|глава)\s+\d+)", re.I)
_SYMBOLS = re.compile(r"[\W_\d]*$")
_NUMERIC = re.compile(r"[\d.,:/\xa0\u202f]*\d$")
_WORDLIKE = re.compile(r"[^\W\d_]")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LAST_RUN = re.compile(r"[^\u2e80-\uffdc]*\Z")
_THAI_LETTER = re.compile(r"[฀-๿]")
_FOREIGN_END = re.compile(r"[.!?…。！？．।؟][\"'”’»“)」』]*(?:\s|$)|[。！？．]")
_DAY = re.compile(r"\d{1,2}\.(?!\d)")


class Passage:
    """The text that is cut, and what languages its places are in."""

    def __init__(self, text: str):
        self.text = text
        self.size = 0 if text.isascii() else 2 if _ASTRAL.search(text) else 1
        self.thai = self.size > 0 and _THAI_LETTER.search(text) is not None
        self._whole: dict[str, int] | None = None

    def languages(self, low: int, high: int) -> dict[str, int]:
        """Common words by language of a stretch, or of the whole text where the stretch has none."""
        near = _told(self.text[low:high])
        if near:
            return near
        if self._whole is None:
            self._whole = _told(self.text)
        return self._whole

    def has(self, table: dict[str, frozenset[str]], low: str, start: int, dot: int, nxt: int, high: int) -> bool:
        """Whether the word before the stop is an entry of the table.

        What follows a stop speaks for an abbreviation, in whatever language, unless it is a capital. Before a capital,
        an entry in lower case has to be one of the sentence's language, and no word of it too; an entry with a capital
        one of a language that its surroundings show any sign of.
        """
        langs = table.get(low)
        if langs is None:
            return False
        text = self.text
        if nxt >= high or not text[nxt].isupper() or not langs & COMMON_WORDS.keys():
            return True
        if text[dot - len(low)].isupper():
            return len(langs) > 2 or not (here := self.languages(max(start, dot - 200), min(high, dot + 100))) or not langs.isdisjoint(here)
        here = self.languages(start, min(high, dot + 40))
        most = max(here.values(), default=0)
        here = [lang for lang, n in here.items() if n > 0.5 * most]
        return not here or not langs.isdisjoint(here) and not any(low in _WORD_TOO.get(lang, ()) for lang in here)


@lru_cache(maxsize=4_096)
def _told(text: str) -> dict[str, int]:
    """How many common words of each language the text has."""
    hits: dict[str, int] = {}
    for w in _WORDS.findall(text.lower()):
        if w in _COMMON:
            for lang in _COMMON[w]:
                hits[lang] = hits.get(lang, 0) + 1
    return hits


class Pairs:
    """Places of closing marks of a block, found on first use."""

    def __init__(self, text: str, low: int, high: int):
        self.text, self.low, self.high = text, low, high
        self.at: dict[str, list[int]] = {}
        self.brackets: dict[int, int] | None = None

    def bracket(self, i: int) -> int:
        """The place of the mark that closes the bracket at ``i``; -1 if none does."""
        if self.brackets is None:
            self.brackets, opened = {}, {}
            for m in _BRACKET.finditer(self.text, self.low, self.high):
                ch = m[0]
                if ch in _BRACKETS:
                    opened.setdefault(_BRACKETS[ch], []).append(m.start())
                elif stack := opened.get(ch):
                    self.brackets[stack.pop()] = m.start()
        return self.brackets.get(i, -1)

    def next(self, marks: str, i: int) -> int:
        """The first of the marks after ``i``; -1 if there is none."""
        found = -1
        for c in marks:
            if c not in self.at:
                self.at[c] = [m.start() for m in re.finditer(re.escape(c), self.text[self.low : self.high])]
            k = bisect_right(self.at[c], i - self.low)
            if k < len(self.at[c]) and (found < 0 or self.low + self.at[c][k] < found):
                found = self.low + self.at[c][k]
        return found


_BRACKET = re.compile(f"[{re.escape(''.join(_BRACKETS))}{re.escape(''.join(_BRACKETS.values()))}]")


def _token_before(text: str, at: int, low: int) -> tuple[str, int]:
    """The run without white space or ideographs that ends at ``at``, and its start."""
    if at <= low or text[at - 1].isspace():
        return "", at
    reach = 60
    while True:
        part = text[max(low, at - reach) : at]
        run = part.rsplit(None, 1)[-1]
        if len(run) < len(part) or at - reach <= low:
            break
        reach *= 4
    if not run.isascii():
        run = _LAST_RUN.search(run)[0]
    return run, at - len(run)


def _word_before(text: str, at: int, low: int) -> str:
    """The run before the white space before ``at``."""
    i = at
    while i > low and text[i - 1].isspace():
        i -= 1
    return _token_before(text, i, low)[0]


def _thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def _cased(ch: str) -> bool:
    return ch.islower() or ch.isupper()


def _starts(text: str, at: int, high: int) -> bool:
    """A sentence can start here: a capital, or opening marks before a letter or number."""
    ch = text[at]
    return ch.isupper() or ch in "¿¡" or ch in _PAIRS


def _full_stop_ends(passage: Passage, start: int, dot: int, after: int, nxt: int, high: int) -> bool:
    """Whether the single full stop at ``dot`` ends the sentence begun at ``start``; ``nxt`` is the next character that
    is no white space, ``after`` follows the stop and its closing marks."""
    text = passage.text
    ch = text[nxt]
    spaced = nxt > after
    token, token_at = _token_before(text, dot, start)
    token = token.lstrip("\"'“„«»(‚‘[¿¡「『")
    if not token:
        return spaced or ch.isupper()
    last = token[-1]
    if not spaced:
        # A missing space: a word or number, then a capital word or an opening mark before a letter.
        if "/" in token or "@" in token:
            return False
        if ch.isupper():
            follows = nxt + 1 < high and (text[nxt + 1].islower() or text[nxt + 1].isspace() or text[nxt + 1] in "'’")
            if not follows:
                return False
            if last.isdigit() or last == ")" or last in _CLOSERS:
                return True
            low = token.lower()
            return last.isalpha() and not (low in _NEVER and passage.has(_NEVER, low, start, dot, nxt, high)) and not (low in _NUMBER and passage.has(_NUMBER, low, start, dot, nxt, high)) and not (len(token) == 1 and last.isupper()) and "." not in token
        if ch in "¿¡" or ch in "„«“「『":
            return True
        if ch in '("' and nxt + 1 < high and text[nxt + 1].isalpha():
            return last.isalnum() or last == ")"
        return not ch.isalnum() and not ch.islower() and ch not in ",;:.-–/_" and last.isalnum() and not _cased(ch) and _WORDLIKE.match(ch) is not None
    low = token.lower()
    digit, lower, upper = ch.isdigit(), ch.islower(), ch.isupper()
    if len(token) == 1 and token.isalpha():
        if not _cased(last) and (low in _NEVER and passage.has(_NEVER, low, start, dot, nxt, high)):
            return False
        before = _word_before(text, token_at, start)
        if len(before) == 2 and before[1] == "." and before[0].isalpha():
            pair = f"{before[0]}.{token}".lower()
            if (pair in _NEVER and passage.has(_NEVER, pair, start, dot, nxt, high)):
                return False
            if (pair in _MAYBE and passage.has(_MAYBE, pair, start, dot, nxt, high)):
                return not lower
        if digit:
            if low in "psсnсص№" or low == "п" or (last.isupper() and low in "s"):
                return False
            return True
        if last.isupper():
            if lower:
                return low not in "ub"
            # An initial stands at the start, next to another initial, or after "and"; else it is a symbol at the end.
            if token_at == start or not text[start:token_at].strip("\"'“„«»( \xa0\n\t"):
                return False
            if nxt + 1 < high and text[nxt + 1] == ".":
                return False
            before = _word_before(text, token_at, start)
            if len(before) == 2 and before[1] == "." and before[0].isupper():
                return False
            if before.lower() == "z." and last == "B":
                return False
            return before.lower() not in ("and", "und", "et", "y", "e", "en", "и", "&", "mr", "by", "von", "par", "por", "da", "door") and not before.endswith((".", ","))
        if lower:
            return low not in PARTS
        if upper:
            if nxt + 1 < high and text[nxt + 1] == "." and low in "zsudiomavbeот":
                return False
            return low not in "zсд"
        return True
    if "." in token and not _NUMERIC.match(token):
        if (low in _NEVER and passage.has(_NEVER, low, start, dot, nxt, high)):
            return False
        if (low in _MAYBE and passage.has(_MAYBE, low, start, dot, nxt, high)):
            return not lower
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
            return upper and not lower
        return not digit or not passage.has(_NEVER, low.rsplit(".", 1)[-1], start, dot, nxt, high)
    if _NUMERIC.match(token):
        before = _word_before(text, token_at, start)
        cue = before.lower() in ORDINAL_CUES
        integer = token.isdigit() and len(token) <= 2
        if digit:
            return not (integer and (cue or before.endswith(",")) and _DAY.match(text, nxt))
        if not integer:
            date = re.fullmatch(r"\d{1,2}\.\d{1,2}", token) is not None
            return not (lower and date and cue)
        if re.fullmatch(r"\d{1,2}\.", before):
            return upper or ch in _PAIRS or ch in "¿¡"
        if cue or (before.endswith(",") and upper and re.match(r"Aufl|Teil|Kapitel|Band|Auflage|Ausgabe", text[nxt : nxt + 9])):
            return False
        if lower and re.match(r"(?:und|bis|oder)\b", text[nxt : nxt + 5]):
            return False
        return True
    if last == ")" or last == "]":
        return True
    core = low.rstrip(")\"'”»’")
    if core not in _SHORT:
        return True
    if (core in _NEVER and passage.has(_NEVER, core, start, dot, nxt, high)):
        return False
    if (core in _NUMBER and passage.has(_NUMBER, core, start, dot, nxt, high)):
        return not (digit or ch in "(§")
    if (core in _MAYBE and passage.has(_MAYBE, core, start, dot, nxt, high)):
        return not lower
    return True


def _scan(passage: Passage, low: int, high: int, out: list[tuple[int, int]]) -> None:
    """Sentences of the block ``low..high``, which no unit crosses; line ends inside are white space."""
    text, pairs = passage.text, None
    start = low
    while start < high and text[start].isspace():
        start += 1
    at = start
    _, plain, thai = _MARKS[passage.size]
    search = (thai if passage.thai and _THAI_LETTER.search(text, low, high) else plain).search
    while at < high:
        m = search(text, at, high)
        if m is None:
            break
        i, j = m.span()
        ch = text[i]
        if ch == "." and j == i + 1 and j < high and text[j] == " ":
            # The plain case: a word that is no abbreviation, the stop, one space and a letter.
            nxt = j + 1
            token = text[text.rfind(" ", start, i) + 1 : i] if i - start > 1 else ""
            if len(token) > 3 and nxt < high and token.isalpha() and token < "\u0e00" and text[nxt].isalpha():
                low_token = token.lower()
                if low_token not in _SHORT:
                    out.append((start, j))
                    start = at = nxt
                    continue
        elif ch == "." and j == i + 1 and j < high and text[j] in _INSIDE:
            at = j
            continue
        if ch.isspace():  # after a Thai letter
            if _thai(text[j]) or _foreign_sentence(text, j, high):
                out.append((start, i))
                start = j
            at = j
            continue
        if ch in _PAIRS:
            at = i + 1
            pairs = pairs or Pairs(text, low, high)
            inner = -1 if ch in "([" and i > low and text[i - 1].isalnum() else _skip(text, i, high, start, pairs)
            if inner < 0:
                continue
            # A quotation or parenthesis as a whole; it ends its sentence only by a terminator inside.
            close = inner
            k = close - 1
            while k > i and (text[k].isspace() or text[k] in _CLOSERS):
                k -= 1
            at = close + 1
            if text[k] not in _TERMS:
                continue
            while at < high and text[at] in _CLOSERS:
                at += 1
            nxt = _SPACE.match(text, at, high).end()
            if nxt >= high:
                break
            follow = text[nxt]
            whole = i == start
            if follow in ",;:)—–-，、；：）" or follow in _TERMS or follow.islower():
                continue
            if not _cased(follow) and follow.isalpha():
                if not whole or text.startswith(QUOTATIVE, nxt):
                    continue
            elif ch in "([（":
                if not whole or follow.isdigit():
                    continue
            elif text[k] == "…" or (text[k] == "." and not whole and text[k - 1] == "."):
                continue
            out.append((start, at))
            start = at = nxt
            continue
        at = j
        last = text[j - 1]
        while at < high and text[at] in _CLOSERS:
            # A straight quotation mark after a stop closes only where no letter follows at once.
            if text[at] in "\"'“«»" and at + 1 < high and (text[at + 1].isalnum() or text[at + 1] in "¿¡"):
                break
            at += 1
        nxt = _SPACE.match(text, at, high).end()
        if nxt >= high:
            break
        follow = text[nxt]
        if follow in ",;:，、；：·" or (follow in "–—" and last not in "。！？"):
            if follow in "–—" and ch == "." and j - i == 1 and _starts_clause(text, nxt, high):
                pass
            else:
                continue
        if last in _HARD or ch in _HARD:
            if ch == "．" and j - i == 1 and i > low and text[i - 1].isdigit() and follow.isdigit() and nxt == at:
                continue
            if at > j and not _cased(follow) and text.startswith(QUOTATIVE, nxt):
                continue
            ends = True
        elif ch == "…" or (ch == "." and j - i > 1):
            if last in "!?":
                ends = nxt > at or follow.isupper()
            elif nxt == at:
                ends = follow.isupper() and nxt + 1 < high and text[nxt + 1].islower()
            else:
                ends = not follow.islower()
        elif ch in "!?‼⁇⁈⁉":
            # French and other marks inside of words, as in addresses, need white space or a capital after them.
            ends = nxt > at or follow.isupper() or follow in _PAIRS or follow in "¿¡" or (not _cased(follow) and follow.isalpha())
            if at > j and follow.islower():
                ends = False
        else:
            ends = _full_stop_ends(passage, start, i, at, nxt, high)
        if ends:
            out.append((start, at))
            start = at = nxt
    end = high
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start:
        out.append((start, end))


def _foreign_sentence(text: str, at: int, high: int) -> bool:
    """Whether what stands before the next Thai letter is a sentence of its own and no name, symbol or foreign word."""
    m = _THAI_LETTER.search(text, at, high)
    run = text[at : m.start() if m else high]
    return len(run) > 5 and _FOREIGN_END.search(run) is not None and (len(run.split()) > 3 or "\u2e80" <= run[0] <= "\uffdc")


def _starts_clause(text: str, at: int, high: int) -> bool:
    nxt = _SPACE.match(text, at + 1, high).end()
    return nxt < high and text[nxt].isupper()


def _skip(text: str, i: int, high: int, start: int, pairs: Pairs) -> int:
    """The place of the mark that closes the one at ``i``; -1 if it opens nothing."""
    ch = text[i]
    before = text[i - 1] if i > start else " "
    if ch in '"»' and (before.isalnum() or before in ".,!?…"):
        return -1
    if ch == '"' and (i + 1 >= high or text[i + 1].isspace()):
        return -1
    if ch in _BRACKETS:
        return pairs.bracket(i)
    end = pairs.next(_QUOTES[ch], i)
    if ch == '"' and end > 0 and text[end - 1].isspace() and end + 1 < high and text[end + 1].isalnum():
        return -1  # another quotation begins before this one ends
    return end


def _open_end(passage: Passage, start: int, end: int, nxt: int, high: int) -> bool:
    """Whether the line ``start..end`` breaks off in the midst of a sentence that the text at ``nxt`` goes on with."""
    text, k = passage.text, end
    while k > start and (text[k - 1] in _CLOSERS or text[k - 1].isspace()):
        k -= 1
    if k == start:
        return False
    last = text[k - 1]
    if _thai(last):
        return False
    if last in _HARD or last in "!?":
        return False
    if last not in _SOFT_TERMS:
        return True
    if last == "…" or text[k - 2 : k] == "..":
        return False
    return not _full_stop_ends(passage, start, k - 1, end, nxt, high) if nxt > end and nxt < high else False


def spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every unit, in code points, without white space at either end.

    Null, empty and blank texts have none. Every character that is no white space lies in exactly one unit.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    n = len(text)
    passage = Passage(text)
    lines: list[tuple[int, int]] = []
    at = 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, n))
    if len(lines) == 1:
        _block(passage, 0, n, _ITEM.match(text) is not None and _WORDLIKE.search(text) is not None, out)
        return out
    begin = -1  # start of the open block
    unit = False
    count = len(lines)
    closed = True  # the text so far ends with a whole unit
    previous = 0
    for k, (a, b) in enumerate(lines):
        if not text[a:b].strip():
            if begin >= 0:
                _block(passage, begin, previous, unit, out)
                begin, unit = -1, False
            closed = True
            continue
        if begin >= 0 and not closed:
            nxt = _SPACE.match(text, a, b).end()
            closed = unit or not _open_end(passage, begin, previous, nxt, b)
        alone = k + 1 >= count or not text[lines[k + 1][0] : lines[k + 1][1]].strip()
        if begin >= 0 and not closed and alone and text[previous - 1] == "." and text[b - 1] not in _TERMS:
            closed = _HEADING.match(text, a, b) is not None
        item = (closed or text[a : a + 3].lstrip()[:1] in "*•") and _ITEM.match(text, a, b) is not None
        heading = closed and _HEADING.match(text, a, b) is not None and (alone or text[b - 1] not in ".。")
        symbols = closed and _SYMBOLS.match(text, a, b) is not None
        if item or heading or symbols:
            if begin >= 0:
                _block(passage, begin, previous, unit, out)
            begin, unit = a, True
        elif begin < 0:
            begin, unit = a, False
        elif unit:
            _block(passage, begin, previous, unit, out)
            begin, unit = a, False
        elif closed and _thai(text[previous - 1]):
            _block(passage, begin, previous, False, out)
            begin = a
        previous = b
        closed = unit
    if begin >= 0:
        _block(passage, begin, previous, unit, out)
    return out


def _block(passage: Passage, low: int, high: int, unit: bool, out: list[tuple[int, int]]) -> None:
    text = passage.text
    if not unit:
        _scan(passage, low, high, out)
        return
    while low < high and text[low].isspace():
        low += 1
    while high > low and text[high - 1].isspace():
        high -= 1
    if high > low:
        out.append((low, high))


def sentences(df: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """Units of every text: ``key, start_char, end_char`` (from 0, end exclusive), with ``with_text`` also ``sentence``.

    Rows that repeat a key and text give each unit once. Null, empty and blank texts give no rows; texts of any
    length are cut whole; an empty table gives an empty result. Other columns are not read, whatever their names.
    """
    from cuecraft.llm.arrow import int_lists, map_arrow

    source = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [spans(t) for t in texts]
        columns = [batch.column(0), int_lists([[a for a, _ in x] for x in found]), int_lists([[b for _, b in x] for x in found])]
        names = ["_k", "starts", "ends"]
        if with_text:
            columns.append(pa.array([[t[a:b] for a, b in x] for t, x in zip(texts, found)], type=pa.list_(pa.string())))
            names.append("texts")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["_k"].dataType.simpleString()
    parts = "starts array<int>, ends array<int>" + (", texts array<string>" if with_text else "")
    rows = map_arrow(source, cut, f"_k {kind}, {parts}").where(F.size("starts") > 0).dropDuplicates()
    names = ["starts", "ends"] + (["texts"] if with_text else [])
    out = rows.select("_k", F.explode(F.arrays_zip(*names)).alias("u"))
    columns = [F.col("_k").alias(key), F.col("u.starts").alias("start_char"), F.col("u.ends").alias("end_char")]
    return out.select(*columns, *([F.col("u.texts").alias("sentence")] if with_text else []))
