"""Problem 4: defective prompt and response pairs.

* ``empty``: nothing is left once markup, empty containers and bare answer labels are taken away.
* ``copy``: the words of the answer are those of the question, or of its last sentences, up to misspellings.
* ``refusal``: its sentences decline or report failure, by word patterns of inability or will with verbs of answering.
* ``truncated``: a construct stays open (a whole object, code, a formula, what a colon or comma announces), or the end is
  unlikely under a character n-gram model of where texts end.
* ``language``: the language posteriors of question and answer, by naive Bayes on character n-grams, are sure of two
  languages, and the question does not ask for the other one. Posteriors are tempered by one factor that is fitted on
  labelled snippets, so that they are as sure as they are right.

The first of these that holds is given. The languages are fitted on a bounded sample (``SAMPLE_ROWS``); the n-grams of
ends are counted over the answers of all distinct pairs, and an answer is judged by what the others have. N-grams are
counted by 64-bit rolling hashes, and only those that stand at an end that is asked about.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecraft.llm.linking import distance
from cuecraft.llm.sampling import sample_rows
from cuecraft.llm.sentences import NEVER_LAST, spans
from cuecraft.session import materialize

#: Rows of the labelled table at most that teach the languages.
SAMPLE_ROWS = 9_000
LANGUAGES = ("en", "de", "fr", "es", "it")
BUCKETS = 1 << 16
#: Likelihood of an end under which a text breaks off, n-grams that a task counts before it hands them on, and slots of
#: the filter of n-grams that are asked for.
LEAST, HELD_GRAMS, SLOTS = 0.06, 500_000, 1 << 22
#: Probability that question and answer are in one language under which they aren't.
SAME_LANGUAGE = 1e-6

# Labels and words of the five languages.
ANSWER_LABELS = ("answer", "antwort", "réponse", "reponse", "respuesta", "risposta", "a", "response", "reply")
NOTHING = frozenset("null none nil nan n/a na nichts [] {} () undefined tbd".split())
GIVEN_BACK = re.compile(
    r"^\W*(?:q|question|frage|pregunta|domanda|(?:your|the) question (?:was|is)|(?:ihre|deine|die) frage (?:lautet|war|ist)|"
    r"votre question (?:était|est)|vous demandez|su pregunta (?:era|es)|la sua domanda (?:era|è)|you asked|sie fragten)\s*:\s*", re.I)
LANGUAGE_NAMES = {
    "en": "english englisch englische englischer anglais inglés ingles inglese",
    "de": "german deutsch allemand alemán aleman tedesco",
    "fr": "french französisch franzoesisch français francais francés frances francese",
    "es": "spanish spanisch espagnol español espanol spagnolo",
    "it": "italian italienisch italien italiano",
}
ANSWER_VERBS = r"answer\w*|reply|respond\w*|write|antwort\w*|schreib\w*|répon\w*|répond\w*|respuesta|conteste?\w*|rispo\w*|risposta|please|bitte"
_NOT = r"(?:n['’]t|\bnot|\bcannot|\bunable|\bdecline\w*|\brefrain\w*|\brefus\w*|\brather not)"
REFUSALS = {
    "en": [
        rf"\b(?:i|we)\b[^.!?]{{0,60}}(?:{_NOT})[^.!?]{{0,60}}\b(?:help (?:you )?(?:with|on|here|there)|help you|answer\w*|respon[ds]\w*|repl(?:y|ies|ying)|say (?:anything|something|more)|comment\w*|discuss\w*|provide|solve this|assist\w*|hand out|tell you|share)",
        r"\b(?:i|we)['’]?d? (?:had )?better leave (?:this|that)", r"\boutside (?:of )?what (?:i am|i['’]m|we are) (?:able|allowed)", r"\b(?:has|have) to (?:stay|remain|go) unanswered",
        r"\bno (?:answer|reply|statement|response) (?:can|could|is|was|will)\b[^.!?]{0,30}(?:be given|possible|produced|given|available|generated)",
        r"\bnot enough information\b", r"\bsay nothing that would let me\b", r"\bnot be appropriate for me to\b", r"\btalk about something else\b", r"\bsomething went wrong\b",
        r"\bdo(?:es)?(?:n['’]t| not) have (?:access|enough)\b[^.!?]{0,60}\b(?:so|answer|say|information)", r"\bas an? (?:ai|assistant|language model)\b[^.!?]{0,60}(?:not|n['’]t|unable|only)",
        r"\b(?:i|we) (?:must|have to) (?:decline|pass|refrain)", r"\bsorry,? (?:but )?(?:i|we) (?:can|could|do|am|will)(?:n['’]t|not| not)\b[^.!?]{0,40}(?:help|answer|that|know)", r"\bbeyond my (?:abilities|knowledge|scope)\b",
    ],
    "de": [
        r"\b(?:ich)\b[^.!?]{0,60}\b(?:nicht|keine?n?|nichts)\b[^.!?]{0,40}\b(?:helfen|weiterhelfen|antworten|beantworten|äußern|äussern|auskunft|sagen|heraus|eingehen|ein|lösen|für sie)\b(?! ?,? (?:dass|wie|warum|ob))",
        r"\b(?:darf|kann|möchte|will|werde) ich\b[^.!?]{0,60}\b(?:nicht|nichts|keine?)\b[^.!?]{0,30}\b(?:helfen|antworten|beantworten|äußern|äussern|sagen|geben)",
        r"\bkeine (?:auskunft|antwort)\b(?:[^.!?]{0,40}\b(?:möglich|erzeugt|gegeben|geben|werden)\b|\W*$)", r"\bliegen (?:mir )?keine angaben\b", r"\bgeb\w* (?:die ausschnitte )?[^.!?]{0,30}nichts her\b",
        r"\büberlasse ich lieber\b", r"\blöse das nicht\b", r"\bmuss hier passen\b", r"\bgehe ich grundsätzlich nicht ein\b", r"\bgebe ich nicht heraus\b", r"\bkonnte keine antwort\b", r"\bnichts,? daher keine antwort\b",
        r"\bmir keine auskunft\b",
    ],
    "fr": [
        r"\bje (?:ne|n['’]) ?(?:peux|puis|suis|saurais|souhaite|veux|dispose)\b[^.!?]{0,60}\b(?:pas|rien)\b[^.!?]{0,50}\b(?:répondre|aider|dire|commenter|parler|informations?)",
        r"\bil m['’]est impossible\b", r"\bne (?:me|nous) permettent pas\b", r"\bje préfère ne pas\b", r"\baucune réponse\b[^.!?]{0,40}(?:possible|donnée|produite|générée)", r"\bje (?:dois|suis obligé de) (?:décliner|refuser)", r"\bpas en mesure de (?:répondre|vous aider)",
    ],
    "es": [
        r"\bno (?:puedo|podemos|me es posible|sé|debo|quiero)\b[^.!?]{0,40}\b(?:ayudar\w*|contestar\w*|responder\w*|decir\w*|comentar\w*)", r"\bno me es posible\b", r"\bprefiero no\b", r"\bno (?:me )?permiten (?:responder|contestar)", r"\bno (?:hay|tengo) (?:suficiente )?información\b", r"\bdebo declinar\b",
    ],
    "it": [
        r"\bnon (?:posso|possiamo|riesco|sono in grado|voglio|so)\b[^.!?]{0,40}\b(?:aiutar\w*|rispond\w*|dire|commentare|parlarne)", r"\bnon mi permettono\b", r"\bpreferisco non\b", r"\bnessuna risposta\b[^.!?]{0,40}(?:possibile|prodotta)", r"\bnon ho (?:abbastanza )?informazioni\b", r"\bdevo declinare\b",
    ],
}
#: Sentences that sound like it and are none.
NO_REFUSAL = re.compile(r"\bhelp (?:our|my|your|them|it)sel(?:f|ves)\b|\bsorry to say that\b|\bone is unable to\b", re.I)
# End of the fixed values.

_REFUSAL = re.compile("|".join(p for patterns in REFUSALS.values() for p in patterns), re.I)
_FENCE = re.compile(r"```[^\n`]*\n?|```")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_DIGITS = re.compile(r"\d+")
_ENDS = frozenset(".!?…。！？।؟$")
_FORMULA = re.compile(r"\$[^$]*\$|\\[A-Za-z]+(?:\{[^{}]*\})*")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_WORD_OR_MARK = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[¿¡]")
_NEVER = frozenset(w for words in NEVER_LAST.values() for w in words.split()) - frozenset("no es par art sig ed col sun sat mon fr fri st max min see ex av def ch gem dec mar sec ms m im bd str oct ca".split())
_REQUEST = re.compile(
    rf"(?:{ANSWER_VERBS})[^.?!]{{0,25}}\b({'|'.join(w for names in LANGUAGE_NAMES.values() for w in names.split())})\b|"
    rf"\b(?:in|auf|en)\s+({'|'.join(w for names in LANGUAGE_NAMES.values() for w in names.split())})\b[^.?!]{{0,20}}(?:{ANSWER_VERBS})", re.I)
_NAME_LANGUAGE = {w: lang for lang, names in LANGUAGE_NAMES.items() for w in names.split()}


def _visible(text: str) -> str:
    """The text without format and control characters, and stripped."""
    if text.isprintable():
        return text.strip()
    return "".join(c for c in text if c in "\n\t\r" or c.isprintable() or unicodedata.category(c) not in ("Cf", "Cc")).strip()


def unwrap(answer: str) -> tuple[str, bool]:
    """What a whole JSON object gives as its answer, and whether the answer is one; else the answer itself."""
    text = answer.strip()
    fenced = re.fullmatch(r"```(?:json)?\s*(\{.*\})\s*```", text, re.S)
    body = fenced[1] if fenced else text
    if body.startswith("{") and body.endswith("}"):
        try:
            value = json.loads(body)
        except ValueError:
            return answer, False
        if isinstance(value, dict):
            for key in value:
                if str(key).casefold() in ANSWER_LABELS:
                    inner = value[key]
                    return ("" if inner is None else inner if isinstance(inner, str) else json.dumps(inner, ensure_ascii=False)), True
            return ("" if not value else answer), bool(value)
    return answer, False


def is_empty(answer: str | None) -> bool:
    """No content: null, blank, placeholders, empty markup and bare labels."""
    if answer is None:
        return True
    text = _visible(unwrap(answer)[0])
    if text.casefold() in NOTHING:
        return True
    if _CODE.fullmatch(text):
        text = _FENCE.sub("", text)
    text = _TAG.sub("", text).strip().casefold()
    text = re.sub(rf"^\W*(?:{'|'.join(ANSWER_LABELS)})\s*[:.]\s*", "", text).strip()
    return text in NOTHING or not any(c.isalnum() or unicodedata.category(c) in ("Sm", "So") and c not in "|~" for c in text)


def _words(text: str) -> list[str]:
    return _WORDS.findall(unicodedata.normalize("NFKC", text).casefold().replace("’", "'"))


def is_copy(question: str | None, answer: str) -> bool:
    """Only the question: most words of either are paired in order, within one edit in short and two in long words."""
    if not question:
        return False
    back = GIVEN_BACK.sub("", answer)
    a = _words(back)
    if len(a) < 3:
        return False
    q = _words(question)
    half = len(a) // 2
    if half > 2 and len(a) % 2 == 0 and a[:half] == a[half:]:  # given back twice
        a = a[:half]
    return _given_back(a, q) or any(_given_back(a, _words(question[x:])) for x, _ in spans(question)[1:])


def _alike(x: str, y: str) -> bool:
    """Equal up to one edit in short words and two in longer ones."""
    if x == y:
        return True
    if len(x) < 3 or len(y) < 2 or abs(len(x) - len(y)) > 2:
        return False
    most = 1 if min(len(x), len(y)) < 5 else 2
    return distance(x, y, most) <= most


def _given_back(a: list[str], q: list[str]) -> bool:
    """At least 85 % of the longer list is paired in order. Pairs of such an alignment lie within 15 % of the lengths'
    diagonal, so only that band is filled; it ends as soon as too few words can still be paired."""
    if not q or not 0.8 <= len(a) / len(q) <= 1.25:
        return False
    if a == q:
        return True
    longest = max(len(a), len(q))
    spare = longest - math.ceil(0.85 * longest - 1e-9)  # words of the longer list that may stay without a pair
    least = longest - spare
    row = [0] * (len(q) + 1)
    for i, x in enumerate(a):
        low, high = max(0, i - spare), min(len(q), i + spare + 1)
        last = row[low]
        if low:
            row[low] = max(row[low], row[low - 1])
        for j in range(low, high):
            keep = row[j + 1]
            row[j + 1] = last + 1 if _alike(x, q[j]) else max(keep, row[j])
            last = keep
        if row[high] + len(a) - i - 1 < least:
            return False
        if high < len(q):  # the next row's band reaches one further
            row[high + 1] = max(row[high + 1], row[high])
    return row[-1] >= least


def is_refusal(answer: str) -> bool:
    """All it says is that there will be no answer; at most one other sentence beside those that say so."""
    text = answer.replace("’", "'").strip(" *_\"'")
    if not _REFUSAL.search(text):
        return False
    units = [text[a:b] for a, b in spans(text)]
    hits = [bool(_REFUSAL.search(u)) and not NO_REFUSAL.search(u) for u in units]
    return any(hits) and len(units) - sum(hits) <= 1


class EndModel:
    """Likelihood that a text ends after its last characters: interpolated n-gram counts of ends over all places.

    An n-gram is the rolling hash of its characters; the hash of a longer one goes on from that of its own end.
    """

    LONGEST = 6
    _POWERS = np.array([pow(0x9E3779B97F4A7C15, n, 1 << 64) for n in range(LONGEST)], dtype=np.uint64)
    _SALTS = np.array([n * 0xD1B54A32D192ED03 % (1 << 64) for n in range(1, LONGEST + 1)], dtype=np.uint64)
    _MIX = np.uint64(0xBF58476D1CE4E5B9)

    def __init__(self, at_end: dict[int, int], anywhere: dict[int, int]):
        self.at_end, self.anywhere = at_end, anywhere

    @staticmethod
    def shape(text: str) -> str:
        return "^" + _DIGITS.sub("9", " ".join(text.split()).casefold())

    @classmethod
    def hashes(cls, points: np.ndarray) -> list[np.ndarray]:
        """For n from 1, the hashes of the n-grams that end at each place; places before the n-th have none that counts."""
        c = points.astype(np.uint64) + np.uint64(1)
        out, h = [], np.zeros(len(c), dtype=np.uint64)
        for n in range(1, cls.LONGEST + 1):
            if n <= len(c):
                h[n - 1 :] += c[: len(c) - n + 1] * cls._POWERS[n - 1]
            mixed = (h + cls._SALTS[n - 1]) * cls._MIX
            out.append((mixed ^ (mixed >> np.uint64(29))).view(np.int64))
        return out

    @classmethod
    def ended(cls, text: str, shape: str) -> bool:
        """Only texts that end with a terminator or are brief can show how texts end."""
        return shape.rstrip("\"'”“»’)]*_ ")[-1:] in _ENDS or sum(len(w) > 1 for w in _words(text)) <= 4

    @classmethod
    def grams(cls, text: str) -> list[int]:
        """The n-grams at the end of the text, the shortest first."""
        s = cls.shape(text)[-cls.LONGEST :]
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return [int(h[-1]) for h in cls.hashes(points)[: len(points)]]

    @classmethod
    def count(cls, texts: list[str], asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-grams of the texts, how often they are anywhere, and how often at an end; with ``asked`` (bits of slots) only
        those whose slot is set."""
        shapes = [cls.shape(t) for t in texts]
        ended = np.array([cls.ended(t, s) for t, s in zip(texts, shapes)], dtype=bool)
        sizes = np.array([len(s) for s in shapes], dtype=np.int64)
        points = np.frombuffer("".join(shapes).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        stop = np.cumsum(sizes)
        depth = np.arange(len(points)) - np.repeat(stop - sizes, sizes)  # places ahead of each in its text
        symbols, letter = np.unique(points, return_inverse=True)
        found = []
        for n, h in enumerate(cls.hashes(points), 1):
            take = depth >= n - 1
            if n < 3 and len(symbols) <= 2_000:
                # Few kinds, in many places: one slot for each, and a place that shows its hash.
                slot = letter[take] if n == 1 else letter[:-1][take[1:]] * len(symbols) + letter[1:][take[1:]]
                shown = np.zeros(len(symbols) ** n, dtype=np.int64)
                shown[slot] = np.flatnonzero(take)
                total = np.bincount(slot, minlength=len(shown))
                grams, total = h[shown[total > 0]], total[total > 0]
                order = np.argsort(grams)
                grams, total = grams[order], total[order]
            else:
                grams, total = np.unique(h[take & _is_set(asked, h)] if asked is not None else h[take], return_counts=True)
            at_end, count = np.unique(h[stop[ended & (sizes >= n)] - 1], return_counts=True)
            ends = np.zeros(len(grams), dtype=np.int64)
            if len(grams):
                place = np.minimum(np.searchsorted(grams, at_end), len(grams) - 1)
                same = grams[place] == at_end
                ends[place[same]] = count[same]
            found.append((grams, total, ends))
        return tuple(np.concatenate(x) for x in zip(*found))

    @classmethod
    def train(cls, texts: list[str]) -> EndModel:
        grams, total, ends = cls.count(texts)
        return cls(Counter({g: n for g, n in zip(grams.tolist(), ends.tolist()) if n}), dict(zip(grams.tolist(), total.tolist())))

    def likelihood(self, text: str) -> float:
        return self.of_grams(self.grams(text))

    def of_grams(self, grams: list[int]) -> float:
        p = 0.02
        for gram in grams:
            total = self.anywhere.get(gram, 0)
            p = (min(self.at_end.get(gram, 0), total) + 3.0 * p) / (total + 3.0)
        return p


def _is_set(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slots = grams & np.int64(SLOTS - 1)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


class OpenEnds:
    """Takes every end for likely and keeps the text that it was asked about."""

    def __init__(self):
        self.asked: str | None = None

    def likelihood(self, text: str) -> float:
        self.asked = text
        return 1.0


def counted_text(answer: str) -> str | None:
    """What the n-gram model counts of an answer, if it counts it."""
    text = _visible(_CODE.sub(" ", answer)).rstrip("*_")
    return text if text and not text.startswith("{") else None


def is_truncated(answer: str, inner: str, whole: bool, ends: EndModel | OpenEnds, least: float = LEAST) -> bool:
    """Whether the answer breaks off: a construct stays open, or the end is an unlikely one. The end model is asked about all
    ends but those with a terminator after a word of its own."""
    if whole:
        text = inner.strip()
    else:
        text = answer.strip()
        if text.startswith("{") and '"' in text and not text.endswith("}") and re.match(r'\{\s*"\w*', text):
            return True
        if text.count("```") % 2:
            return True
    prose = _CODE.sub("", text).strip().rstrip("*_").rstrip()
    if not prose or text.endswith("```"):
        return False
    if (prose.count("$") - prose.count("\\$")) % 2 or re.search(r"\\begin\{(\w+)\}(?!.*\\end\{\1\})", prose, re.S):
        return True
    if prose.endswith("$"):
        return False
    if prose.count("{") > prose.count("}") and "\\" in prose:
        return True
    core = prose.rstrip("\"'”“»’)]*_ ")
    if core and core[-1] in ".!?…。！？।؟":
        if core[-1] == "." and not core.endswith(".."):
            last = core[:-1].rsplit(None, 1)[-1].lstrip("(«„\"'").casefold() if core[:-1].split() else ""
            # After an abbreviation a full stop is no sign of an end.
            return last in _NEVER and len(core.split()) > 2 and ends.likelihood(prose) < least
        return False
    if prose[-1] in ",;:":
        return True  # what it announces is missing
    # Numbers and symbols alone say all they say.
    return any(len(w) > 1 and not w.isdigit() for w in _words(prose)) and ends.likelihood(prose) < least


class LanguageModel:
    """Naive Bayes on hashed character n-grams of one to three characters."""

    def __init__(self, weights: np.ndarray, languages: tuple[str, ...] = LANGUAGES, temper: float = 0.5):
        self.weights, self.languages, self.temper = np.ascontiguousarray(weights), languages, temper  # buckets x languages

    @staticmethod
    def grams(text: str) -> np.ndarray:
        t = " " + " ".join(w for w in _WORD_OR_MARK.findall(unicodedata.normalize("NFKC", text).casefold().replace("’", "'"))) + " "
        codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        one = codes * 31 % BUCKETS
        two = (codes[:-1] * 7_919 + codes[1:] * 104_729) % BUCKETS
        three = (codes[:-2] * 15_485_863 + codes[1:-1] * 32_452_843 + codes[2:] * 49_979_687) % BUCKETS
        return np.concatenate([one, two, three])

    @classmethod
    def train(cls, rows: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> LanguageModel:
        """Fit on rows of text and language; a fifth of them is kept back to fit the temper of the posteriors."""
        known = [(t, languages.index(lang)) for t, lang in rows if lang in languages]
        counts = np.zeros((BUCKETS, len(languages)))
        for k, (text, lang) in enumerate(known):
            if k % 5 or len(known) < 50:
                np.add.at(counts[:, lang], cls.grams(text), 1.0)
        weights = np.log((counts + 0.1) / (counts.sum(axis=0, keepdims=True) + 0.1 * BUCKETS))
        model = cls(weights.astype(np.float32), languages)
        held = [(w, lang) for k, (text, lang) in enumerate(known) if k % 5 == 0 for w in cls.snippets(text)][:2_000] if len(known) >= 50 else []
        if held:
            held = [(s, lang) for t, lang in held if (s := model.scores(t)) is not None]
            scores, right = np.array([s for s, _ in held], dtype=float), np.array([lang for _, lang in held])
            # Some labels are wrong; the snippets that disagree clearly don't speak about the temper.
            keep = scores.max(axis=1) - scores[np.arange(len(right)), right] < 12.0
            scores, right = scores[keep], right[keep]
            if len(right):
                loss = lambda t: -np.mean(np.log(softmax(scores * t)[np.arange(len(right)), right] + 1e-12))
                model.temper = float(min(np.geomspace(0.05, 1.0, 25), key=loss))
        return model

    @staticmethod
    def snippets(text: str) -> list[str]:
        """Runs of six words from the start and the middle of a text."""
        words = text.split()
        return [" ".join(words[a : a + 6]) for a in {0, len(words) // 2} if len(words) >= a + 6]

    def scores(self, text: str) -> np.ndarray | None:
        """Log likelihoods by language, for the words of the text without code and formulas; null if it has none."""
        prose = _FORMULA.sub(" ", _CODE.sub(" ", text)) if "$" in text or "\\" in text or "`" in text else text
        grams = self.grams(prose)
        return self.weights[grams].sum(axis=0) if len(grams) > 5 else None

    def posterior(self, text: str) -> np.ndarray | None:
        """Probabilities of the languages; null for a text without words."""
        scores = self.scores(text)
        return None if scores is None else softmax(scores.astype(float) * self.temper)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def asked_for(question: str) -> str | None:
    """The language that the question wants its answer in, if it names one."""
    m = _REQUEST.search(question)
    return _NAME_LANGUAGE.get((m[1] or m[2]).casefold()) if m else None


def wrong_language(question: str | None, answer: str, model: LanguageModel) -> bool:
    """By their posteriors, question and answer are hardly in one language, and the answer's is none that was asked for.
    A brief answer whose language can't be told has a posterior that leaves room for the question's."""
    if not question:
        return False
    a = model.posterior(answer)
    if a is None or (q := model.posterior(_REQUEST.sub(" ", question))) is None:
        return False
    return float(a @ q) < SAME_LANGUAGE and asked_for(question) != LANGUAGES[int(a.argmax())]


def defect(question: str | None, answer: str | None, ends: EndModel | OpenEnds, languages: LanguageModel) -> str | None:
    """The defect of the pair, or null."""
    if is_empty(answer):
        return "empty"
    inner, whole = unwrap(answer)
    text = _visible(inner)
    if is_copy(question, text):
        return "copy"
    if is_refusal(text):
        return "refusal"
    if is_truncated(answer, text, whole, ends):
        return "truncated"
    if wrong_language(question, text, languages):
        return "language"
    return None


_ASKED = "array<struct<g:string,t:bigint,e:bigint>>"


def asked_bits(asked: DataFrame) -> np.ndarray:
    """Bits of the slots of all n-grams that ends are asked by. Set bits are joined by the cluster; a bounded number of
    words, of 64 bits each, comes to the driver. A filter that is full lets everything be counted."""
    slot = F.col("g").bitwiseAND(F.lit(SLOTS - 1))
    grams = asked.select(F.explode(F.from_json("asked", _ASKED)).alias("x")).select(F.col("x.g").cast("bigint").alias("g"))
    rows = grams.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = np.zeros(SLOTS // 64, dtype=np.int64)
    for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[r["word"]] = r["bits"]
    return words.view(np.uint8)


def end_counts(answers: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``gram, total, ends``: how often each n-gram (of those that are asked for, if given) is in the answers, and at the
    end of those that end well."""
    held = answers.sparkSession.sparkContext.broadcast(None if asked is None else asked_bits(asked))

    def run(batches):
        total, ends = Counter(), Counter()

        def handed_on():
            grams = list(total)
            out = pa.RecordBatch.from_arrays([pa.array(grams, type=pa.int64()), pa.array([total[g] for g in grams], type=pa.int64()), pa.array([ends[g] for g in grams], type=pa.int64())], names=["gram", "total", "ends"])
            total.clear(), ends.clear()
            return out

        for batch in batches:
            texts = [t for a in batch.column(0).to_pylist() if (t := counted_text(a)) is not None]
            if not texts:
                continue
            grams, n, e = EndModel.count(texts, held.value)
            total.update(dict(zip(grams.tolist(), n.tolist())))
            ends.update(dict(zip(grams[e > 0].tolist(), e[e > 0].tolist())))
            if len(total) > HELD_GRAMS:
                yield handed_on()
        yield handed_on()

    counted = answers.mapInArrow(run, "gram bigint, total bigint, ends bigint")
    return counted.groupBy("gram").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))


def unlikely_ends(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked, unlikely`` of ends: JSON lists of n-grams, the shortest first, each with what the judged answer adds to its
    two counts."""
    grams = asked.select("asked", F.posexplode(F.from_json("asked", _ASKED)).alias("n", "x")).select("asked", "n", F.col("x.g").alias("gram"), F.col("x.t").alias("t"), F.col("x.e").alias("e"))
    known = counts.select(F.col("gram").cast("string").alias("gram"), "total", "ends")
    less = lambda c, own: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) - F.col(own)).alias(c)
    # Six n-grams at most.
    found = grams.join(known, "gram", "left").groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("n", less("total", "t"), less("ends", "e")))).alias("c"))
    step = lambda p, x: (F.least(x["ends"], x["total"]) + 3.0 * p) / (x["total"] + 3.0)
    return found.select("asked", (F.aggregate("c", F.lit(0.02).cast("double"), step) < LEAST).alias("unlikely"))


def find_defects(pairs: DataFrame, labelled: DataFrame, key: str = "ask_id", question: str = "question", answer: str = "answer", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``key, defect`` of every defective pair; ``labelled`` has ``text`` and ``lang`` to learn languages from.

    A null question can be neither copied nor answered in a wrong language; a null answer is empty. Rows repeated in
    key and texts count once; an empty table gives an empty result. Other columns are not read.
    """
    source = pairs.select(F.col(key).alias("_k"), F.col(question).alias("_q"), F.col(answer).alias("_a"))
    lang = F.lower(F.trim("lang"))
    sample = sample_rows(labelled, labelled.where(lang.isin(*LANGUAGES) & F.col("text").isNotNull()).select("text", lang.alias("lang")), "text", rows)
    model = LanguageModel.train(sorted((r["text"], r["lang"]) for r in sample.collect()))
    held = pairs.sparkSession.sparkContext.broadcast((model.weights, LANGUAGES, model.temper))
    kind = source.schema["_k"].dataType.simpleString()

    def run(batches):
        language_model = LanguageModel(*held.value)

        @lru_cache(maxsize=20_000)
        def judge(q, a):
            ends = OpenEnds()
            found = defect(q, a, ends, language_model)
            if ends.asked is None:
                return found, None
            own = EndModel.train([t] if (t := counted_text(a)) is not None else [])
            return found, json.dumps([{"g": str(g), "t": own.anywhere.get(g, 0), "e": own.at_end.get(g, 0)} for g in EndModel.grams(ends.asked)])

        for batch in batches:
            found = [judge(q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], type=pa.string()), pa.array([x for _, x in found], type=pa.string())], names=["_k", "defect", "asked"])

    found = materialize(source.mapInArrow(run, f"_k {kind}, defect string, asked string").where("defect IS NOT NULL OR asked IS NOT NULL").dropDuplicates())
    asked = found.where("asked IS NOT NULL")
    distinct = source.where(F.col("_a").isNotNull()).dropDuplicates(["_q", "_a"]).select("_a")
    unlikely = unlikely_ends(asked.select("asked").distinct(), end_counts(distinct, asked))
    judged = asked.join(unlikely, "asked").select("_k", F.when(F.col("unlikely"), F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))
    out = found.where("asked IS NULL").select("_k", "defect").unionByName(judged)
    return out.where("defect IS NOT NULL").dropDuplicates().withColumnRenamed("_k", key)
