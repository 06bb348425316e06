"""Problem 9: text decoded with the wrong character encoding, found and restored.

A multinomial classifier on hashed byte bigrams is trained on words that are garbled on purpose through every chain of
encodings below, against the same words as they are. It predicts the exact chain of each word that is not plain ASCII.
The prediction holds only if the chain can be inverted: the word encodes in the wrong encoding, the bytes decode
strictly in the right one, and the classifier takes the result for sound text, more so than what it was. Chains that
lost characters cannot be inverted; there a wide margin of the classifier over a passage is asked for.

Chains are tried in the order of the classifier's margin. Counts of words are a check: the first chain that gives words
of the corpus is taken, and only if none does the first of all; a word that is frequent as it is, more so than what it
would have been, stays. Counts are those of all distinct texts that are not plain ASCII. Training words come from a
bounded sample of the corpus (``TRAIN_ROWS`` rows, ``TRAIN_WORDS`` words).

Every text is cut into words once; each distinct word that a chain could speak for is judged once, wherever it stands.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecraft.llm.sampling import sample_rows
from cuecraft.session import materialize

#: Rows at most whose words train the classifier, and words at most that are garbled for it.
TRAIN_ROWS, TRAIN_WORDS = 6_000, 4_000
#: Words of the sample at most that the training looks at.
LEXICON_WORDS = 50_000
#: Words that a task counts before it hands them on.
HELD_WORDS = 500_000
BUCKETS = 1 << 14
SOUND = "sound"
REPLACEMENT = "�"

# The chains. Each step (right, wrong) says: bytes of ``right`` were read as ``wrong``.
_UTF8_READ_AS = "latin-1 cp1252 cp1250 cp1251 cp1253 cp1254 cp1256 cp437 cp850 cp866 koi8-r mac-roman iso8859-2 iso8859-15 cp874 gb18030 cp932 big5 cp949".split()
_TWICE = "latin-1 cp1252 cp1250 cp1251 cp1256 cp437 cp850 mac-roman gb18030".split()
_READ_AS = {
    "cp1252": "cp437 cp850 mac-roman cp1250 cp1251 koi8-r cp866 iso8859-2 iso8859-5 iso8859-7 gb18030 utf-8",
    "cp1250": "cp1252",
    "mac-roman": "cp1252 latin-1 utf-8",
    "cp437": "cp1252 latin-1",
    "cp850": "cp1252 latin-1 utf-8",
    "cp1251": "latin-1 cp1252 koi8-r cp866 mac-roman cp437",
    "koi8-r": "latin-1 cp1252 cp1251 cp866",
    "cp866": "latin-1 cp1252 cp1251 koi8-r",
    "iso8859-5": "latin-1 cp1251",
    "cp874": "latin-1 cp1252",
    "cp1256": "latin-1 cp1252",
    "iso8859-6": "latin-1 cp1252",
    "gb18030": "latin-1 cp1252",
    "big5": "latin-1 cp1252 gb18030",
    "cp932": "latin-1 cp1252 gb18030",
    "euc_jp": "latin-1 cp1252 gb18030 cp932",
    "utf-7": "ascii",
}
CHAINS: list[tuple[tuple[str, str], ...]] = (
    [(("utf-8", wrong),) for wrong in _UTF8_READ_AS]
    + [(("utf-8", wrong),) * 2 for wrong in _TWICE]
    + [(("utf-8", "latin-1"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "latin-1"))]
    + [(("utf-8", wrong),) * 3 for wrong in ("latin-1", "cp1252")]
    + [((right, wrong),) for right, wrongs in _READ_AS.items() for wrong in wrongs.split()]
)
# End of the fixed values.
NAMES = [SOUND, *("; ".join(f"{r} read as {w}" for r, w in chain) for chain in CHAINS)]
_MULTI = frozenset("gb18030 cp932 big5 cp949 euc_jp utf-8 utf-7 ascii".split())

#: A word: a run without ASCII white space that is not plain ASCII, or has character references or shifted base 64.
_WORD = re.compile(r"[^ \t\r\n]*(?:[^\x00-\x7f]|&#?\w{2,8};|\+[A-Za-z0-9/]{2,}-)[^ \t\r\n]*")
_REFERENCE = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[A-Za-z]{2,8}\d?);")
_SHIFTED = re.compile(r"\+[A-Za-z0-9/]{2,}-")
_PLAIN_EDGE = "\"'()[]{},;:!?.<>"
_EDGE = "\"'()[]{},;:!?.<>*#-_/|=~"
_SPACES = re.compile(r"[\s\xa0]+")
#: A no-break space after a plain character, or after a letter that does not begin a garbled sequence.
_JOINT = re.compile(r"(?<=[\x21-\x7e])\xa0|(?<=[\xdf-\xff])\xa0(?=[A-Za-z(])")
_NO_TEXT = re.compile("[\x7f-\x9f\ue000-\uf8ff]")
_LATIN, _OTHER_ALPHABET = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[Ͱ-࿿一-鿿]")
_HIGH_LATIN, _IDEOGRAPH, _RUN = re.compile(r"[\x80-ɏ]"), re.compile(r"[⺀-\uffdc]"), re.compile(r"[⺀-\uffdc]+|[^⺀-\uffdc]+")
_PIECE = re.compile(r"[^。！？\n]*[。！？]?")
#: Characters of a run at least that are judged by themselves if the whole can't be inverted, characters at most that a
#: cut is moved by to where the bytes decode, and features that are added up at once.
_WIDEST, _REACH, _AT_ONCE = 400, 64, 8_192


@lru_cache(maxsize=None)
def _tables(codec: str) -> tuple[dict[str, int], list[str]]:
    """Byte of a character and character of a byte; bytes that the encoding leaves open stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


def to_bytes(text: str, codec: str) -> bytes | None:
    if codec in _MULTI:
        try:
            return text.encode(codec)
        except UnicodeError:
            return None
    table = _tables(codec)[0]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def from_bytes(data: bytes, codec: str, strict: bool) -> str | None:
    if codec in _MULTI:
        try:
            return data.decode(codec, "strict" if strict else "replace")
        except UnicodeError:
            return None
    if strict and codec not in ("latin-1",):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            return None
    chars = _tables(codec)[1]
    return "".join(chars[b] for b in data)


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text as it reads after the chain; null if it has no such form or stays as it was."""
    t: str | None = text
    for right, wrong in chain:
        data = to_bytes(t, right)
        t = None if data is None else from_bytes(data, wrong, False)
        if t is None:
            return None
    return None if t == text else t


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, if every step can be undone strictly."""
    t: str | None = text
    for right, wrong in reversed(chain):
        data = to_bytes(t, wrong)
        t = None if data is None else from_bytes(data, right, True)
        if t is None:
            return None
    return None if t == text or REPLACEMENT in t else t


def unescape(word: str) -> str:
    return html.unescape(word) if _REFERENCE.search(word) else word


def features(word: str) -> np.ndarray:
    """Buckets of the byte bigrams that touch a byte beyond ASCII; of a plain ASCII word all."""
    data = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.int64)
    left, right = data[:-1], data[1:]
    pairs = left * 256 + right
    if (data > 127).any():
        pairs = pairs[(left > 127) | (right > 127)]
    return pairs * 40_503 % 65_521 % BUCKETS


def _counts(words: list[tuple[str, int]]) -> np.ndarray:
    """Counts of the buckets over words with weights; the same as adding up ``features`` of each."""
    counts = np.zeros(BUCKETS)
    for plain in (False, True):
        part = [(w.encode("utf-8", "surrogatepass"), n) for w, n in words if w.isascii() == plain]
        if not part:
            continue
        data = np.frombuffer(b" " + b" ".join(w for w, _ in part) + b" ", dtype=np.uint8).astype(np.int64)
        left, right = data[:-1], data[1:]
        weights = np.repeat([n for _, n in part], [len(w) + 1 for w, _ in part])
        buckets = (left * 256 + right) * 40_503 % 65_521 % BUCKETS
        keep = slice(None) if plain else (left > 127) | (right > 127)
        counts += np.bincount(buckets[keep], weights=weights[keep], minlength=BUCKETS)
    return counts


class Classifier:
    """Log likelihoods of the buckets by class, class 0 being sound text, and the counts of words by texts.

    ``unit`` is the count that stands for one in ``TRAIN_ROWS`` texts, one at least, so that the rules are the same for
    a corpus of any size. ``own`` is what the text that a word is judged in adds to the word's count.
    """

    def __init__(self, weights: np.ndarray, lexicon: dict[str, int], unit: float = 1.0, own: int = 0):
        self.weights = weights  # buckets x classes, log
        self.sound = np.ascontiguousarray(weights[:, 0])
        self.lexicon, self.unit, self.own = lexicon, unit, own
        self.known = lru_cache(maxsize=100_000)(self.judge)

    @classmethod
    def train(cls, words: Counter, most: int = TRAIN_WORDS, smoothing: float = 0.05) -> Classifier:
        """Words with their counts; those that look garbled after a first round are left out of the second."""
        model = None
        clean = [(w, n) for w, n in words.most_common() if not self_evident(w)]
        for size in (most // 4, most):
            lexicon = {w: n for w, n in clean if model is None or model.judge(w)[0] == SOUND}
            taught = [(w, min(n, 50)) for w, n in clean[:size] if w in lexicon]
            counts = np.stack([_counts(taught), *(_counts([(bad, n) for w, n in taught if (bad := garble(w, chain)) is not None]) for chain in CHAINS)])
            totals = counts.sum(axis=1, keepdims=True)
            weights = np.log((counts + smoothing) / (totals + smoothing * BUCKETS))
            weights[totals[:, 0] == 0] = -30.0
            model = cls(np.ascontiguousarray(weights.T.astype(np.float32)), lexicon)
        return model

    def scores(self, word: str) -> np.ndarray:
        f = features(word)
        return sum(self.weights[f[i : i + _AT_ONCE]].sum(axis=0) for i in range(0, len(f), _AT_ONCE))

    def scores_of(self, words: list[str]) -> np.ndarray:
        """The same for many words at once: words by classes."""
        out = np.zeros((len(words), self.weights.shape[1]), dtype=np.float32)
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(w) + 1 for w in coded])
        ends = np.cumsum(sizes)
        low = 0
        while low < len(words):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _AT_ONCE)))
            if high == low + 1:
                out[low] = self.scores(words[low])
            else:
                data = np.frombuffer(b" " + b" ".join(coded[low:high]) + b" ", dtype=np.uint8).astype(np.int64)
                left, right = data[:-1], data[1:]
                begin = np.concatenate([[0], np.cumsum(sizes[low:high])[:-1]])
                beyond = (left > 127) | (right > 127)
                plain = np.maximum.reduceat(data[:-1], begin) < 128
                found = self.weights[(left * 256 + right) * 40_503 % 65_521 % BUCKETS]
                found[~(beyond | np.repeat(plain, sizes[low:high]))] = 0
                out[low:high] = np.add.reduceat(found, begin, axis=0)
            low = high
        return out

    def suspicious(self, words: list[str]) -> list[str]:
        """Those of the words that ``lookups`` may have something for; all others are sound whatever the counts are."""
        cores = [_core(unescape(w)) for w in words]
        at = [i for i, c in enumerate(cores) if c]
        scores = self.scores_of([cores[i] for i in at])
        close = scores[:, 1:].max(axis=1) - scores[:, 0] > -3.0
        return [words[i] for i, near in zip(at, close.tolist()) if near or _lost(cores[i])]

    def _likeness(self, word: str) -> float:
        """Mean log likelihood of the word as sound text."""
        return float(self.sound[features(word)].mean())

    def seen(self, text: str) -> int:
        """The least count of the parts of the text that are not plain ASCII."""
        return min((self.lexicon.get(w, 0) for w in _lookups(text)), default=0)

    def _candidates(self, core: str) -> tuple[list[tuple[int, str, bool, float]], int, float]:
        """Chains that some counts could speak for, with what the text was before, whether decoding it is evidence, and
        the margin; the likeliest chain and its margin."""
        score = self.scores(core)
        sound = float(score[0])
        margins = score[1:] - sound
        first = int(margins.argmax()) + 1
        out = []
        for k in np.flatnonzero(margins > -2.0) + 1:
            chain = CHAINS[k - 1]
            if chain[0][0] != "utf-8" and margins[k - 1] <= 0.0:
                continue
            before = invert(core, chain)
            if before is None:
                continue
            # Strict decoding of several bytes is evidence of its own; for single bytes the words must speak.
            evident = chain[0][0] in _MULTI
            if before.isascii() and chain[0][0] != "utf-7" or _NO_TEXT.search(before):
                continue
            margin = float(score[k]) - sound
            if margin > -2.0 if evident else margin > 1.0 and not _mixes_scripts(before):
                out.append((int(k), before, evident, margin))
        return out, first, float(margins[first - 1])

    def lookups(self, word: str, depth: int = 0) -> set[str]:
        """The words whose counts ``judge`` may ask for; none if it finds the word sound whatever they are."""
        core = _core(unescape(word))
        if not core:
            return set()
        candidates, _, margin = self._candidates(core)
        out: set[str] = set()
        for k, before, *_ in candidates:
            out.update(_lookups(before))
            if depth < 2 and chain_may_repeat(k):
                out |= self.lookups(before, depth + 1)
        if candidates or _lost(core) or self._wide(core, margin):
            out.update(_lookups(core))
        return out

    @staticmethod
    def _wide(core: str, margin: float) -> bool:
        # Symbols alone, such as the lines of a drawn tree, are no words that a margin could speak for.
        return any(c.isalpha() for c in core) and margin > 30.0 and margin / len(features(core)) > 1.2

    def judge(self, word: str, depth: int = 0) -> tuple[str, str | None, float]:
        """Chain of the word or ``sound``, what it was before if that can be had back, and the margin over sound text."""
        plain = unescape(word)
        note = "escaped; " if plain != word else ""
        core = _core(plain)
        if not core:
            return SOUND, None, 0.0
        as_is = max(0, self.seen(core) - (self.own if depth == 0 and not note else 0))
        candidates, k, lead = self._candidates(core)
        best: tuple | None = None
        likeness = self._likeness(core) if candidates else 0.0
        for c, before, evident, margin in candidates:
            chain = CHAINS[c - 1]
            count = self.seen(before)
            if as_is > max(2 * self.unit, count) or len(core) == 1 and as_is > (2 if core.isalpha() else 1) * self.unit:
                continue
            if evident:
                # Spaces and punctuation gain nothing in likeness; strict decoding with a margin speaks for them.
                good = count > as_is or self._likeness(before) > likeness or margin > 10.0 and not any(x > "\x7f" and x.isalnum() for x in before)
                # Pairs of bytes decode in the other encodings of several bytes by chance.
                good = good and (chain[0][0] in ("utf-8", "utf-7") or margin > 8.0)
            elif count > max(self.unit, 2 * as_is):
                # A letter by itself that was a frequent dash or quotation mark.
                good = len(before) > 1 or core.isalpha() and not before.isalnum() and count > 20 * self.unit
            else:
                good = margin > 8.0 and self._likeness(before) - likeness > 0.8 and sum(x > "\x7f" and x.isalpha() for x in before) >= 4
            rank = (count >= self.unit, evident, margin)
            if good and (best is None or rank > best[0]):
                best = (rank, c, before, max(margin, 6.0) if evident else margin)
        if best is not None:
            _, k, before, margin = best
            name = NAMES[k]
            if depth < 2 and chain_may_repeat(k):
                again, further, more = self.judge(before, depth + 1)
                if again != SOUND and further is not None:
                    name, before, margin = f"{again}; {name}", further, margin + more
            return note + name, plain.replace(core, before), margin
        lost = _lost(core)
        if lost and as_is <= 2 * self.unit or as_is < self.unit and self._wide(core, lead):
            return note + NAMES[k], None, max(lead, 6.0) if lost else lead
        return SOUND, None, lead

    def passages(self, text: str, verdict=None) -> list[tuple[int, int, str, str | None, float]]:
        """Garbled words of the text: start, end, chain, restored form or null, margin. ``verdict`` gives what a word was
        judged as; by default it is judged here."""
        verdict = verdict or self.known
        out = []
        for a, b in units(text):
            found = [(a, b, *verdict(text[a:b]))]
            if b - a > _WIDEST and found[0][3] is None:
                found = [(a + x, a + y, *verdict(text[a + x : a + y])) for x, y in self.stretches(text[a:b])]
            out += [(x, y, chain, before, margin) for x, y, chain, before, margin in found if chain != SOUND]
        return out

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """Cuts of a long run that can't be inverted as a whole, each where a likely chain's bytes decode up to it."""
        out, at = [], 0
        references = [m.span() for m in _REFERENCE.finditer(run)]
        while at < len(run):
            end = min(at + _WIDEST, len(run))
            end = next((y for x, y in references if x < end < y), end)
            score = self.scores(unescape(run[at:end]))
            likely = [CHAINS[k] for k in np.argsort(-score[1:])[:3] if score[k + 1] > score[0]]
            ends = [e for e in range(end, min(end + _REACH, len(run) + 1)) if not any(x < e < y for x, y in references)]
            end = next((e for chain in likely for e in ends if invert(unescape(run[at:e]), chain) is not None), end)
            out.append((at, end))
            at = end
        return out


def _core(plain: str) -> str:
    """The word without its edges; nothing if it is plain ASCII without shifted base 64."""
    core = plain.strip(_PLAIN_EDGE if _SHIFTED.search(plain) else _EDGE)
    return "" if core.isascii() and not _SHIFTED.search(core) else core


def _lookups(text: str) -> list[str]:
    """Parts of the text that are not plain ASCII."""
    return [w for w in (p.strip(_EDGE) for p in _SPACES.split(text)) if w and not w.isascii()]


def _lost(core: str) -> bool:
    return REPLACEMENT in core or any("\x80" <= c <= "\x9f" for c in core)


def chain_may_repeat(k: int) -> bool:
    return CHAINS[k - 1][-1][0] == "utf-8"


def _mixes_scripts(text: str) -> bool:
    """Whether a word of the text has letters of Latin and of another alphabet."""
    return any(_LATIN.search(w) and _OTHER_ALPHABET.search(w) for w in _SPACES.split(text))


def _parts(word: str) -> list[tuple[int, int]]:
    """The word, or if it is long, its parts up to each full stop of a script without spaces."""
    if _REFERENCE.search(word):
        return [(0, len(word))]
    if "\xa0" in word and (cuts := [m.start() for m in _JOINT.finditer(word)]):
        edges = [0, *cuts, len(word)]
        return [(x + a, x + b) for x, y in zip(edges, edges[1:]) if not word[x:y].isascii() for a, b in _parts_of(word[x:y])]
    return _parts_of(word)


def _parts_of(word: str) -> list[tuple[int, int]]:
    if _HIGH_LATIN.search(word) and _IDEOGRAPH.search(word):
        # Garbled text right beside sound ideographs.
        return [(m.start() + a, m.start() + b) for m in _RUN.finditer(word) if not m[0].isascii() for a, b in _parts_of(m[0])]
    if len(word) <= 40:
        return [(0, len(word))]
    return [(m.start(), m.end()) for m in _PIECE.finditer(word) if m.end() > m.start()]


def self_evident(word: str) -> bool:
    """Bytes of UTF-8 read as a single-byte encoding give themselves away."""
    return REPLACEMENT in word or any((t := invert(word, chain)) is not None and not t.isascii() for chain in CHAINS[:8])


def units(text: str) -> list[tuple[int, int]]:
    """Start and end of every word, or part of a long one, that is judged by itself."""
    return [(m.start() + a, m.start() + b) for m in _WORD.finditer(text) for a, b in _parts(m[0])]


def _words(text: str) -> list[str]:
    return [w for a, b in units(text) for w in _lookups(text[a:b])]


def training_words(df: DataFrame, text: str, rows: int = TRAIN_ROWS) -> Counter:
    """Words that are not plain ASCII with the rows that hold them, of at most ``rows`` rows chosen by the hash of their
    text; the ``LEXICON_WORDS`` most frequent ones."""
    sample = sample_rows(df, df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")), "t", rows)
    counted = _counted(sample).orderBy(F.desc("n"), "w").limit(LEXICON_WORDS)
    return Counter({r["w"]: r["n"] for r in counted.collect()})


def _counted(texts: DataFrame) -> DataFrame:
    """``w, n``: words that are not plain ASCII with the rows that hold them."""

    def split(batches):
        for batch in batches:
            found = [w for t in batch.column(0).to_pylist() for w in set(_words(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.string())], names=["w"])

    return texts.mapInArrow(split, "w string").groupBy("w").agg(F.count("*").alias("n"))


def cut_texts(texts: DataFrame, held) -> DataFrame:
    """``kind, _h, w, need, n`` of distinct texts ``_h, _t``:

    ``word`` rows with how many texts of a task hold a word, ``part`` rows of every unit that a chain could speak for, by
    text, ``word need`` and ``part need`` rows with the words whose counts decide on it, and the number of ``text``.
    """
    kinds = {"kind": pa.string(), "_h": pa.binary(), "w": pa.string(), "need": pa.string(), "n": pa.int64()}

    def rows(kind: str, size: int, **columns) -> pa.RecordBatch:
        filled = {"kind": [kind] * size} | {c: columns.get(c, [None] * size) for c in ("_h", "w", "need", "n")}
        return pa.RecordBatch.from_arrays([pa.array(filled[c], type=t) for c, t in kinds.items()], names=list(kinds))

    def run(batches):
        classifier = Classifier(*held.value)
        lookups = lru_cache(maxsize=100_000)(classifier.lookups)  # words are often parts, too
        counts: Counter = Counter()
        asked: dict[str, dict[str, bool]] = {"word": {}, "part": {}}
        seen = 0

        def needs(kind: str, words: list[str]):
            """Rows of the words that are new to the task, and which of all can be garbled."""
            known = asked[kind]
            if len(known) > HELD_WORDS:
                known.clear()
            found = {w: lookups(w) for w in classifier.suspicious(new)} if (new := [w for w in words if w not in known]) else {}
            known.update((w, bool(found.get(w))) for w in new)
            pairs = [(w, x) for w, need in found.items() for x in need]
            return rows(f"{kind} need", len(pairs), w=[w for w, _ in pairs], need=[x for _, x in pairs])

        def handed_on():
            words = list(counts)
            out = [needs("word", words), rows("word", len(words), w=words, n=list(counts.values()))]
            counts.clear()
            return out

        for batch in batches:
            in_text = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = {t[a:b] for a, b in units(t)}
                counts.update({w for p in parts for w in _lookups(p)})
                for p in [p for p in parts if len(p) > _WIDEST]:
                    parts.update(p[a:b] for a, b in classifier.stretches(p))
                in_text.append((h, parts))
            seen += batch.num_rows
            yield needs("part", list(set().union(*(parts for _, parts in in_text))))
            found = [(h, p) for h, parts in in_text for p in parts if asked["part"].get(p)]
            yield rows("part", len(found), _h=[h for h, _ in found], w=[p for _, p in found])
            if len(counts) > HELD_WORDS:
                yield from handed_on()
        yield from handed_on()
        yield rows("text", 1, n=[seen])

    return texts.mapInArrow(run, "kind string, _h binary, w string, need string, n bigint")


def judged(needs: DataFrame, counts: DataFrame, held) -> DataFrame:
    """``w, chain, before, margin`` of the words that are garbled by the counts ``w, n`` of sound ones that they need."""

    def judge(batches):
        classifier = Classifier(*held.value)
        for batch in batches:
            out = []
            for w, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                classifier.lexicon = {e["w"]: e["n"] for e in entries}
                if (found := classifier.judge(w))[0] != SOUND:
                    out.append((w, *found))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()))], names=["w", "chain", "before", "margin"])

    entry = F.struct("w", F.coalesce("n", F.lit(0)).alias("n"))
    asked = needs.select(F.col("w").alias("word"), F.col("need").alias("w")).distinct().join(counts, "w", "left").groupBy("word").agg(F.collect_list(entry).alias("counts"))  # the needs of one word
    return asked.mapInArrow(judge, "w string, chain string, before string, margin double")


def sound_counts(cut: DataFrame, held) -> DataFrame:
    """``w, n``: in how many texts each word is, without words that give themselves away as garbled, or that the
    classifier takes for it by the counts of all others."""

    def sound(batches):
        for batch in batches:
            keep = [not self_evident(w) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    counts = materialize(cut.where("kind = 'word'").groupBy("w").agg(F.sum("n").alias("n")).mapInArrow(sound, "w string, n bigint"))
    return materialize(counts.join(judged(cut.where("kind = 'word need'"), counts, held), "w", "left_anti"))


def word_counts(texts: DataFrame, held) -> DataFrame:
    """``w, n``: in how many of the texts each sound word is."""
    cut = materialize(cut_texts(texts.select(F.lit(b"").alias("_h"), texts.columns[0]), held))
    return sound_counts(cut, held)


def find_garbled(df: DataFrame, key: str, text: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows with a garbled passage: ``key, passages, chains, restored_text, whole``.

    ``passages`` counts the garbled words, ``chains`` lists the chains of encodings, ``restored_text`` is the text with
    every word put right that could be, and ``whole`` says whether all could. Rows without text, empty and sound ones
    are not in the result; rows repeated in key and text come once; an empty table gives an empty result.
    """
    source = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_t").rlike(r"[^\x00-\x7f]|&#?\w{2,8};|\+[A-Za-z0-9/]{2,}-"))
    source = source.withColumn("_h", F.unhex(F.md5("_t")))
    context = df.sparkSession.sparkContext
    weights = Classifier.train(training_words(df.select(F.col(text).alias("_t")), "_t", rows)).weights
    cut = materialize(cut_texts(source.select("_h", "_t").dropDuplicates(["_h"]), context.broadcast((weights, {}))))
    there = cut.where("kind = 'text'").agg(F.sum("n")).first()[0] or 0
    held = context.broadcast((weights, {}, max(1.0, there / TRAIN_ROWS), 1))
    verdicts = materialize(judged(cut.where("kind = 'part need'"), sound_counts(cut, held), held))
    parts = cut.where("kind = 'part'").select("_h", "w")
    hit = parts.join(verdicts, "w")
    # The garbled words of one text, which is held whole anyway.
    found = hit.groupBy("_h").agg(F.collect_list(F.struct("w", "chain", "before", "margin")).alias("found"))

    def run(batches):
        classifier = Classifier(*held.value)
        for batch in batches:
            keys, numbers, chains, texts, whole = [], [], [], [], []
            for k, t, entries in zip(*(c.to_pylist() for c in batch.columns)):
                known = {e["w"]: (e["chain"], e["before"], e["margin"]) for e in entries}
                passages = classifier.passages(t, lambda w: known.get(w, (SOUND, None, 0.0)))
                if not passages or not convincing(passages):
                    continue
                at, out = 0, []
                for a, b, _, before, _ in passages:
                    out += [t[at:a], t[a:b] if before is None else before]
                    at = b
                keys.append(k)
                numbers.append(len(passages))
                chains.append(sorted({c for _, _, c, _, _ in passages}))
                texts.append("".join([*out, t[at:]]))
                whole.append(all(before is not None for _, _, _, before, _ in passages))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=batch.schema.field(0).type), pa.array(numbers, type=pa.int32()), pa.array(chains, type=pa.list_(pa.string())), pa.array(texts, type=pa.string()), pa.array(whole, type=pa.bool_())],
                names=["_k", "passages", "chains", "restored_text", "whole"],
            )

    kind = source.schema["_k"].dataType.simpleString()
    out = source.join(found, "_h").select("_k", "_t", "found").mapInArrow(run, f"_k {kind}, passages int, chains array<string>, restored_text string, whole boolean")
    return out.dropDuplicates().withColumnRenamed("_k", key)


def convincing(found: list[tuple]) -> bool:
    """Whether the words speak for a garbled passage together: one restored or several of the same kind."""
    margins: Counter = Counter()
    for _, _, chain, before, margin in found:
        if before is not None and margin >= 5.0:
            return True
        margins[chain] += margin
    return max(margins.values()) >= 6.0
