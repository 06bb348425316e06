"""Problem 3: free-entered values mapped to the entries of a reference list.

A multi-pattern automaton over all canonical names and aliases finds mentions embedded in the normalised value; the
longest of the non-overlapping matches wins, unless other words of the list stand beside it: those make another concept.
Words around it that are in no entry don't count. What it leaves goes to token-set similarity: every word of the value
is assigned to the nearest words of the whole list's vocabulary, and an entry is meant if its words are the assigned
ones, each once (a similarity of 1). A word nearer to another word of the list therefore never counts for an entry, and a
value that has one word of the list more or less than an entry names a narrower or broader concept and stays unmatched.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: The list is sent to every task; beyond this bound the operator refuses, as it holds the list in memory.
MAX_FORMS = 500_000

# Words around a name that add nothing to it, in English and German, and look-alike letters.
AROUND = frozenset("the a an our this that der die das ein eine unser unsere dieser diese sog sogenannte sogenannter sogenanntes so called def definition sic siehe see item".split())
LOOKALIKES = str.maketrans("авекмнорстухіѕјԁցһӏԛԝɡαονρτυκεηικ", "abekmhopctyxisjdghlqwgaovptukenik")
# End of the fixed values.

_COMMAND = re.compile(r"\\[A-Za-z]+\s*\{?|[${}]")
_TOKEN = re.compile(r"[^\W_]+\.?")
_CYRILLIC_GREEK = re.compile(r"[Ͱ-ԯ]")


def fold(text: str) -> str:
    """Compatibility forms, case, marks, look-alike letters, markup and invisible characters are evened out."""
    t = unicodedata.normalize("NFKC", text)
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    t = _COMMAND.sub(" ", t).casefold()
    if _CYRILLIC_GREEK.search(t):
        t = t.translate(LOOKALIKES)
    t = unicodedata.normalize("NFD", t)
    return "".join(c for c in t if not unicodedata.combining(c))


def _transliterated(text: str) -> str:
    """German umlauts written with a second letter."""
    t = unicodedata.normalize("NFKC", text).casefold()
    return fold(t.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue"))


def _undigit(token: str) -> str:
    """Digits that stand for letters inside of a word."""
    if token.isalpha() or not any(c.isalpha() for c in token):
        return token
    return token.replace("0", "o").replace("3", "e").replace("1", "i").replace("5", "s").replace("4", "a")


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def allowed(length: int) -> int:
    """Edits at most between two words of which the longer has that length."""
    return 0 if length < 4 else 1 if length < 5 else 2 if length < 8 else 3


class Matcher:
    """The reference list, ready for values. ``forms``: (text, entity id, label of the entity)."""

    def __init__(self, forms: list[tuple[str, str, str | None]]):
        self.labels: dict[str, str] = {}
        self.by_words: dict[tuple[str, ...], set[str]] = defaultdict(set)
        self.alias: dict[str, str] = {}  # other spelling of a word -> word
        self.automaton = ahocorasick.Automaton()
        for text, entity, label in forms:
            self.labels[entity] = (label or "").casefold()
            words = [w.rstrip(".") for w in _TOKEN.findall(fold(text))]
            if not words:
                continue
            self.by_words[tuple(sorted(words))].add(entity)
            for word, other in zip(words, [w.rstrip(".") for w in _TOKEN.findall(_transliterated(text))]):
                self.alias[word] = word
                self.alias.setdefault(other, word)
            pattern = f" {' '.join(words)} "
            held = self.automaton.get(pattern, (pattern, set()))
            self.automaton.add_word(pattern, (pattern, held[1] | {entity}))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.words = sorted(set(self.alias))
        self.longest = max(map(len, self.words), default=0)
        # Entries by each of their words and the number of words.
        self.holding: dict[tuple[str, int], set[tuple[str, ...]]] = defaultdict(set)
        for key in self.by_words:
            for word in key:
                self.holding[word, len(key)].add(key)
        self.by_size: dict[int, list[str]] = defaultdict(list)
        for word in self.words:
            self.by_size[len(word)].append(word)
        # Words by every string that comes of deleting up to two letters.
        self.deletions: dict[str, set[str]] = defaultdict(set)
        for word in self.words:
            for part in self._deleted(word):
                self.deletions[part].add(word)
        self.nearest = lru_cache(maxsize=200_000)(self._nearest)
        self.value = lru_cache(maxsize=200_000)(self._value)

    @staticmethod
    def _deleted(word: str) -> set[str]:
        out = {word}
        for n in range(1, min(2, allowed(len(word) + 2), len(word) - 1) + 1):
            out.update("".join(x) for x in itertools.combinations(word, len(word) - n))
        return out

    def _nearest(self, token: str) -> tuple[int, tuple[str, ...]]:
        """Least edits to a word of the list, and the words that have it; (99, ()) if none is near."""
        if token in self.alias:
            return 0, (self.alias[token],)
        # A word much longer than all of the list is near to none of them, and has too many parts to try.
        most = allowed(len(token) + 2) if 2 < len(token) <= self.longest + 3 else 0
        found: dict[str, int] = {}
        near = set().union(*(self.deletions.get(part, ()) for part in self._deleted(token))) if most else set()
        if not near and most > 2:
            near = {w for size in range(len(token) - most, len(token) + most + 1) for w in self.by_size.get(size, ())}
        for word in near:
            bound = min(most, allowed(max(len(token), len(word))))
            d = distance(token, word, bound)
            if d <= bound:
                target = self.alias[word]
                found[target] = min(d, found.get(target, 99))
        if not found:
            return 99, ()
        least = min(found.values())
        return least, tuple(sorted(w for w, d in found.items() if d == least))

    def _by_abbreviation(self, token: str) -> tuple[str, ...]:
        """Words that the abbreviation ``token`` begins."""
        out = tuple(sorted({self.alias[w] for w in self.words if w.startswith(token) and len(w) > len(token) + 1}))
        if not out and len(token) > 3:
            out = tuple(sorted({self.alias[w] for w in self.words if len(w) > len(token) + 1 and min(distance(token, w[: len(token) + k], 1) for k in (-1, 0, 1)) <= 1}))
        return out

    def _value(self, text: str) -> tuple[str, ...]:
        """Entities that the value can mean, in order; several only if they share the name."""
        folded = fold(text)
        tokens = [t for t in _TOKEN.findall(folded)]
        core = [t for t in tokens if t.rstrip(".") not in AROUND] or tokens
        if not core:
            return ()
        plain = [t.rstrip(".") for t in core]
        # Embedded mentions: the longest of the matches that do not overlap.
        line = f" {' '.join(plain)} "
        if len(self.automaton):
            matches = sorted(((end - len(p) + 1, end, e) for end, (p, e) in self.automaton.iter(line)), key=lambda m: (m[0] - m[1], m[0]))
            if matches:
                a, b, entities = matches[0]
                rest = [self._nearest(_undigit(t))[0] for t in (line[:a] + " " + line[b:]).split()]
                # Another word of the list beside it makes another concept.
                return tuple(sorted(entities)) if all(d > 2 for d in rest) else ()
        choices = []
        for token, raw in zip(plain, core):
            d, words = self.nearest(_undigit(token))
            if d > 0 and raw.endswith(".") and len(token) >= 2 and (short := self._by_abbreviation(token)):
                words = short
            choices.append(words)
        entities = self._sets(choices)
        if not entities and len(choices) > 2 and len(raw_tail := plain[-1]) < 5:
            # A short remark in brackets whose letters are mixed up.
            if re.search(rf"[\[(]\s*{re.escape(raw_tail)}", folded):
                entities = self._sets(choices[:-1])
        if not entities:
            entities = self._run_together("".join(plain)) if len(plain) != 2 or not all(choices) else ()
        return tuple(sorted(entities))

    def _sets(self, choices: list[tuple[str, ...]]) -> set[str]:
        """The entities whose words are one of each of the choices; none if entries with other entities are, too."""
        if not choices or not all(choices):
            return set()
        rarest = min(choices, key=lambda words: sum(len(self.holding.get((w, len(choices)), ())) for w in words))
        keys = set().union(*(self.holding.get((w, len(choices)), ()) for w in rarest))
        found = [self.by_words[key] for key in keys if _assigned(key, choices)]
        return found[0] if found and all(f == found[0] for f in found) else set()

    def _run_together(self, joined: str) -> set[str]:
        """The entry of two words that the value names without space between them, or with it at a wrong place."""
        best: tuple[int, set[str]] = (3, set())
        joined = _undigit(joined)
        # Both sides must be near to a word, so neither can be much longer than the longest.
        most = self.longest + 3
        for cut in range(max(3, len(joined) - most), min(len(joined) - 2, most + 1)) if len(joined) > 6 else ():
            d1, left = self.nearest(joined[:cut])
            if d1 >= best[0]:
                continue
            d2, right = self.nearest(joined[cut:])
            if d1 + d2 < best[0] and (found := self._sets([left, right])):
                best = d1 + d2, found
        return best[1]

    def link(self, text: str | None, label: str | None) -> str | None:
        """The entity meant, ``UNMATCHED``, or null for a null or blank text."""
        if text is None or not text.strip():
            return None
        entities = self.value(text)
        if not entities:
            return UNMATCHED
        if len(entities) > 1 and label:
            for entity in entities:
                if self.labels[entity] == label.strip().casefold():
                    return entity
        return entities[0]


def _assigned(key: tuple[str, ...], choices: list[tuple[str, ...]]) -> bool:
    """Whether each word of the key can be given to a choice of its own that has it (augmenting paths)."""
    owner: dict[int, int] = {}

    def place(k: int, tried: set[int]) -> bool:
        for c, words in enumerate(choices):
            if c not in tried and key[k] in words:
                tried.add(c)
                if c not in owner or place(owner[c], tried):
                    owner[c] = k
                    return True
        return False

    return all(place(k, set()) for k in range(len(key)))


def forms_of(entities: DataFrame) -> list[tuple[str, str, str | None]]:
    """Names and aliases of the list, once each."""
    names = entities.select("name", "entity_id", "label")
    other = entities.select(F.explode("entity_instances").alias("i"), "entity_id", "label").select(F.col("i.text").alias("name"), "entity_id", "label")
    rows = names.unionByName(other).where("name IS NOT NULL AND entity_id IS NOT NULL").dropDuplicates().limit(MAX_FORMS + 1).collect()
    if len(rows) > MAX_FORMS:
        raise ValueError(f"the reference list has more than {MAX_FORMS} names")
    return sorted(((r["name"], r["entity_id"], r["label"]) for r in rows), key=repr)


def link(mentions: DataFrame, entities: DataFrame, key: str = "seq", text: str = "text", label: str = "label") -> DataFrame:
    """``key, entity_id`` of every value that is neither null nor blank; ``UNMATCHED`` if the list has none.

    Where entities share a name, the label decides; without a label that fits, the first id. Values that occur on
    several rows of a key count once. An empty reference list leaves all unmatched; other columns are not read.
    """
    spark = mentions.sparkSession
    held = spark.sparkContext.broadcast(forms_of(entities))
    source = mentions.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(label).alias("_l"))
    kind = source.schema["_k"].dataType.simpleString()

    def run(batches):
        matcher = Matcher(held.value)
        for batch in batches:
            found = [matcher.link(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.string())], names=["_k", "entity_id"])

    return source.mapInArrow(run, f"_k {kind}, entity_id string").where("entity_id IS NOT NULL").dropDuplicates().withColumnRenamed("_k", key)
