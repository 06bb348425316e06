"""Problem 5: languages of texts and of their segments, whatever their labels say.

Cross-parsing. A suffix automaton of labelled text is built for every language; a sentence is parsed greedily into the
longest phrases that occur in that text, and the language that needs fewest phrases fits best. Phrases are normalised
by the logarithm of the automaton's text, as in the estimate of cross entropy by parsing, so that a language with less
labelled text is no worse off. Sentences of a text are then labelled together: the cheapest sequence of languages, where
every change costs ``SWITCH`` phrases, so that single foreign words, names, headings and formulas make no segment.

Only languages that share a script are parsed against each other; in any other language each letter is a phrase of its
own. All sentences of an Arrow batch are parsed in lockstep, one array operation for each character position.

Confidence is the posterior of the language, from phrases by a factor fitted on labelled sentences that are in no
automaton, times how well the text fits: the phrases a letter that the language usually needs, over those it needs here.
Text of a language that is not among the known ones therefore gets the nearest one with a low confidence.

The labelled text is a bounded sample (``ROWS_A_LANGUAGE`` rows of texts under ``SAMPLE_CHARS`` characters). Labels are
partly wrong, so a naive Bayes model of the sample checks each sentence, and only those that agree with their label go
into an automaton (``AUTOMATON_CHARS`` at most).
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecraft.llm.pairs import LanguageModel, softmax
from cuecraft.llm.sampling import sample_groups
from cuecraft.llm.sentences import spans

#: Bounds of the fit: rows of a language, characters of a text, characters in its automaton, sentences that calibrate.
ROWS_A_LANGUAGE, SAMPLE_CHARS, HELD_BACK = 600, 5_000, 60
AUTOMATON_CHARS = {"latin": 28_000, "cyrillic": 28_000, "devanagari": 20_000, "arabic": 20_000, "thai": 20_000, "han": 14_000}
SWITCH = 4.0
#: Transitions of a group up to which they are held as one table; beyond it only branching states have a row.
_TABLE = 1 << 25

# Languages, their scripts, and the names of a label that mean them.
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "zh", "ja", "th", "hi", "ar")
GROUPS = {"latin": ("en", "de", "fr", "es", "it", "pt", "nl"), "cyrillic": ("ru",), "devanagari": ("hi",), "arabic": ("ar",), "thai": ("th",), "han": ("zh", "ja")}
LABELS = {
    "en": "en eng english englisch anglais inglés",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch",
    "it": "it ita italian italiano italienisch",
    "pt": "pt por portuguese português portugues portugiesisch",
    "nl": "nl nld dut dutch nederlands niederländisch",
    "ru": "ru rus russian русский russisch",
    "zh": "zh zho chi chinese 中文 汉语 cmn mandarin chinesisch",
    "ja": "ja jpn japanese 日本語 jp japanisch",
    "th": "th tha thai ไทย",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ar": "ar ara arabic العربية عربي arabisch",
}
#: Code points of the scripts: class, first, last.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("cyrillic", 0x400, 0x52F), ("devanagari", 0x900, 0x97F),
    ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("thai", 0xE01, 0xE5B), ("kana", 0x3041, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0xF900, 0xFAFF),
)
# End of the fixed values.

_BY_NAME = {name: lang for lang, names in LABELS.items() for name in names.split()}
_CLASSES = ("none", "latin", "cyrillic", "devanagari", "arabic", "thai", "han", "kana")
_WEIGHT = np.array([0, 1, 1.5, 1.5, 1.5, 1.5, 3, 3])
_MAX = 0x10000
_WORD = re.compile(r"[^\W\d_]{3,}|[Ѐ-῿⺀-鿿]{2,}|[ऀ-ॿ؀-ۿ฀-๿]+")
_PLAIN_WORD = re.compile(r"(?:^|(?<=[\s(\"'«„“¿¡]))[^\W\d_]{3,}(?=[\s.,;:!?…)]|$)|[⺀-\uffdc]{2,}")
_LONGEST_WORD = 60
_ODD = np.array([chr(c) in "0123456789+=^{}\\$" for c in range(128)])
_NO_WORDS = re.compile(r"\$[^$]*\$|[!-~]*[\d+=^{}\\][!-~]*|[!-~]{60,}")


def script_table() -> np.ndarray:
    table = np.zeros(_MAX, dtype=np.uint8)
    for name, a, b in SCRIPTS:
        table[a : b + 1] = _CLASSES.index(name)
    table[[0xD7, 0xF7]] = 0
    return table


def no_words(points: np.ndarray) -> np.ndarray:
    """Which characters belong to runs of plain ASCII that have digits or signs of formulas, or are too long for a word."""
    plain = (points > 32) & (points < 127)
    starts = plain & ~np.concatenate([[False], plain[:-1]]) if len(points) else plain
    run = np.cumsum(starts)
    sizes = np.bincount(run[plain], minlength=int(run[-1]) + 1 if len(run) else 1)
    odd = sizes > _LONGEST_WORD
    odd[run[plain & _ODD[np.minimum(points, 127)]]] = True
    return plain & odd[run]


def label_language(label: str | None) -> str | None:
    """The language that a label names, in whatever spelling; null if it is missing or says that it isn't known."""
    if not label:
        return None
    name = label.strip().casefold()
    return _BY_NAME.get(name) or _BY_NAME.get(re.split(r"[-_ (]", name)[0])


def label_column(label: Column) -> Column:
    """The same as ``label_language`` as a column."""
    names = F.create_map(*(F.lit(x) for item in _BY_NAME.items() for x in item))
    name = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(names[name], names[F.split(name, r"[-_ (]", 2)[0]])


def codes(text: str) -> np.ndarray:
    """Lower-case code points; those beyond the basic plane become 0. Lowering keeps every position."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < _MAX, points, 0).astype(np.int32)


def automaton_moves(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all factors of ``text`` (symbols from 1; 0 matches nothing). State 0 stands for no
    match and state 1 for the start."""
    link, length, moves = [0, -1], [0, 0], [{}, {}]
    last = 1
    link[1] = 0
    for symbol in text.tolist():
        if symbol == 0:
            last = 1
            continue
        if symbol in moves[last]:
            # Generalised: the factor is there already.
            q = moves[last][symbol]
            if length[q] == length[last] + 1:
                last = q
                continue
            clone = len(moves)
            length.append(length[last] + 1)
            moves.append(dict(moves[q]))
            link.append(link[q])
            p = last
            while p > 0 and moves[p].get(symbol) == q:
                moves[p][symbol] = clone
                p = link[p]
            link[q] = clone
            last = clone
            continue
        current = len(moves)
        length.append(length[last] + 1)
        moves.append({})
        link.append(1)
        p = last
        while p > 0 and symbol not in moves[p]:
            moves[p][symbol] = current
            p = link[p]
        if p > 0:
            q = moves[p][symbol]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(moves)
                length.append(length[p] + 1)
                moves.append(dict(moves[q]))
                link.append(link[q])
                while p > 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    return moves


def suffix_automaton(text: np.ndarray, size: int) -> np.ndarray:
    """The transitions as a table of states by symbols below ``size``; 0 is none."""
    moves = automaton_moves(text)
    table = np.zeros((len(moves), size), dtype=np.int32)
    for state, out in enumerate(moves):
        table[state, list(out)] = list(out.values())
    return table


class Group:
    """The automata of the languages of one script, over one alphabet.

    Transitions are kept as keys (state times the alphabet's size plus symbol, sorted) and targets; tasks unfold them.
    ``scale`` normalises each language's phrases by the text in its automaton.
    """

    def __init__(self, languages: tuple[str, ...], symbols: np.ndarray, keys: np.ndarray, targets: np.ndarray, states: int, starts: np.ndarray, scale: np.ndarray):
        self.parts = (languages, symbols, keys, targets, states, starts, scale)
        self.languages, self.starts, self.scale, self.width = languages, starts.astype(np.int32), scale, len(symbols) + 1
        self.alphabet = np.zeros(_MAX, dtype=np.int32)
        self.alphabet[symbols] = np.arange(1, self.width)
        state, symbol = np.divmod(keys, self.width)
        fans = np.bincount(state, minlength=states)
        self.dense = states * self.width <= _TABLE
        rows = np.arange(states) if self.dense else np.cumsum(fans > 1) * (fans > 1)
        self.row = rows.astype(np.int32)
        self.table = np.zeros((int(rows.max()) + 1, self.width), dtype=np.int32)
        branch = slice(None) if self.dense else fans[state] > 1
        self.table[rows[state[branch]], symbol[branch]] = targets[branch]
        if self.dense:
            # States as offsets of their rows in the flat table: a step is one addition and one look-up.
            self.flat = self.table.ravel()
            self.flat *= np.int32(self.width)
        else:
            self.only, self.to = np.zeros(states, dtype=np.int32), np.zeros(states, dtype=np.int32)
            single = fans[state] == 1
            self.only[state[single]], self.to[state[single]] = symbol[single], targets[single]
        # What a new phrase begins with; an unknown symbol leaves at the start.
        unit = np.int32(self.width if self.dense else 1)
        begin = self.starts * unit
        every = np.arange(self.width)
        first = np.stack([self.step(np.full(self.width, b, dtype=np.int32), every) for b in begin])
        self.begin, self.first = begin, np.where(first > 0, first, begin[:, None]).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.flat.take(state + symbol)
        return np.where((self.only.take(state) == symbol) & (symbol > 0), self.to.take(state), self.table[self.row.take(state), symbol])

    @classmethod
    def build(cls, languages: tuple[str, ...], texts: dict[str, list[np.ndarray]], most: int) -> Group | None:
        have = tuple(lang for lang in languages if texts.get(lang))
        if not have:
            return None
        gap = np.zeros(1, dtype=np.int32)
        joined = {lang: np.concatenate([x for t in texts[lang] for x in (t, gap)])[: most + 1] for lang in have}
        symbols = np.unique(np.concatenate(list(joined.values())))
        symbols = symbols[symbols > 0]
        alphabet = np.zeros(_MAX, dtype=np.int32)
        alphabet[symbols] = np.arange(1, len(symbols) + 1)
        width, keys, targets, starts, offset = len(symbols) + 1, [], [], [], 0
        for lang in have:
            moves = automaton_moves(alphabet[joined[lang]])
            for state, out in enumerate(moves):
                keys += [(state + offset) * width + symbol for symbol in out]
                targets += [to + offset for to in out.values()]
            starts.append(offset + 1)
            offset += len(moves)
        scale = np.array([math.log(max(len(joined[lang]), 3)) / math.log(most) for lang in have])
        return cls(have, symbols, np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int32), offset, np.array(starts), scale)

    def phrases(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases that each stretch of ``points`` needs, by language: an array of stretches by languages."""
        out = np.zeros((len(begin), len(self.languages)), dtype=np.int32)
        symbols = self.alphabet[points]
        order = np.argsort(-size, kind="stable")
        k = len(self.languages)
        for block in range(0, len(order), 2048):
            rows = order[block : block + 2048]
            at, sizes = begin[rows], size[rows]
            n = len(rows)
            state = np.repeat(self.begin[:, None], n, axis=1)
            count = np.ones((k, n), dtype=np.int32)
            # How many stretches are longer than each position; they come first.
            alive = n - np.searchsorted(sizes[::-1], np.arange(1, int(sizes[0]) + 1), side="left")
            for i, m in enumerate(alive.tolist()):
                symbol = symbols[at[:m] + i]
                step = self.step(state[:, :m], symbol)
                failed = step == 0
                count[:, :m] += failed
                state[:, :m] = np.where(failed, self.first.take(symbol, axis=1), step)
            out[rows] = count.T
        return out


class Identifier:
    """``temper`` turns phrases into log probabilities; ``usual`` are the phrases a letter of each language's own text."""

    def __init__(self, groups: dict[str, Group], temper: float = 0.5, usual: np.ndarray | None = None):
        self.groups, self.temper = groups, temper
        self.usual = usual if usual is not None else np.full(len(LANGUAGES), 0.2)
        self.scripts = script_table()

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> Identifier:
        """Rows of (text, language label in any spelling)."""
        known = [(t, lang) for t, label in rows if t and (lang := label_language(label))]
        scripts = script_table()
        model = LanguageModel.train(known, LANGUAGES)
        texts: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        held: dict[str, list[str]] = {}
        for text, lang in known:
            group = next(g for g, members in GROUPS.items() if lang in members)
            if len(held.get(lang, ())) >= HELD_BACK:
                continue
            for a, b in spans(text):
                unit = text[a:b]
                if len(unit) < 15 and group != "han" or len(unit) > 400:
                    continue
                points = codes(unit)
                classes = np.bincount(scripts[points], minlength=len(_CLASSES))
                fits = classes[6] + classes[7] if group == "han" else classes[_CLASSES.index(group)]
                if fits < 0.5 * len(unit) or group == "han" and (lang == "zh") == bool(classes[7] > 1):
                    continue
                if len(GROUPS[group]) > 1 and ((scores := model.scores(unit)) is None or LANGUAGES[int(scores.argmax())] != lang):
                    continue
                if size.get(lang, 0) <= AUTOMATON_CHARS[group]:
                    texts.setdefault(lang, []).append(points)
                    size[lang] = size.get(lang, 0) + len(points) + 1
                elif len(held.setdefault(lang, [])) < HELD_BACK:
                    held[lang].append(unit)
        groups = {name: g for name, most in AUTOMATON_CHARS.items() if (g := Group.build(GROUPS[name], texts, most)) is not None}
        return cls(groups).calibrated(held)

    def calibrated(self, held: dict[str, list[str]]) -> Identifier:
        units = [(t, LANGUAGES.index(lang)) for lang, ts in held.items() for t in ts]
        if not units:
            return self
        cost, letters = self.costs([t for t, _ in units], [[(0, len(t))] for t, _ in units])
        right = np.array([lang for _, lang in units])
        own = cost[np.arange(len(right)), right]
        for lang in set(right.tolist()):
            self.usual[lang] = np.quantile((own / np.maximum(letters, 1))[right == lang], 0.9)
        loss = lambda t: -np.mean(np.log(softmax(-cost * t)[np.arange(len(right)), right] + 1e-9))
        self.temper = float(min(np.geomspace(0.05, 2.0, 25), key=loss))
        return self

    def confidence(self, cost: np.ndarray, letters: float, lang: int) -> float:
        posterior = float(softmax(-cost * self.temper)[lang])
        fit = min(1.0, float(self.usual[lang]) * letters / cost[lang]) if cost[lang] > 0 else 1.0
        return round(float(posterior * fit), 4)

    def costs(self, texts: list[str], units: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed by every unit of every text in every language, and the letters of every unit."""
        points = [codes(t) for t in texts]
        lengths = np.array([len(p) for p in points], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = np.concatenate(points) if points else np.zeros(0, dtype=np.int32)
        begin = np.array([offsets[i] + a for i, x in enumerate(units) for a, _ in x], dtype=np.int64)
        end = np.array([offsets[i] + b for i, x in enumerate(units) for _, b in x], dtype=np.int64)
        # Formulas, codes and the like are in no language: they are taken out.
        keep = ~no_words(flat)
        kept = np.concatenate([[0], np.cumsum(keep)])
        flat, begin, size = flat[keep], kept[begin], kept[end] - kept[begin]
        n = len(begin)
        classes = self.scripts[flat]
        letters = np.zeros((n, len(_CLASSES)))
        if n:
            for c in range(1, len(_CLASSES)):
                sums = np.concatenate([[0], np.cumsum(classes == c)])
                letters[:, c] = sums[begin + size] - sums[begin]
        weighted = letters * _WEIGHT
        weighted[:, 6] += weighted[:, 7]
        weighted[:, 7] = 0
        main = weighted.argmax(axis=1)
        total = letters.sum(axis=1)
        cost = np.repeat(total[:, None], len(LANGUAGES), axis=1)  # every letter a phrase
        for c, name in enumerate(_CLASSES[1:7], 1):
            rows = np.flatnonzero((main == c) & (total > 0))
            if not rows.size:
                continue
            group = self.groups.get(name)
            if group is None:
                # Without labelled text of the script nothing is told beyond the script.
                for lang in GROUPS[name]:
                    cost[rows, LANGUAGES.index(lang)] = total[rows] / 2.0
                continue
            found = group.phrases(flat, begin[rows], size[rows]) * group.scale
            for k, lang in enumerate(group.languages):
                cost[rows, LANGUAGES.index(lang)] = np.minimum(found[:, k], total[rows])
        return cost, total

    @staticmethod
    def segments(cost: np.ndarray, switch: float = SWITCH) -> list[int]:
        """Language of every unit: the cheapest sequence, a change between units costing ``switch`` phrases."""
        best = cost.argmin(axis=1)
        if (best == best[0]).all():
            return best.tolist()
        total = cost[0].copy()
        back = np.zeros(cost.shape, dtype=np.int64)
        for i in range(1, len(cost)):
            cheapest = int(total.argmin())
            change = total[cheapest] + switch
            stay = total <= change
            back[i] = np.where(stay, np.arange(len(total)), cheapest)
            total = np.where(stay, total, change) + cost[i]
        path = [int(total.argmin())]
        for i in range(len(cost) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]

    def identify(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Segments of every text: language, start, end, confidence. Texts without words have none."""
        units = [spans(t) if has_words(t) else [] for t in texts]
        cost, letters = self.costs(texts, units)
        out, at = [], 0
        for x in units:
            rows = cost[at : at + len(x)]
            counts = letters[at : at + len(x)]
            at += len(x)
            found: list[tuple[str, int, int, float]] = []
            if len(x) and counts.sum() > 0:
                path = self.segments(rows)
                k = 0
                while k < len(path):
                    end = k
                    while end + 1 < len(path) and path[end + 1] == path[k]:
                        end += 1
                    sums = rows[k : end + 1].sum(axis=0)
                    confidence = self.confidence(sums, float(counts[k : end + 1].sum()), path[k])
                    found.append((LANGUAGES[path[k]], x[k][0], x[end][1], confidence))
                    k = end + 1
            out.append(found)
        return out


def has_words(text: str) -> bool:
    """Whether the text has a word; formulas, symbols and strings of letters and numbers have none."""
    if not text or text.isspace():
        return False
    if _PLAIN_WORD.search(text):
        return True
    return _WORD.search(text) is not None and _WORD.search(_NO_WORDS.sub(" ", text)) is not None


def identify(df: DataFrame, key: str, text: str, label: str, labelled: DataFrame | None = None, only_cases: bool = False) -> DataFrame:
    """Segments of every text with words: ``key, seg_no, lang, start_char, end_char, confidence, declared``.

    ``declared`` is the language that the label names, or null. With ``only_cases`` come only the texts whose label is
    missing, names another language, or that have segments of several. Texts without words, null and empty ones have
    no rows; rows repeated in key, text and label give theirs once. ``labelled`` (``text, lang``; by default the table
    itself) teaches the languages. Other columns are not read; an empty table gives an empty result.
    """
    source = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(label).alias("_l")).where(F.col("_t").isNotNull())
    known = labelled.select(F.col("text").alias("_t"), F.col("lang").alias("_l")) if labelled is not None else df.select(F.col(text).alias("_t"), F.col(label).alias("_l"))
    named = known.select("_t", label_column(F.col("_l")).alias("_l")).where(F.col("_l").isNotNull())
    sample = sample_groups(named, "_l", named.where(F.col("_t").isNotNull() & (F.length("_t") < SAMPLE_CHARS)), "_t", ROWS_A_LANGUAGE)
    trained = Identifier.train(sorted(((r["_t"], r["_l"]) for r in sample.collect()), key=lambda x: (zlib.crc32(x[0].encode()), x)))
    held = df.sparkSession.sparkContext.broadcast(({n: g.parts for n, g in trained.groups.items()}, trained.temper, trained.usual))
    kind = source.schema["_k"].dataType.simpleString()

    def run(batches):
        groups, temper, usual = held.value
        identifier = Identifier({n: Group(*parts) for n, parts in groups.items()}, temper, usual)
        for batch in batches:
            texts, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows: list[tuple] = []
            take: list[int] = []
            for i, (segments, name) in enumerate(zip(identifier.identify(texts), labels)):
                declared = label_language(name)
                if only_cases and len(segments) == 1 and segments[0][0] == declared:
                    continue
                rows += [(n, *s, declared) for n, s in enumerate(segments)]
                take += [i] * len(segments)
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, type=pa.int64())), *(pa.array(c, type=t) for c, t in zip(columns, kinds))],
                names=["_k", "seg_no", "lang", "start_char", "end_char", "confidence", "declared"],
            )

    out = source.mapInArrow(run, f"_k {kind}, seg_no int, lang string, start_char int, end_char int, confidence double, declared string")
    return out.dropDuplicates().withColumnRenamed("_k", key)
