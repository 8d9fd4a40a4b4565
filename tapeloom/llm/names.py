"""Names as people type them, linked to the entity they mean.

The words of the entities' names are laid out in a trie, one a block of entities, and the words of typed names that are
no words of their own walk it as Levenshtein automata: bit sets of the positions reached with 0, 1, 2 edits (a swap of
neighbours is one), so a branch is left as soon as no position is alive. The neighbours of its rare words give a
name's candidates. For each of them the typed words are matched to the entity's in any order, each word to one slot, by
spelling, short form, familiar form or initial; what is left over on either side decides whether the name can mean it.
All readings of a name (as typed, words joined or parted, letters as initials) are weighed by cost, and a reading is
left out only where it must cost more than one already found.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Container, Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.name_lexicon import EXPANSIONS, FAMILIAR, LEGAL_FORMS, SHORT_FORMS, SILENT, TITLES

#: Entities laid out and broadcast at a time, about 1 kB each in a worker.
ENTITY_BLOCK = 50_000
#: The edits allowed in a whole name, and the words that may be left over: initials and legal forms that the entity lacks, misspelt titles.
MOST_EDITS, MOST_EXTRA = 3, 6
PREFIX_LEAST = 3
#: Names a task looks up, at about a tenth of a millisecond each.
ROWS_PER_TASK = 20_000
#: A name of more than one row in HOT is spread over the tasks.
HOT = 200

_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d", "’": "'"})
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿāăąćčďđęěğłńňőœřśšťůűźżž])(?=[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĘĚĞŁŃŇŐŒŘŚŠŤŮŰŹŻŽ]\w)")
_DOTTED = re.compile(r"(?<![^\W_])(?:[^\W\d_]\.){2,}(?:[^\W\d_](?![^\W_]))?")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS)


def _undotted(m: re.Match[str]) -> str:
    """s.a. is a legal form and one word; of other pairs, as in d.r. miller, each letter stands for a name."""
    letters = m[0].replace(".", "")
    return f"{letters} " if len(letters) > 2 or letters in _LEGAL else f"{' '.join(letters)} "


def typed_words(name: str) -> list[str]:
    """The words of a name, folded; s.a. is one word, and a capital after a small letter begins a new one unless it stands alone, as in MoF."""
    name = _CAMEL.sub(" ", name)
    name = fold(name).replace("'", "")
    name = _DOTTED.sub(_undotted, name)
    return _WORDS.findall(name)


def edits_allowed(word: str) -> int:
    n = len(word)
    return 0 if n < 4 else 1 if n < 7 else 2


class Trie:
    """Words as arrays of nodes, level by level, children side by side; a set of typed words walks it together.

    The walk is the join of the words with their neighbours: each pair of a typed word and a node that may still lead to one
    carries its automaton's state, bit sets of the positions reached with 0, 1, 2 edits, and a level is one step for all pairs.
    """

    #: The letters of a word that the bit sets hold, and the most masks (words times letters of the trie) laid out at a time.
    LETTERS, MASKS = 62, 4_000_000

    def __init__(self, words: Iterable[str] = ()) -> None:
        every = sorted({w for w in words if w})
        self.long = [w for w in every if len(w) > self.LETTERS]
        self.words = [w for w in every if len(w) <= self.LETTERS]
        n, widest = len(self.words), max(map(len, self.words), default=0)
        size = np.fromiter(map(len, self.words), np.int64, n)
        letters = np.full((n, widest), -1, np.int64)
        letters[np.arange(widest) < size[:, None]] = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(letters[letters >= 0])
        at = np.zeros(n, np.int64)  # the node of each word's beginning
        parents, marks, ends, nodes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1)], 1
        for j in range(widest):
            here = np.flatnonzero(size > j)
            up, c = at[here], letters[here, j]
            new = np.concatenate(([True], (up[1:] != up[:-1]) | (c[1:] != c[:-1])))
            at[here] = nodes - 1 + np.cumsum(new)
            parents.append(up[new])
            marks.append(np.searchsorted(self.alphabet, c[new]))
            end = np.full(int(new.sum()), -1)
            over = here[size[here] == j + 1]
            end[at[over] - nodes] = over
            ends.append(end)
            nodes += len(end)
        parent, self.letter, self.end = (np.concatenate(x) for x in (parents, marks, ends))
        self.first = np.searchsorted(parent[1:], np.arange(nodes)) + 1
        self.children = np.bincount(parent[1:], minlength=nodes)

    def near(self, word: str, k: int) -> list[tuple[str, int]]:
        """The words within k edits, a swap of neighbours being one."""
        return self.join([word], k)[0]

    def join(self, typed: list[str], k: int) -> list[list[tuple[str, int]]]:
        """near() for many words."""
        out: list[list[tuple[str, int]]] = [[] for _ in typed]
        if self.long:
            for i, word in enumerate(typed):
                if len(word) + k > self.LETTERS:
                    out[i].extend((w, d) for w in self.long if (d := edits_between(word, w, k)) is not None)
        fits = [i for i, word in enumerate(typed) if len(word) <= self.LETTERS]
        for i, word in enumerate(typed):  # too long for the bit sets
            if self.LETTERS < len(word) <= self.LETTERS + k:
                out[i].extend((w, d) for w in self.words if (d := edits_between(word, w, k)) is not None)
        many = max(1, self.MASKS // max(1, len(self.alphabet)))
        for lo in range(0, len(fits) if self.words else 0, many):
            part = fits[lo : lo + many]
            for q, w, d in self._walk([typed[i] for i in part], k):
                out[part[q]].append((self.words[w], d))
        return out

    def _walk(self, typed: list[str], k: int) -> Iterator[tuple[int, int, int]]:
        n, one = len(typed), np.uint64(1)
        size = np.fromiter(map(len, typed), np.int64, n)
        letters = np.frombuffer("".join(typed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        whose = np.repeat(np.arange(n), size)
        place = (np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        code = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        has = self.alphabet[code] == letters
        masks = np.zeros((n, len(self.alphabet)), np.uint64)
        np.bitwise_or.at(masks, (whose[has], code[has]), one << place[has])
        last = size.astype(np.uint64)
        full = (one << last + one) - one
        q, node = np.arange(n), np.zeros(n, np.int64)
        now = [((one << np.uint64(d + 1)) - one) & full for d in range(k + 1)]
        before = [np.zeros(n, np.uint64) for _ in range(k)]
        swap = np.zeros(n, np.uint64)
        while len(q):
            fan = self.children[node]
            source = np.repeat(np.arange(len(q)), fan)
            node = np.repeat(self.first[node] - np.cumsum(fan) + fan, fan) + np.arange(len(source))
            q = q[source]
            mask = masks[q, self.letter[node]]
            turned, whole = mask & swap[source], full[q]
            old = [x[source] for x in now]
            state = [(old[0] & mask) << one]
            for d in range(1, k + 1):
                state.append(((old[d] & mask) << one | old[d - 1] | old[d - 1] << one | state[d - 1] << one | (before[d - 1][source] & turned) << np.uint64(2)) & whole)
            alive = np.flatnonzero(state[k])
            q, node, swap = q[alive], node[alive], mask[alive] >> one
            now, before = [x[alive] for x in state], [x[alive] for x in old[:k]]
            hit = np.flatnonzero((self.end[node] >= 0) & (now[k] >> last[q] & one).astype(bool))
            if len(hit):
                at, edits = q[hit], np.full(len(hit), k)
                for d in range(k - 1, -1, -1):
                    edits[(now[d][hit] >> last[at] & one).astype(bool)] = d
                yield from zip(at.tolist(), self.end[node[hit]].tolist(), edits.tolist(), strict=True)


def edits_between(typed: str, word: str, k: int) -> int | None:
    """The edits from one to the other if they are at most k; for words that the bit sets don't hold."""
    if abs(len(typed) - len(word)) > k:
        return None
    far = k + 1
    rows = [[far] * (2 * k + 1), [far] * (2 * k + 1), [abs(j) if j >= 0 else far for j in range(-k, k + 1)]]
    for i in range(1, len(typed) + 1):  # a band of the table of distances, in which j - i runs from -k to k
        row = []
        for x in range(2 * k + 1):
            j = i + x - k
            if not 0 <= j <= len(word):
                row.append(far)
                continue
            best = min(rows[-1][x + 1] + 1 if x < 2 * k else far, row[-1] + 1 if x else far)
            if j:
                best = min(best, rows[-1][x] + (typed[i - 1] != word[j - 1]))
                if i > 1 and j > 1 and typed[i - 1] == word[j - 2] and typed[i - 2] == word[j - 1]:
                    best = min(best, rows[-2][x] + 1)
            row.append(min(best, far))
        rows.append(row)
    d = rows[-1][len(word) - len(typed) + k]
    return d if d <= k else None


_LEGAL: dict[str, str] = {}
for _word, _forms in LEGAL_FORMS.items():
    for _form in _forms:
        _LEGAL.setdefault(_form, _word)
_MEANS: dict[str, set[str]] = defaultdict(set)
for _table in (LEGAL_FORMS, SHORT_FORMS, FAMILIAR):
    for _word, _forms in _table.items():
        for _form in _forms:
            _MEANS[_form].add(_word)
_GIVEN = {*FAMILIAR, *(f for forms in FAMILIAR.values() for f in forms)}
#: Titles and articles that may be misspelt.
_NOISE = {w for w in (*TITLES, *SILENT) if len(w) > 2}

_NOBODY: frozenset[int] = frozenset()
_NOTHING: frozenset[str] = frozenset()
#: What it costs to leave a word of the entity's out, by role. None: it can't be left out.
OMITTED = {"core": None, "plain": None, "given": None, "business": 0.6, "legal": 0.1, "middle": 0.1}
SHORT, ABBREVIATED, CONTRACTED, EXTRA_INITIAL, INITIAL, WRONG_LEGAL, LOOSE = 0.2, 0.3, 1.3, 0.3, 0.5, 0.7, 0.5
#: What it costs to read words otherwise than they are written: joined, parted or taken as initials; or as a misspelt title.
OTHERWISE, ACRONYM, NOISE, EDIT = 0.3, 0.4, 1.0, 1.0
ALL_INITIALS = {True: 1.0, False: 1.2}


def slots_of(name: str, kind: str | None) -> list[tuple[str, str]]:
    """(word, role) of an entity's name."""
    words = [w for w in typed_words(name) if w not in SILENT]
    if not words:
        return []
    if kind == "PERSON":
        return [(w, "core" if i == len(words) - 1 else "given" if i == 0 else "middle") for i, w in enumerate(words)]
    if kind == "COMPANY":
        out = [(w, "core" if i == 0 else "business") for i, w in enumerate(words)]
        while len(out) > 1 and out[-1][0] in _LEGAL and out[-1][1] != "legal":
            out = out[:-1] + [(_LEGAL[out[-1][0]], "legal")]
        return out
    return [(w, "plain") for w in words]


class Vocabulary:
    """The words of all entities' names, whichever block they are in: what is a word of its own, and what a misspelt word may be."""

    def __init__(self, words: Iterable[tuple[str, bool]]) -> None:
        """words: (word, whether it stands anywhere but as the core of a name)."""
        self.known: set[str] = set()
        self.words: set[str] = set()
        for word, other in words:
            self.known.add(word)
            if other:
                self.words.add(word)
        # a short or familiar form of a word that no entity has is as good as unknown
        self.known |= {form for form, means in _MEANS.items() if form in _LEGAL or not means.isdisjoint(self.known)}


def vocabulary_of(name: str | None, kind: str | None) -> Iterator[tuple[str, bool]]:
    for word, role in slots_of(name or "", kind):
        yield word, role not in ("core", "plain")


def contracts(typed: str, word: str) -> bool:
    """The typed word is a shortening: its letters stand in the word in this order, the first one first, and it lacks a third of them or more."""
    if typed[0] != word[0] or not PREFIX_LEAST <= len(typed) <= len(word) * 2 // 3:
        return False
    rest = iter(word)
    return all(c in rest for c in typed)


#: Endings of familiar names, which follow on a beginning of the given name, its last letter doubled or not.
_FAMILIAR_END = re.compile(r"(?:ie|ey|y|i)$")


def is_familiar(typed: str, given: str) -> bool:
    """The beginning of a given name, with or without a familiar ending, as in Chris, Danny, Andy. Of what the lexicon has, it alone decides."""
    if len(typed) < 3 or typed in _GIVEN:
        return False
    if given.startswith(typed):
        return len(typed) + 2 <= len(given)
    stem = _FAMILIAR_END.sub("", typed)
    if stem == typed:
        return False
    if len(stem) > 2 and stem[-1] == stem[-2]:
        stem = stem[:-1]
    return len(stem) > 1 and given.startswith(stem) and len(stem) + 2 <= len(given)


def cost_of(typed: str, word: str, role: str, means: Container[str], strange: bool, near: dict[str, int] | None) -> tuple[float, int] | None:
    """(cost, edits) of the typed word standing for another of the entity's. means: what it is a short form of; strange: it is no
    word of its own, else it is no misspelling of another; near: its neighbours, if they have been looked up."""
    size = len(typed)
    if size == 1 or len(word) == 1:
        if role in ("given", "middle"):
            return (INITIAL, 0) if typed[0] == word[0] else None
    if word in means:
        return SHORT, 0
    general = role in ("business", "plain")
    if general and size >= PREFIX_LEAST and word.startswith(typed) and (size > 4 or word in SHORT_FORMS):
        return SHORT, 0
    if not strange:
        return None
    if role == "given" and is_familiar(typed, word):
        return ABBREVIATED, 0
    if general and contracts(typed, word):
        return ABBREVIATED if word.startswith(typed) else CONTRACTED, 0
    if not near:
        return None
    for form, d in near.items():
        if d == 1 and len(form) > 3 and form in _MEANS and word in _MEANS[form]:
            return SHORT + d, d
    d = near.get(word)
    return None if d is None or d > min(2 if role == "plain" and len(word) == 6 else edits_allowed(word), size - 2) else (float(d), d)


def place(choices: list[list[tuple[float, int, int]]], left_out: list[float | None], n: int, used: int, cost: float, edits: int, extra: int, best: float | None) -> float | None:
    """The least cost of giving the n-th and further words one of their choices (cost, edits, slot or -1) each, no slot twice."""
    if edits > MOST_EDITS or extra > MOST_EXTRA or best is not None and cost >= best:
        return best
    if n == len(choices):
        for i, x in enumerate(left_out):
            if not used >> i & 1:
                if x is None:
                    return best
                cost += x
        return cost if best is None or cost < best else best
    for c, d, i in choices[n]:
        if i < 0:
            best = place(choices, left_out, n + 1, used, cost + c, edits + d, extra + 1, best)
        elif not used >> i & 1:
            best = place(choices, left_out, n + 1, used | 1 << i, cost + c, edits + d, extra, best)
    return best


#: A request to find the words within so many edits of a typed one.
Wanted = list[tuple[str, int]]
Hits = list[tuple[float, str]]


def radius(typed: str) -> int:
    """The edits looked for in a word at first; in short ones two only where no better reading is found."""
    return 0 if len(typed) < 3 else 1 if len(typed) < 6 else 2


class NameIndex:
    """A block of entities. Without a vocabulary the block is all there is."""

    def __init__(self, entities: Iterable[tuple[str, str | None, str, list[str] | None]], vocabulary: Iterable[tuple[str, bool]] | None = None) -> None:
        entities = list(entities)
        shared = Vocabulary(vocabulary if vocabulary is not None else (w for _, kind, name, _ in entities for w in vocabulary_of(name, kind)))
        self.known, self.words = shared.known, shared.words
        self.slots: list[tuple[str, str | None, list[tuple[str, str]]]] = []
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.initials: dict[str, set[tuple[str, str | None]]] = defaultdict(set)
        self.official: dict[str, set[tuple[str, str | None]]] = defaultdict(set)
        self.acronyms: dict[int, dict[str, tuple[str, ...]]] = {}
        self.near: dict[tuple[str, int], dict[str, int]] = {}
        mine: set[str] = set()
        self.most_slots = self.longest = 0
        for entity, kind, name, short in entities:
            slots = slots_of(name or "", kind)
            if not slots:
                continue
            k = len(self.slots)
            self.slots.append((entity, kind, slots))
            self.most_slots = max(self.most_slots, len(slots))
            for word, role in slots:
                mine.add(word)
                if role in ("core", "plain"):
                    self.by_word[word].add(k)
            if kind == "COMPANY":
                self.initials["".join(w[0] for w, r in slots)].add((entity, kind))
                self.initials["".join(w[0] for w, r in slots if r != "legal" or w not in ("ag", "plc", "sa"))].add((entity, kind))
            elif kind != "PERSON" and len(slots) > 1:
                self.initials["".join(w[0] for w, _ in slots)].add((entity, kind))
                self.initials["".join(w[0] for w in typed_words(name))].add((entity, kind))
                self.acronyms[k] = acronyms_of(typed_words(name))
            for a in (name, *(short or ())):
                self.official[" ".join(typed_words(a or ""))].add((entity, kind))
        self.longest = max(map(len, (*mine, *self.words, *_MEANS)), default=0)
        self.trie = Trie(mine | self.words | {f for f in _MEANS if len(f) > 3} | _NOISE)

    def look_up(self, wanted: Wanted) -> None:
        """Find the neighbours of typed words in the trie; nothing can be weighed as misspelt before."""
        for k in (1, 2):
            typed = [w for w, r in wanted if r == k and (w, k) not in self.near]
            for w, found in zip(typed, self.trie.join(typed, k), strict=True):
                self.near[w, k] = dict(found)

    def _loose(self, typed: str, word: str, role: str) -> tuple[float, int] | None:
        """Two edits in a short word, if no other word is as near."""
        if role in ("core", "plain") or typed in self.known or len(typed) < 3:
            return None
        near = {f: d for f, d in self.near.get((typed, 2), {}).items() if f in self.known and (f in self.words or f in _MEANS)}
        mine = [d for f, d in near.items() if len(f) > 3 and (f == word or word in _MEANS.get(f, ()))]
        others = [d for f, d in near.items() if f != word and word not in _MEANS.get(f, ())]
        return (LOOSE + min(mine), min(mine)) if mine and (not others or min(others) > min(mine)) else None

    def fit(self, typed: list[str], slots: list[tuple[str, str]], loosely: bool = False) -> float | None:
        """The least cost of matching every typed word to a slot of its own, in any order."""
        choices = []
        base, extra = 0.0, 0
        named = slots[0][1] != "plain"
        no_middle = slots[0][1] == "given" and all(role != "middle" for _, role in slots)
        for t in typed:
            row: list[tuple[float, int, int]] = []
            means, strange = _MEANS.get(t, _NOTHING), t not in self.known
            near = self.near.get((t, 2 if loosely else radius(t))) if strange else None
            for i, (w, role) in enumerate(slots):
                if t == w:
                    row.append((0.0, 0, i))
                elif (c := cost_of(t, w, role, means, strange, near)) or loosely and (c := self._loose(t, w, role)):
                    row.append((*c, i))
            free = WRONG_LEGAL if named and t in _LEGAL else EXTRA_INITIAL if no_middle and len(t) == 1 else None
            if row:
                if free is not None:
                    row.append((free, 0, -1))
                row.sort()
                choices.append(row)
            elif free is None:
                return None
            else:
                base += free
                extra += 1
        return place(choices, [OMITTED[role] for _, role in slots], 0, 0, base, 0, extra, None)

    def _candidates(self, typed: list[str], kind: str | None, loosely: bool = False) -> Iterator[tuple[float, str]]:
        """The entities that the words can mean, by all that has been looked up."""
        seen: set[int] = set()
        for t in typed:
            if t in self.by_word:
                seen |= self.by_word[t]
            for word in _MEANS.get(t, _NOTHING):
                seen |= self.by_word.get(word, _NOBODY)
            if t not in self.known and (near := self.near.get((t, radius(t)))):
                most = edits_allowed(t + "x")
                for word, d in near.items():
                    if d <= most and word in self.by_word:
                        seen |= self.by_word[word]
        for k in seen:
            entity, of, slots = self.slots[k]
            if kind is None or of is None or kind == of:
                cost = self.fit(typed, slots, loosely)
                for i, t in enumerate(typed) if k in self.acronyms else ():
                    run = self.acronyms[k].get(t)
                    whole = run and self.fit([*typed[:i], *run, *typed[i + 1 :]], slots, loosely)
                    if whole is not None and run and (cost is None or whole + ACRONYM < cost):
                        cost = whole + ACRONYM
                if cost is not None:
                    yield cost, entity

    def _otherwise(self, words: list[str], parted: set[tuple[str, str]]) -> Iterator[list[str]]:
        """A word taken as initials, two words as one, one word as the two of a known cut; the new ones first, as they fit least often."""
        for i, w in enumerate(words):
            if 1 < len(w) <= 3:
                yield [*w, *words[:i], *words[i + 1 :]]
        for i in range(len(words) - 1):
            if len(words[i]) > 1 and len(words[i + 1]) > 1:  # an initial is no part of the word beside it
                yield [words[i] + words[i + 1], *words[:i], *words[i + 2 :]]
        for i, w in enumerate(words):
            for a, b in self._cuts(w):
                if a in self.known or b in self.known or (a, b) in parted:
                    yield [a, b, *words[:i], *words[i + 1 :]]

    def _cuts(self, word: str) -> Iterator[tuple[str, str]]:
        """The ways to part a word of which no part is longer than any word that it could be."""
        if 6 < len(word) <= 2 * self.longest + 4:
            for cut in range(len(word) - 2, 2, -1):
                yield word[:cut], word[cut:]

    def _strange(self, words: Iterable[str]) -> Wanted:
        return [(w, radius(w)) for w in dict.fromkeys(words) if len(w) > 2 and w not in self.known and len(w) <= self.longest + 2]

    def find(self, name: str, kind: str | None) -> Hits:
        """(cost, entity), the cheapest first; at most two, of which the second only tells whether the first stands alone."""
        return self.find_all([(name, kind)])[0]

    def find_all(self, names: list[tuple[str, str | None]]) -> list[Hits]:
        """find() for many names: what they want looked up is looked up together."""
        if len(self.near) > 500_000:
            self.near.clear()
        collecting = gc.isenabled()
        gc.disable()  # thousands of searches are alive at once and none is part of a cycle
        try:
            return self._find_all(names)
        finally:
            if collecting:
                gc.enable()

    def _find_all(self, names: list[tuple[str, str | None]]) -> list[Hits]:
        out: list[Hits] = [[] for _ in names]
        searches = [(i, self._search(*n)) for i, n in enumerate(names)]
        while searches:
            wanted: dict[tuple[str, int], None] = {}
            going = []
            for i, search in searches:
                try:
                    wanted.update(dict.fromkeys(next(search)))
                    going.append((i, search))
                except StopIteration as end:
                    out[i] = end.value
            self.look_up(list(wanted))
            searches = going
        return out

    def _search(self, name: str, kind: str | None) -> Generator[Wanted, None, Hits]:
        """All readings of a name are weighed by cost; what must cost more than the best so far is left out, and nothing else."""
        words = typed_words(name)
        exact = {e for e, of in self.official.get(" ".join(words), ()) if kind is None or of is None or of == kind}
        if exact:
            return [(0.0, e) for e in sorted(exact)][:2]
        kept = [x for w in words for x in EXPANSIONS.get(w, (w,)) if x not in SILENT and x not in TITLES]
        best: dict[str, float] = {}

        def weigh(reading: list[str], more: float = 0.0, loosely: bool = False) -> None:
            for cost, entity in self._candidates(reading, kind, loosely):
                cost = round(cost + more, 6)
                if cost < best.get(entity, 1e9):
                    best[entity] = cost

        def done(least: float) -> bool:
            """What is still to come costs at least so much."""
            return bool(best) and min(best.values()) < least

        def result() -> Hits:
            return sorted((c, e) for e, c in best.items())[:2]

        if sum(len(x) for x in words) <= 5:
            letters = "".join(words)
            if 3 <= len(letters) and (len(words) == 1 or all(len(w) == 1 for w in words)):
                for e, of in self.initials.get(letters, ()):
                    if kind is None or of is None or kind == of:
                        best[e] = ALL_INITIALS[of == "COMPANY"]
        if len(kept) > self.most_slots + 1 + 2 * MOST_EXTRA:  # two may be one, others left over; each of the rest needs a slot of its own
            return result()
        weigh(kept)
        if done(OTHERWISE):
            return result()
        others = list(self._otherwise(kept, set()))
        for reading in others:
            weigh(reading, OTHERWISE)
        if done(EDIT):
            return result()
        yield self._strange(kept)
        weigh(kept)
        trimmed = [w for w in kept if w in self.known or not any(d < 2 and x in _NOISE for x, d in self.near.get((w, radius(w)), {}).items())]
        trimmed = trimmed if 0 < len(kept) - len(trimmed) <= MOST_EXTRA else []
        if trimmed:
            weigh(trimmed, NOISE)
        if done(OTHERWISE + EDIT):
            return result()
        every = [kept, trimmed] if trimmed else [kept]
        halves = {(b, 1) for w in {w for r in every for w in r} for a, b in self._cuts(w) if len(b) > 3 and a not in self.known and b not in self.known and len(b) <= self.longest + 1}
        yield list(halves)
        parted = {(a, b) for w in {w for r in every for w in r} for a, b in self._cuts(w) if (b, 1) in halves and any(x in self.words for x in self.near[b, 1])}
        readings = [(r, OTHERWISE + NOISE * (e is trimmed)) for e in every for r in self._otherwise(e, parted)]
        yield self._strange(w for r, _ in readings for w in r)
        for reading, more in readings:
            weigh(reading, more)
        if done(LOOSE + EDIT):
            return result()
        yield [(w, 2) for w in dict.fromkeys(kept) if 2 < len(w) <= self.longest + 2 and w not in self.known]
        for reading in every:
            weigh(reading, NOISE * (reading is trimmed), True)
        return result()


def acronyms_of(words: list[str]) -> dict[str, tuple[str, ...]]:
    """The initials of two to five words on end, with and without the silent ones, where they aren't all of the name."""
    out: dict[str, tuple[str, ...]] = {}
    for i in range(len(words)):
        for j in range(i + 2, min(i + 5, len(words)) + 1):
            run = tuple(w for w in words[i:j] if w not in SILENT)
            if len(run) > 1 and j - i < len(words):
                out["".join(w[0] for w in run)] = run
                out["".join(w[0] for w in words[i:j])] = run
    return out


def _emit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = {w for name, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in vocabulary_of(name, kind)}
        columns = list(zip(*words, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.utf8()), pa.array(columns[1], pa.bool_())], names=["word", "other"])


#: The last index built in this worker, with its key: the tasks of a block share it.
_BUILT: dict[str, NameIndex] = {}


def _matcher(packed: Broadcast, shared: Broadcast | None, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = NameIndex(packed.value, shared.value if shared else None)
        index = _BUILT[key]
        known: dict[tuple[str, str | None], Hits] = {}
        for batch in batches:
            ids, *names = (c.to_pylist() for c in batch.columns)
            names = list(zip(*names, strict=True))
            if len(known) > 500_000:
                known.clear()
            new = [n for n in dict.fromkeys(names) if n not in known]
            known.update(zip(new, index.find_all(new), strict=True))
            rows = []
            for i, name in zip(ids, names, strict=True):
                hits = known[name]
                if not shared:  # no other block can tell
                    hits = hits[:1] if len(hits) == 1 or hits[:1] and hits[0][0] < hits[1][0] else []
                rows.extend((i, e, c) for c, e in hits)
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.utf8()), pa.array(columns[2], pa.float64())], names=["alias_row", "entity", "cost"])

    return run


def by_name(rows: DataFrame, total: int, parts: int) -> DataFrame:
    """Rows (alias_row, name, ...) with equal names side by side, so that each is looked up once; names of more than one row in HOT are spread.

    There are fewer than HOT such names, so their list is bounded.
    """
    hot = [r.name for r in rows.groupBy("name").count().where(F.col("count") > max(total // HOT, 1000)).collect()]
    spread = F.when(F.col("name").isin(hot), F.pmod(F.xxhash64("alias_row"), F.lit(parts))) if hot else F.lit(0)
    return rows.repartition(parts, "name", spread)


def link_names(aliases: DataFrame, entities: DataFrame, alias_id: str = "alias_id", alias: str = "alias", alias_type: str = "entity_type", entity_id: str = "entity_id", entity_type: str = "entity_type", name: str = "canonical_name", short_names: str = "aliases", block: int = ENTITY_BLOCK) -> DataFrame:
    """(alias_id, entity_id, cost) of the names that mean exactly one entity; the others don't come out.

    A given type restricts the entities; a null one doesn't. Null and empty names and names without a letter or digit
    mean nobody. Names are read whole, however many words they have. A name that fits two entities equally well means none of them. alias_id
    is expected to be unique. Entities with a null or empty name are never meant.

    Entities are counted first and broadcast in blocks of at most `block`; the names pass each block in one narrow
    stage, and only with more than one block is the best of all blocks found by a shuffle of the few hits. The
    blocks share the distinct words of all entities, so what a word is taken for doesn't depend on its block.
    """
    known = entities.select(F.col(entity_id).alias("e"), F.col(entity_type).alias("t"), F.col(name).alias("n"), F.col(short_names).alias("s")).where("e IS NOT NULL AND n IS NOT NULL")
    blocks = max(1, -(-known.count() // block))
    context = aliases.sparkSession.sparkContext
    kind = aliases.schema[alias_id].dataType.simpleString()
    total = aliases.count()
    rows = aliases.select(aliases[alias_id].alias("alias_row"), aliases[alias].alias("name"), aliases[alias_type].alias("kind")).where("name IS NOT NULL")
    rows = by_name(rows, total, max(context.defaultParallelism, -(-total // ROWS_PER_TASK)))  # a file holds few bytes but much work
    hits = shared = None
    if blocks > 1:
        words = known.select("n", "t").mapInArrow(_emit_words, "word string, other boolean").groupBy("word").agg(F.max("other").alias("other"))
        shared = context.broadcast([(r.word, r.other) for r in words.collect()])
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("e"), F.lit(blocks)) == b) if blocks > 1 else known
        packed = context.broadcast([(r.e, r.t, r.n, list(r.s) if r.s is not None else None) for r in part.collect()])
        one = rows.mapInArrow(_matcher(packed, shared, uuid.uuid4().hex), f"alias_row {kind}, entity string, cost double")
        hits = one if hits is None else hits.unionByName(one)
    if blocks > 1:
        ranked = hits.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("alias_row").orderBy("cost", "entity"))).where("nth <= 2")
        best = ranked.groupBy("alias_row").agg(F.min(F.struct("cost", "entity")).alias("best"), F.min("cost").alias("low"), F.max("cost").alias("high"), F.count("*").alias("n"))
        return best.where("n = 1 OR low < high").select(F.col("alias_row").alias(alias_id), F.col("best.entity").alias(entity_id), F.col("best.cost").alias("cost"))
    return hits.select(F.col("alias_row").alias(alias_id), F.col("entity").alias(entity_id), "cost")
