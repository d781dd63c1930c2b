"""Abusive, hateful or sexual content: Levenshtein automata over a lexicon trie, scored in context windows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporlake.llm import lexicon as X
from sporlake.llm.words import LOOKALIKES, unescape
from sporlake.session import spread

#: Score from which a document is to be reviewed.
THRESHOLD = 1.0
#: Words between two words of a pattern, and around a term in which its context is looked for.
GAP, WINDOW = 7, 8
#: A quotation of so many words or more is what another said; shorter ones are scorn.
QUOTATION = 4
#: Written tokens whose reading a task remembers.
REMEMBERED = 400_000
#: Signs that hide one letter, and digits and signs that stand for letters.
_ANY = set("*#@&%!?~^€")
_LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "£": "l"}

_TOKEN = re.compile(r"[^\s.,;:()\[\]{}<>\"“”«»„/\\–—-]+")
_SPELLED = re.compile(r"[\"'(«“„]*([^\W\d_])([._*-])(?:[^\W\d_]\2)+([^\W\d_])[.,!?;:\"')»”]*")
_END = re.compile(r"(?:[.!?…]+[\"')»”]*|[;:])$")
_RUN = re.compile(r"(.)\1\1+")
_NORDIC = str.maketrans({"å": "a", "ä": "a", "æ": "a", "ø": "o", "ö": "o"})


def plain(text: str) -> str:
    """One spelling of letters: look-alikes Latin, marks such as strike-through off, Nordic letters as a and o."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(LOOKALIKES)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.casefold().translate(_NORDIC)


class Trie:
    """A lexicon; find() intersects it with the Levenshtein automaton of a word (transpositions count once)."""

    def __init__(self, words):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def find(self, letters: list[str], most: int) -> list[tuple[int, str]]:
        """(distance, word) of the words within ``most`` edits. letters: the choices at each place, '' for any.

        States of the automaton are (node, letters read, edits so far); only those that can still be reached are kept,
        so a token leaves the trie soon after its first letters do.
        """
        n, best = len(letters), {}
        stack = [(self.root, 0, 0)]
        seen = set()
        while stack:
            node, j, e = state = stack.pop()
            key = (id(node), j, e)
            if key in seen:
                continue
            seen.add(key)
            if j == n:
                if (w := node.get("")) is not None and e < best.get(w, most + 1):
                    best[w] = e
            else:
                x = letters[j]
                for c in x if x else node:
                    if c and (child := node.get(c)) is not None:
                        stack.append((child, j + 1, e))
            if e == most:
                continue
            node, j, e = state
            if j < n:
                stack.append((node, j + 1, e + 1))
                if j + 1 < n:
                    for c in letters[j + 1] or node:
                        if c and (child := node.get(c)) is not None:
                            for d in x if x else child:
                                if d and (grand := child.get(d)) is not None:
                                    stack.append((grand, j + 2, e + 1))
            for c, child in node.items():
                if c:
                    stack.append((child, j, e + 1))
                    if j < n:
                        stack.append((child, j + 1, e + 1))
        return [(e, w) for w, e in best.items()]


BIT = {name: 1 << k for k, name in enumerate(X.CLASSES)}


def _mask(names) -> int:
    return reduce(int.__or__, (BIT[n] for n in names), 0)


_LEXICON: dict[str, int] = {}
for _name, _words in X.CLASSES.items():
    for _w in _words.split():
        _LEXICON[plain(_w)] = _LEXICON.get(plain(_w), 0) | BIT[_name]
_HIDDEN = _mask(X.DISGUISED)
_TERMS = {w for w, m in _LEXICON.items() if m & _HIDDEN and len(w) > 2}
#: A plain word a letter away from a short term is mostly another word: only long terms are looked for with any error.
LONG = 7
_LONG = sorted(w for w in _TERMS if len(w) >= LONG)
_TRIE, _LONG_TRIE = Trie(_TERMS), Trie(_LONG)


def _letters(word: str) -> int:
    """The set of a word's letters as bits."""
    return reduce(int.__or__, (1 << (ord(c) & 63) for c in word), 0)


def _table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([_letters(w) for w in words], np.uint64), np.array([len(w) for w in words])


_SOME, _LONG_SOME = _table(sorted(_TERMS)), _table(_LONG)


def _may_be(letters: list[str], most: int, odd: bool) -> bool:
    """Whether a term has about the length and the letters of a token: each edit brings or takes one letter."""
    sets, sizes = _SOME if odd else _LONG_SOME
    m, wild = np.uint64(_letters("".join(letters))), letters.count("")
    near = np.flatnonzero(np.abs(sizes - len(letters)) <= most)
    ok = np.bitwise_count(sets[near] & ~m) <= most + wild
    if odd:
        return bool(ok.any())
    ok &= np.bitwise_count(m & ~sets[near]) <= most
    # An edit takes two pairs of neighbours away, two swapped letters three.
    pairs = _pairs("".join(letters))
    return any(len(_LONG_PAIRS[k] - pairs) <= 3 * most for k in near[ok].tolist())


def _pairs(word: str) -> frozenset[str]:
    return frozenset(map("".join, zip(word, word[1:])))


_LONG_PAIRS = [_pairs(w) for w in _LONG]


_ORDINARY = {plain(w) for w in X.ORDINARY}
_PATTERNS = [(points, [_mask(c.split("|")) for c in p.split()]) for points, p in X.PATTERNS]
_IDIOMS = [(points, [plain(w) for w in p.split()]) for points, p in X.IDIOMS]
_IDIOM_STARTS = {p[0] for _, p in _IDIOMS}
_TRIGGER = _mask(X.TRIGGERS)
_INSULT, _WEAK, _SLUR, _DEHUMAN, _STRONG, _EXPLICIT, _MILD, _PEOPLE, _THEM = (BIT[n] for n in "insult weak slur dehuman strong explicit mild people them".split())
_YOU, _ADDRESS, _BE, _ARTICLE, _NEUTRAL, _KIND, _VERDICT, _CURSE = (BIT[n] for n in "you address be article neutral kind verdict curse".split())
#: A work about someone so called isn't said of anyone.
_ABOUT = {"about", "om", "titled", "called"}
_ARE = {"are", "er", "ar", "is"}
_ELSE = {plain(w) for w in "there det these this vi we our my mine vår".split()}


class Word(NamedTuple):
    text: str
    mask: int
    #: The word of the lexicon that is written in disguise or with an error, else ''.
    meant: str
    meant_mask: int
    #: Capitalised, and not in capitals throughout.
    title: bool
    quote: int


def disguised(t: str) -> str:
    """The word of the lexicon that a token writes with signs, digits, doubled letters or errors; else ''."""
    if (twice := _RUN.sub(r"\1\1", t)) in _TERMS:
        return twice
    t = _RUN.sub(r"\1", t)
    if t in _LEXICON:
        return t if _LEXICON[t] & _HIDDEN else ""
    odd = any(c in _ANY or c in _LEET for c in t)
    n = len(t)
    if n < 3 or (n > 24 and not odd) or t in _ORDINARY or any(not (c.isalnum() or c in _ANY or c in _LEET) for c in t):
        return ""
    if sum(c.isdigit() for c in t) > n * 0.67:
        return ""
    if not odd:
        # The last letter twice, an article run into the word, or two letters swapped inside it are errors, not other words.
        if n > 4 and t[-1] == t[-2] and t[:-1] in _TERMS:
            return t[:-1]
        if n > 5 and t[0] == "a" and t[1:] in _TERMS:
            return t[1:]
        for i in range(1, n - 1):
            if (w := t[:i] + t[i + 1] + t[i] + t[i + 2 :]) in _TERMS:
                return w
        if n < LONG - 1:
            return ""
    letters = ["" if c in _ANY else _LEET.get(c, c) for c in t]
    wild = letters.count("")
    if wild > n // 2:
        return ""
    most = 0 if n < 4 else 1 if n < 9 else 2
    if not _may_be(letters, most, odd):
        return ""
    for d, w in sorted((_TRIE if odd else _LONG_TRIE).find(letters, most)):
        # The same word with another ending is none in disguise.
        if d + wild <= max(1, len(w) // 3) and (d == 0 or len(w) > 3) and (odd or not (w.startswith(t[:-1]) or t.startswith(w))):
            return w
    return ""


def _word(token: str, quote: int) -> Word:
    t = plain(token).strip("'’`´")
    bare = t.rstrip("!?").replace("'", "").replace("’", "")
    mask = _LEXICON.get(bare, 0)
    title = token[:1].isupper() and not (len(token) > 1 and token.isupper()) and token.isalpha()
    meant = ""
    if not mask and (any(c.isalpha() for c in bare) or (len(bare) > 3 and any(c in "$@" for c in bare))):
        meant = disguised(bare)
    return Word(bare, mask, meant, _LEXICON[meant] if meant else 0, title, quote)


#: Reading of a written token: its words, whether a sentence ends with it, whether it needs a look, whether it is one letter.
Reading = tuple[tuple[Word, ...], bool, bool, bool]


def _read(raw: str) -> Reading:
    s = raw
    if (m := _SPELLED.fullmatch(s)) is not None:
        s = s.replace(m[2], "")
    words = []
    for part in re.split(f"([{X.QUOTES}])", s):
        if part in X.QUOTES and part:
            words.append(Word("", 0, "", 0, False, 1))
        else:
            words += [_word(x, 0) for x in _TOKEN.findall(part)]
    hot = any((w.mask | w.meant_mask) & _TRIGGER or w.text in _IDIOM_STARTS for w in words)
    letter = len(words) == 1 and len(words[0].text) == 1 and words[0].text.isalpha()
    return tuple(words), bool(_END.search(raw)), hot, letter


_KNOWN: dict[str, Reading] = {}


def _reading(raw: str) -> Reading:
    r = _KNOWN.get(raw)
    if r is None:
        if len(_KNOWN) >= REMEMBERED:
            _KNOWN.clear()
        r = _KNOWN[raw] = _read(raw)
    return r


def _spelled(read: list[Reading], letters: list[bool]) -> bool:
    """Whether three one-letter tokens follow one another, the last perhaps with a sign."""
    return any(a and b and (c or len(r[0]) == 1 and len(r[0][0].text) == 1) for a, b, c, r in zip(letters, letters[1:], letters[2:], read[2:]))


def _joined(raws: list[str]) -> list[str]:
    """Words written letter by letter with spaces as one word."""
    out, k = [], 0
    while k < len(raws):
        j = k
        while j < len(raws) and len(raws[j]) == 1 and raws[j].isalpha():
            j += 1
        if j - k >= 2 and j < len(raws) and len(x := _TOKEN.findall(raws[j])) == 1 and len(x[0]) == 1 and x[0].isalpha():
            j += 1  # the last letter may be followed by a sign
        if j - k >= 3:
            out.append("".join(raws[k:j]))
        else:
            j = max(j, k + 1)
            out += raws[k:j]
        k = j
    return out


def _lines(text: str) -> list[str]:
    """Lines, single line ends inside a sentence joined."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, before = [], ""
    for line in text.split("\n"):
        s = line.strip()
        if out and before and s and (before[-1].islower() or before[-1] == ",") and s[0].islower():
            out[-1] += " " + s
        elif s:
            out.append(s)
        before = s
    return out


def sentences(text: str) -> Iterator[list[Word]]:
    """Words of the sentences of a text that hold a word to look at, and [] for each stretch of others."""
    for line in _lines(text) if "\n" in text or "\r" in text else (text,):
        raws = line.split()
        read = [_reading(r) for r in raws]
        letters = [r[3] for r in read]
        if letters.count(True) > 1 and _spelled(read, letters):
            read = [_reading(r) for r in _joined(raws)]
        if True not in [r[2] for r in read]:
            yield []
            continue
        now: list[Word] = []
        hot = False
        for words, end, h, _ in read:
            now += words
            hot |= h
            if end:
                yield now if hot else []
                now, hot = [], False
        if now:
            yield now if hot else []


def _of_verdict(masks: list[int], ws: list[str], i: int) -> bool:
    """Whether the words before i say that someone was punished for what follows."""
    lo = max(0, i - 2 * WINDOW)
    for k in range(i - 1, lo - 1, -1):
        if ws[k] == "for":
            return any(m & _VERDICT for m in masks[lo:k])
    return False


def _damped(masks: list[int], ws: list[str], i: int, said: bool) -> float:
    """What a term at i counts for: words of reports, rules and trades around it halve it, unless it is said of someone."""
    kind = i + 1 < len(ws) and masks[i + 1] & _KIND
    report = _of_verdict(masks, ws, i)
    if said and not report and not (kind and not any(m & _YOU for m in masks[max(0, i - 4) : i])):
        return 1.0
    return 0.5 ** (sum(1 for m in masks[max(0, i - WINDOW) : i + WINDOW + 1] if m & _NEUTRAL) + bool(kind) + report)


def _matches(steps: list[int], masks: list[int]) -> int:
    """Place of the first word of a pattern, -1 if it isn't there."""
    n = len(masks)
    for i in range(n):
        if masks[i] & steps[0]:
            at = i
            for step in steps[1:]:
                at = next((k for k in range(at + 1, min(n, at + 2 + GAP)) if masks[k] & step), -1)
                if at < 0:
                    break
            else:
                return i
    return -1


def sentence_score(words: list[Word]) -> float:
    """Score of one sentence: patterns of classes, insults said of someone, people called vermin, explicit words together.

    Words of reports, rules and trades near a term lower its score, but not that of patterns and of what is said to or
    of someone; what stands in a quotation of some words counts a quarter.
    """
    quoted, inside, start, ws_, at = set(), False, 0, [], 0
    for w in words:
        if w.quote:
            if inside and at - start >= QUOTATION:
                quoted.update(range(start, at))
            inside, start = not inside, at
        else:
            ws_.append(w)
            at += 1
    ws = [w.text for w in ws_]
    masks = [w.mask for w in ws_]
    near: dict[int, str] = {}
    for i, w in enumerate(ws_):
        if w.meant:
            # A capitalised word inside a sentence is a name, unless an article or a curse stands before it.
            if w.title and i and not (masks[i - 1] & (_ARTICLE | _STRONG | _YOU)):
                continue
            masks[i] = w.meant_mask
            near[i] = w.meant
    every = reduce(int.__or__, masks, 0)
    share = lambda i: 0.25 if i in quoted else 1.0
    score = 0.0
    if every & _TRIGGER or any(w in _IDIOM_STARTS for w in ws):
        meant = [near.get(i, w) for i, w in enumerate(ws)]
        for points, idiom in _IDIOMS:
            for i, w in enumerate(meant):
                if w == idiom[0] and meant[i : i + len(idiom)] == idiom and not _of_verdict(masks, ws, i):
                    score += points * share(i)
                    break
        for points, steps in _PATTERNS:
            if all(s & every for s in steps) and (i := _matches(steps, masks)) >= 0 and not _of_verdict(masks, ws, i):
                score += points * share(i)
    explicit, mild, terms = 0.0, 0.0, 0
    for i, m in enumerate(masks):
        if not m & (_INSULT | _WEAK | _SLUR | _DEHUMAN | _EXPLICIT):
            continue
        exact = i not in near
        word = near.get(i, ws[i])
        window = masks[max(0, i - WINDOW) : i]
        close = masks[max(0, i - 3) : i]
        scorn = any(x & _STRONG for x in masks[max(0, i - 2) : i])
        if m & (_INSULT | _SLUR) or m & _WEAK and scorn:
            article = any(x & (_ARTICLE | _YOU) for x in close) or scorn
            addressed = any(x & _ADDRESS for x in window)
            said = any(x & _YOU for x in masks[max(0, i - 4) : i]) or any(x & _ARTICLE for x in close) and any(x & _BE for x in masks[max(0, i - 4) : i])
            if _ABOUT & set(ws[max(0, i - 3) : i]):
                continue
            if m & _SLUR and exact:
                score += 1.0 * share(i) * _damped(masks, ws, i, said)
            elif (addressed or scorn and (i + 1 == len(ws) or any(x & (_YOU | _THEM | _PEOPLE) for x in masks))) and (article or exact and len(word) > 5) and (exact or article or len(word) > 6):
                score += share(i) * _damped(masks, ws, i, said)
        verb = next((k for k in range(i - 1, max(0, i - 3) - 1, -1) if ws[k] in _ARE), -1)
        # Animals that are called animals are no people.
        if m & _DEHUMAN and verb >= 0 and not (verb and masks[verb - 1] & _DEHUMAN and not masks[verb - 1] & _PEOPLE) and not _ELSE & set(ws[max(0, i - WINDOW) : i]) and not (m & _INSULT and any(x & _ARTICLE for x in close)):
            sure = exact or len(word) > 3 or scorn
            score += (1.0 if sure else 0.5) * share(i) * _damped(masks, ws, i, any(x & _YOU for x in close))
        if m & _EXPLICIT:
            terms += 1
            if m & _MILD:
                mild += share(i) * _damped(masks, ws, i, False)
            else:
                explicit += share(i) * _damped(masks, ws, i, False)
    return score + (0.6 * explicit + 0.4 * mild if terms > 1 else 0.5 * explicit)


def abuse_score(text: str | None) -> tuple[float, float, int]:
    """(score of the worst sentence or of two neighbours, sum over sentences, sentences at or over the threshold).

    Neighbours add up unless one has a quotation or words of reports, rules or trades.
    """
    if not text:
        return 0.0, 0.0, 0
    total, over, worst, before = 0.0, 0, 0.0, 0.0
    for words in sentences(unescape(text)):
        if not words:
            before = 0.0
            continue
        s = sentence_score(words)
        total += s
        over += s >= THRESHOLD
        plainly = s if s and not any(w.quote or w.mask & _NEUTRAL for w in words) else 0.0
        worst = max(worst, s, before + plainly)
        before = plainly
    return worst, total, over


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [abuse_score(t) for t in batch.column(1).to_pylist()]
        cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["id", "source", "score", "total", "sentences"])


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id``, ``source``, score, total, sentences of each row; one pass over whole texts.

    Null, empty and blank texts score 0. A document is to be reviewed if its worst sentence, or two neighbours, reach THRESHOLD.
    Repeated rows are scored each; null ids stay; columns other than the three aren't read. A task looks up each
    written token once: the automaton runs for distinct tokens, and only sentences with a word to look at are scored.
    """
    rows = spread(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"), F.col(source).alias("source")))
    out = rows.mapInArrow(_score, "id long, source string, score double, total double, sentences int")
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "score", "total", "sentences")


def to_review(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", **names: str) -> DataFrame:
    return scored(docs, id, **names).where(F.col("score") >= threshold).select(id).where(f"{id} is not null").distinct()


def rates(docs: DataFrame, threshold: float = THRESHOLD, source: str = "source", **names: str) -> DataFrame:
    """Documents, documents to review and their share per source; a null source is a source of its own."""
    hit = F.col("score") >= threshold
    return scored(docs, source=source, **names).groupBy(source).agg(F.count("*").alias("documents"), F.count_if(hit).alias("to_review"), F.round(F.avg(hit.cast("double")), 6).alias("rate"))
