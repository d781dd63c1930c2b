"""Evaluation texts that leak into training text: rare n-gram seeds, joined, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporlake.llm.words import raw_tokens, token_words
from sporlake.session import cut, parallelism, spread

MATCH, MISMATCH, GAP = 2, 1, 1
#: A passage is a stretch of an item of at least that many words, of which so many and that share are found again.
PASSAGE, FOUND, SHARE = 12, 10, 0.75
#: Stretches of an item up to that length are looked at one by one; of a longer passage, such a stretch is one too.
STRETCH = 32
#: Least score of a stretch, each word added in the text counted: three words may be missing and three more be added for ten found.
SCORE = 11
#: Of the word pairs in each twelve words of an item, so many of the rarest are seeds: three edits leave one of them.
SEEDS = 7
#: Word pairs of items, rare or not, that stand in so many words of a text around a passage: six interruptions leave them.
DENSE, SPAN = 3, 20
#: Words of a text on each side of a seed in which its passage ends.
REACH = 48
#: Most word pairs of items that are sent to the tasks as a filter (12 bytes each); with more, whole texts meet the seeds in the join.
FILTER = 4_000_000
#: Most words of items that are sent to every task instead of being joined by a shuffle (8 bytes each).
SENT = 2_000_000
#: Words of texts that are looked at together.
TOGETHER = 500_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_IDS: dict[str, tuple[int, ...]] = {}


def word_ids(text: str) -> list[int]:
    """Hashes of the folded words of a text."""
    out: list[int] = []
    for raw in raw_tokens(text):
        ids = _IDS.get(raw)
        if ids is None:
            if len(_IDS) >= 400_000:
                _IDS.clear()
            ids = _IDS[raw] = tuple(xxhash.xxh64_intdigest(w) - 2**63 for w in token_words(raw))
        out += ids
    return out


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of each two neighbouring words."""
    w = words.view(np.uint64)
    return ((w[:-1] * _P) ^ ((w[1:] >> np.uint64(7)) * _Q)).view(np.int64)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of an item a with words b: first and last word of a plus one, words found."""
    return _aligned(a, b)[1:]


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """The score of the best local alignment, and what smith_waterman() gives."""
    ramp = GAP * np.arange(1, len(b) + 1, dtype=np.int32)
    step = np.where(b[None, :] == a[:, None], np.int32(MATCH), np.int32(-MISMATCH))
    h = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        row = h[i + 1, 1:]
        np.add(h[i, :-1], step[i], out=row)
        np.maximum(row, h[i, 1:] - GAP, out=row)
        np.maximum(row, 0, out=row)
        # Gaps along the text: the best of all earlier places less their distance.
        row += ramp
        np.maximum.accumulate(row, out=row)
        row -= ramp
    i, j = np.unravel_index(h.argmax(), h.shape)
    score, end, found = int(h[i, j]), int(i), 0
    while h[i, j] > 0:
        same = i > 0 and j > 0 and a[i - 1] == b[j - 1]
        if i > 0 and j > 0 and h[i, j] == h[i - 1, j - 1] + (MATCH if same else -MISMATCH):
            found += same
            i, j = i - 1, j - 1
        elif i > 0 and h[i, j] == h[i - 1, j] - GAP:
            i -= 1
        else:
            j -= 1
    return score, int(i), end, found


def holds(span: int, found: int) -> bool:
    return span >= PASSAGE and found >= FOUND and found >= SHARE * span


#: Words that may be missing of a stretch of so many words.
_MISSING = [min(n - FOUND, int(n * (1 - SHARE))) if n >= PASSAGE else int(STRETCH * (1 - SHARE)) for n in range(STRETCH + 1)]


def passage(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(words found, words, first and last word of b plus one) of a stretch of an item a that is a passage in words b,
    whatever else of a is in b; zeros if none is.

    Of all ways to find a stretch's words in order, with its length and the words missing so far, the one that begins last
    in b is kept: it takes the fewest words of b. A stretch counts if its best alignment by itself holds, without the ends
    that gain nothing: one word more by chance doesn't lengthen it.
    """
    at = np.flatnonzero(np.isin(b, a))  # places of b that can matter
    best, most = (0, 0, 0, 0), _MISSING[0]
    # latest[n - 1, k, j]: stretches of n words that end at the current word of a, k of them missing, found by at[:j + 1].
    latest = np.full((STRETCH, most + 1, len(at)), -1, np.int64)
    n, k = np.arange(1, STRETCH + 1)[:, None, None], np.arange(most + 1)[None, :, None]
    may = (n >= PASSAGE) & (k <= np.array(_MISSING[1:])[:, None, None])
    places = {}
    for j, x in enumerate(b[at].tolist()):
        places.setdefault(x, []).append(j)
    for i, x in enumerate(a.tolist()):
        now = np.full_like(latest, -1)
        now[1:, 1:] = latest[:-1, :-1]
        if x in places:
            same = np.array(places[x])
            ends = np.full((STRETCH, most + 1, len(same)), -1, np.int64)
            later = same > 0
            ends[1:, :, later] = latest[:-1, :, same[later] - 1]
            ends[0, 0] = at[same]
            score = (MATCH + GAP) * (n - k) - max(MISMATCH, GAP) * k - GAP * (at[same] - ends + 1)
            for m, g, j in np.argwhere(may & (ends >= 0) & (score >= SCORE) & (n - k >= max(best[0], FOUND))):
                if (m + 1 - g, m + 1) > best[:2]:
                    start, end, found = smith_waterman(a[i - m : i + 1], b[(lo := int(ends[m, g, j])) : (hi := int(at[same[j]]) + 1)])
                    if holds(end - start, found):
                        best = max(best, (found, end - start, lo, hi))
            hit = np.full_like(latest, -1)
            hit[:, :, same] = ends
            now = np.maximum(now, np.maximum.accumulate(hit, axis=2))
        latest = now
    return best


def dense(mask: np.ndarray) -> bool:
    """Whether a stretch of an item can be a passage if only the words in the mask are in the text, in whatever order."""
    c = np.concatenate(([0], np.cumsum(mask)))
    return any((c[n:] - c[:-n]).max() >= max(FOUND, SHARE * n) for n in range(PASSAGE, min(STRETCH, len(mask)) + 1))


def _may_leak(text: np.ndarray, items: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """The items of which a stretch can be a passage by the words that the text has; all items are looked at in one go."""
    sizes = np.array([len(a) for _, a in items])
    flat, ends = np.concatenate([a for _, a in items]), np.cumsum(sizes)
    have = np.unique(text)
    mask = have[np.minimum(np.searchsorted(have, flat), len(have) - 1)] == flat
    c = np.concatenate(([0], np.cumsum(mask)))
    of = np.repeat(np.arange(len(items)), sizes)

    def having(n: int, least: int) -> np.ndarray:
        """Items with so many words of some n in a row."""
        at = np.flatnonzero(c[n:] - c[:-n] >= least)
        return np.unique(of[at[at + n <= ends[of[at]]]])

    # Three quarters of any stretch, and ten words, leave eight of some twelve words in a row and ten of some sixteen.
    near = np.intersect1d(having(PASSAGE, 8), np.union1d(having(16, FOUND), np.flatnonzero(sizes < 16)))
    for k in near.tolist():
        if dense(mask[ends[k] - sizes[k] : ends[k]]):
            yield items[k]


def leaks(text: np.ndarray, items: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(item, words of the passage, words found) of the items of which the words of a text hold a passage."""
    hits = {}
    for i, item in _may_leak(text, items):
        best, parts = (0, 0), []
        # A passage spans at most twice the item's words; long texts are aligned in windows that overlap by that.
        size = 10 * len(item)
        for at in range(0, max(len(text) - 2 * len(item), 1), size - 2 * len(item)):
            window = text[at : at + size]
            if np.isin(window, item).sum() >= FOUND:
                score, start, end, found = _aligned(item, window)
                # A long weak alignment beside or instead of a passage doesn't hide it.
                if holds(end - start, found):
                    best = max(best, (found, end - start))
                elif score >= SCORE:
                    found, span, first, last = passage(item, window)
                    if found:
                        parts.append((found, span, window[first:last]))
        hits[i] = item, best, parts
    whole = [(i, item) for i, (item, best, _) in hits.items() if best[0]]
    out = []
    for i, (_, best, parts) in hits.items():
        for found, span, part in parts:
            # Items are alike: where another one has more of the very same words, those that differ aren't swapped but its own.
            if (found, span) > best and not any(o != i and smith_waterman(other, part)[2] > found for o, other in whole):
                best = found, span
        if best[0]:
            out.append((i, best[1], best[0]))
    return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with the hash of their words: equal items are one class."""
    for batch in batches:
        ids, cls, words = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = word_ids(t)
            if len(w) >= PASSAGE:
                ids.append(i)
                cls.append(xxhash.xxh64_intdigest(np.array(w, np.int64).tobytes()) - 2**63)
                words.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(cls, pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["item", "cls", "words"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, at, seeds = [], [], []
        for c, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = pairs_of(np.array(w, np.int64)).tolist()
            cls += [c] * len(p)
            at += range(len(p))
            seeds += p
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(at, pa.int32()), pa.array(seeds, pa.int64())], ["cls", "at", "seed"])


def rarest(counts: list[int]) -> list[int]:
    """Places of the word pairs that are seeds, by how many items have each: of each eleven in a row the SEEDS rarest."""
    n, keep = PASSAGE - 1, set()
    for k in range(max(1, len(counts) - n + 1)):
        keep.update(sorted(range(k, min(k + n, len(counts))), key=lambda i: (counts[i], i))[:SEEDS])
    return sorted(keep)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, seeds = [], []
        for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k = {s[i]["seed"] for i in rarest([x["n"] for x in s])}
            cls += [c] * len(k)
            seeds += k
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(seeds, pa.int64())], ["cls", "seed"])


class _Filter:
    """Sorted word pairs of the items and whether each is a seed, behind a bitmap."""

    def __init__(self, pairs: np.ndarray, seed: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.seed = pairs[order], seed[order]
        self.bits = max(16, int(len(pairs)).bit_length() + 4)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._low(self.pairs)] = True

    def _low(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that items have, and which of them are seeds."""
        at = np.flatnonzero(self.map[self._low(h)])
        if not len(at) or not len(self.pairs):
            return at[:0], np.zeros(0, bool)
        k = np.minimum(np.searchsorted(self.pairs, h[at]), len(self.pairs) - 1)
        hit = self.pairs[k] == h[at]
        return at[hit], self.seed[k[hit]]


def _windows(sent):
    """Stretches of each text around seeds: the words' hashes and the seeds in them."""

    def of(ids, texts, f):
        d, words, seeds = [], [], []
        flat = np.array([x for t in texts for x in t], np.int64)
        ends = np.cumsum([len(t) for t in texts])
        h = pairs_of(flat) if len(flat) > 1 else np.empty(0, np.int64)
        if f is None:
            for i, lo, hi in zip(ids, ends - [len(t) for t in texts], ends, strict=True):
                if hi - lo >= FOUND:
                    d.append(i)
                    words.append(flat[lo:hi].tolist())
                    seeds.append(np.unique(h[lo : hi - 1]).tolist())
            return d, words, seeds
        at, seed = f.places(h)
        doc = np.searchsorted(ends, at, side="right")
        ok = doc == np.searchsorted(ends, at + 1, side="right")  # both words of one text
        at, seed, doc = at[ok], seed[ok], doc[ok]
        if len(at) < DENSE:
            return d, words, seeds
        # Pairs with enough others close by in their text.
        close = np.zeros(len(at), bool)
        j = np.flatnonzero((at[DENSE - 1 :] - at[: 1 - DENSE] <= SPAN) & (doc[DENSE - 1 :] == doc[: 1 - DENSE]))
        for k in range(DENSE):
            close[j + k] = True
        at, seed, doc = at[close], seed[close], doc[close]
        parts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) > 2 * REACH)) + 1 if len(at) else []
        for a, s, k in zip(np.split(at, parts), np.split(seed, parts), np.split(doc, parts), strict=True):
            if not s.any():
                continue
            lo = ends[k[0] - 1] if k[0] else 0
            d.append(ids[k[0]])
            words.append(flat[max(lo, a[0] - REACH) : min(ends[k[0]], a[-1] + 2 + REACH)].tolist())
            seeds.append(np.unique(h[a[s]]).tolist())
        return d, words, seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value if sent is not None else None
        for batch in batches:
            ids, texts, n = [], [], 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for k, (i, t) in enumerate(rows):
                w = word_ids(t)
                ids.append(i)
                texts.append(w)
                n += len(w)
                if n >= TOGETHER or k == len(rows) - 1:
                    d, words, seeds = of(ids, texts, f)
                    key = [xxhash.xxh64_intdigest(np.array(x, np.int64).tobytes()) - 2**63 for x in words]
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(key, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], ["d", "win", "words", "seeds"])
                    ids, texts, n = [], [], 0

    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window: each window with all its items."""
    out: list[tuple] = []
    key, text, items = None, None, []

    def finish() -> None:
        if items:
            out.extend((key[0], *x) for x in leaks(text, items))
            items.clear()

    for batch in batches:
        ids, wins, classes = (batch.column(k).to_numpy() for k in (0, 1, 3))
        words, item_words = batch.column(2), batch.column(4)
        text_values, text_at = words.values.to_numpy(), words.offsets.to_numpy()
        item_values, item_at = item_words.values.to_numpy(), item_words.offsets.to_numpy()
        for k, now in enumerate(zip(ids.tolist(), wins.tolist(), strict=True)):
            if now != key:
                finish()
                key, text = now, text_values[text_at[k] : text_at[k + 1]]
            items.append((int(classes[k]), item_values[item_at[k] : item_at[k + 1]]))
        if len(out) > 5000:
            yield _found(out)
            out.clear()
    finish()
    yield _found(out)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["d", "cls", "passage_words", "found_words"])


def leaked_items(docs: DataFrame, evals: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = FILTER, sent_words: int = SENT) -> DataFrame:
    """``id``, ``item``, passage_words, found_words: each document with the items of which it holds a passage.

    Letter case, punctuation, spacing, markup, line ends and the writing of characters don't count; words may be
    swapped, added or left out. A passage has at least twelve words of the item from its first to its last word found.
    Null and empty texts hold nothing, items without text or of fewer words are in nothing; equal items are found
    together, of repeated ids with different texts all texts count; repeated rows of either table give the pair once;
    the other columns aren't read.

    One pass over the documents for any number of items: their words are hashed, and stretches around seeds (word pairs
    that items have) leave with the seeds in them. These meet the items in an equi-join on the seed; each stretch is
    then aligned with its items. An item is never without seeds: of each twelve words the rarest pairs are kept,
    however common. The items' word pairs are sent to the tasks as a filter where there are at most ``most`` of them;
    with more, the join does the filtering.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    given = evals.select(F.col(item).alias("item"), F.col(item_text).alias("t")).where("t is not null and item is not null").distinct()
    kind = given.schema["item"].dataType.simpleString()
    items = cut(given.mapInArrow(_classes, f"item {kind}, cls long, words array<long>"))
    classes = items.groupBy("cls").agg(F.first("words").alias("words"))
    pairs = cut(classes.mapInArrow(_pairs, "cls long, at int, seed long"))
    counted = pairs.join(pairs.groupBy("seed").agg(F.countDistinct("cls").alias("n")), "seed")
    by_class = counted.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("at", "seed", "n"))).alias("s"))
    seeds = cut(by_class.mapInArrow(_kept, "cls long, seed long"))
    every = pairs.select("seed").distinct()
    sent = None
    if every.limit(most + 1).count() <= most:
        got = every.join(seeds.select("seed", F.lit(True).alias("kept")).distinct(), "seed", "left").select("seed", F.coalesce("kept", F.lit(False)).alias("kept")).toArrow()
        sent = spark.sparkContext.broadcast(_Filter(got["seed"].to_numpy(), got["kept"].to_numpy(zero_copy_only=False).astype(bool)))
    source = docs.select(F.col(id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    # Read twice below: for the join on seeds, and for the words of the stretches that met an item.
    windows = cut(spread(source).mapInArrow(_windows(sent), "d long, win long, words array<long>, seeds array<long>"))
    met = windows.select("d", "win", F.explode("seeds").alias("seed")).join(seeds, "seed").select("d", "win", "cls").distinct()
    size = classes.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).head()[0]
    texts = classes.withColumnRenamed("words", "item_words")
    both = met.join(F.broadcast(texts) if size <= sent_words else texts, "cls").join(windows.select("d", "win", "words").dropDuplicates(["d", "win"]), ["d", "win"])
    rows = both.select("d", "win", "words", "cls", "item_words").repartition(n, "d", "win").sortWithinPartitions("d", "win", "cls")
    found = rows.mapInArrow(_align, "d long, cls long, passage_words int, found_words int")
    out = found.join(items.select("cls", "item"), "cls")
    return out.groupBy("d", "item").agg(F.max("passage_words").alias("passage_words"), F.max("found_words").alias("found_words")).select(F.col("d").alias(id), F.col("item").alias(item), "passage_words", "found_words")
