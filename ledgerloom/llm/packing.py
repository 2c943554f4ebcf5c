"""Best-fit packing by a configuration linear program over the length histogram, and the query op8.

The histogram has at most `capacity` lengths, whatever the corpus: it alone reaches the driver. The
covering program over packing patterns is solved by multiplicative weights over classes of `width`
tokens: each step prices the classes, finds the best pattern by a knapsack dynamic program and lowers
the prices of what the pattern covers. The fractional patterns are rounded and filled with exact
lengths by best fit; all sequences come from this. The result is a short list of (exact pattern,
repetitions), which turns into places by the pieces' ranks within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept_by, only, small_batches, stored, table
from .transducer import ODD_SPACES, SPACE_RUN, pretokens

CAPACITY, END_ID = 4096, 1
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Runs between white space whose ids a worker keeps, and rows of a length that are ranked in one group.
MEMO_RUNS, RANK_ROWS = 600_000, 20_000
#: Longer runs and pre-tokens are encoded each time. Ids that a worker keeps, of runs and of pre-tokens.
MEMO_CHARS, MEMO_IDS = 64, 8 * MEMO_RUNS
#: Characters of the texts that are encoded together (a longer text alone), and new pre-tokens that the library gets as one text.
GROUP_CHARS, JOINED_WORDS = 1 << 17, 1024

_memo: dict[str, Encoder] = {}
kept_by("packing", _memo.clear)


class Places(dict):
    """Numbers strings as they are met: `places[x]` is x's number, and an x without one joins `new`."""

    def __init__(self) -> None:
        self.met, self.new = 0, []

    def __missing__(self, x: str) -> int:
        n = self[x] = self.met
        self.met += 1
        self.new.append(x)
        return n

    def of(self, groups: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(groups)), np.int64, sum(map(len, groups)))


class IdStore:
    """The ids of each number, end to end in one array."""

    def __init__(self) -> None:
        self.ids, self.start, self.n = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), 0
        self.used = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """The next numbers' ids; ends are where each stops in ids."""
        self.ids = self._room(self.ids, self.used + len(ids))
        self.start = self._room(self.start, self.n + len(ends) + 1)
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n + 1 : self.n + 1 + len(ends)] = self.used + ends
        self.n += len(ends)
        self.used += len(ids)

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the numbers in turn, where each stops)."""
        start = self.start[numbers]
        size = self.start[numbers + 1] - start
        ends = np.cumsum(size)
        at = np.repeat(start - ends + size, size)
        at += np.arange(len(at))
        return self.ids[at], ends


def stops(ends: np.ndarray, counts: list[int]) -> np.ndarray:
    """Where each group stops, groups of counts[i] things that stop at ends."""
    return np.concatenate([[0], ends])[np.cumsum(np.asarray(counts, np.int64))]


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes.

    White space always ends a token of this vocabulary, and so does the end of a pre-token: each is
    encoded once by the library and kept, as is each run between white space. Both are numbered as they are met,
    so that a text is a list of numbers, whose ids are gathered at once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: np.asarray([i], "<u4") for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.mark = os.path.commonprefix([*self.special])
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        #: Which ids end a pre-token.
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for x, i in self.library.get_vocab(with_added_tokens=False).items() if x.endswith(suffix)]] = True
        self._forget_runs()
        self._forget_words()

    def _forget_runs(self) -> None:
        self.runs, self.run_ids = Places(), IdStore()

    def _forget_words(self) -> None:
        self.words, self.word_ids = Places(), IdStore()

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for t in texts:
            group.append(t)
            chars += len(t)
            if chars >= GROUP_CHARS:
                out += self._ids(group)
                group, chars = [], 0
        return out + self._ids(group)

    def _ids(self, texts: list[str]) -> list[bytes]:
        if self.runs.met > MEMO_RUNS or self.run_ids.used > MEMO_IDS:
            self._forget_runs()
        if self.words.met > MEMO_RUNS or self.word_ids.used > MEMO_IDS:
            self._forget_words()
        split = [[x for x in SPACE_RUN.split(t) if x] if ODD_SPACES.search(t) else t.split() for t in texts]
        numbers = self.runs.of(split)
        if new := self.runs.new:
            self.run_ids.add(*self._encoded(new))
            for x in new:
                if len(x) > MEMO_CHARS:
                    del self.runs[x]
            self.runs.new = []
        ids, ends = self.run_ids.take(numbers)
        data = ids.tobytes()
        at = [0, *(4 * stops(ends, [len(s) for s in split])).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _encoded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs in turn, where each stops)."""
        parts = [[] if self.mark in x else pretokens(x) for x in runs]
        numbers = self.words.of(parts)
        new, self.words.new = self.words.new, []
        for i in range(0, len(new), JOINED_WORDS):
            self.word_ids.add(*self._words(new[i : i + JOINED_WORDS]))
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.words[w]
        ids, ends = self.word_ids.take(numbers)
        ends = stops(ends, [len(ws) for ws in parts])
        odd = {i: self._with_special(x) for i, x in enumerate(runs) if self.mark in x}
        if odd:
            each = np.split(ids, ends[:-1])
            each = [odd.get(i, own) for i, own in enumerate(each)]
            ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
        return ids, ends

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pre-tokens, encoded as one text: a pre-token's last id is one that ends it."""
        ids = np.asarray(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            return ids, ends
        each = [np.asarray(e.ids, "<u4") for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(each), np.cumsum([len(e) for e in each])

    def _with_special(self, run: str) -> np.ndarray:
        """Special strings are taken out before anything else."""
        return np.concatenate([self.special[p] if p in self.special else np.asarray(self.library.encode(p, add_special_tokens=False).ids, "<u4") for p in self.special_re.split(run) if p])


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _memo:
        _memo[path] = Encoder(path)
    return _memo[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut only if longer than capacity.

    A null text is empty: one piece, the end_id alone. Repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing")
        ids = encoder(vocabulary).ids
        for b in batches:
            rows: list[tuple] = []
            for k, data in enumerate(ids(b.column(1).to_pylist())):
                data += last
                for i in range(0, len(data), 4 * capacity):
                    part = data[i : i + 4 * capacity]
                    rows.append((k, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
            k, piece, start, length, crc = (np.array(x) for x in zip(*rows)) if rows else [np.zeros(0, int)] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(price: np.ndarray, size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to `room` the highest price of a multiset of classes (sizes ascending), and the class taken last (-1: none): dynamic programming."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(size, np.arange(room + 1), "right")
    for c in range(int(size[0]), room + 1):
        gain = best[c - size[: fits[c]]] + price[: fits[c]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    return best, pick


def pattern_of(pick: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """How often each class is in the knapsack's choice for `room`."""
    out = np.zeros(len(size), np.int64)
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            out[pick[room]] += 1
            room -= int(size[pick[room]])
    return out


#: A pattern (indices of classes, ascending, with repetition) and how often it is used.
Patterns = dict[tuple[int, ...], float]


def configuration_program(size: np.ndarray, demand: np.ndarray, room: int, gap: float = 0.02, least_part: float = 1 / 500) -> tuple[float, float, Patterns]:
    """(patterns in all, a lower bound of the program, use of each pattern): a fractional cover of demand[k] pieces of size[k].

    Multiplicative weights: a class's price is its size, times exp(-10 * how far its cover is ahead of the mean). Each
    step takes the pattern of the highest price and uses it until the first of its classes has `part` of its demand
    more. Prices bound the program from below: their sum over the demand by the best pattern's price, for each
    step and for their mean. The part is halved until cover and bound are within `gap`. Where the bound is not tight
    enough for that, the search ends at `least_part`; the caller sees both values.
    """
    area = float((size * demand).sum())
    bound, part, found = area / room, 0.1, (np.inf, {})
    while True:
        cover, used, mean = np.zeros(len(size)), {}, np.zeros(len(size))
        total = 0.0
        while cover.min() < 1 - 1e-9:
            ahead = cover - (cover * size * demand).sum() / area
            price = size / room * np.exp(np.clip(-10 * ahead, -30, 30))
            price[cover >= 1] *= 1e-3
            best, pick = knapsack(price, size, room)
            bound = max(bound, float((demand * price).sum() / best[room]))
            n = pattern_of(pick, size, room)
            on = n > 0
            step = part * float((demand[on] / n[on]).min())
            cover[on] += step * n[on] / demand[on]
            mean += step / best[room] * price
            key = tuple(np.repeat(np.arange(len(size)), n).tolist())
            used[key] = used.get(key, 0.0) + step
            total += step
        bound = max(bound, float((demand * mean).sum() / knapsack(mean, size, room)[0][room]))
        if total < found[0]:
            found = (total, used)
        if found[0] <= (1 + gap) * bound or part <= least_part:
            return found[0], bound, found[1]
        part /= 2


class Shelf:
    """Pieces left of each length; gives the largest length that fits."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.sizes = sorted(self.left)

    def fit(self, room: int, taken: dict[int, int]) -> int:
        i = bisect_right(self.sizes, room) - 1
        while i >= 0 and self.left[self.sizes[i]] <= taken.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def fill(self, taken: dict[int, int], room: int) -> None:
        while room > 0 and (n := self.fit(room, taken)):
            k = min(room // n, self.left[n] - taken.get(n, 0))
            taken[n] = taken.get(n, 0) + k
            room -= k * n

    def take(self, taken: dict[int, int], most: int) -> int:
        times = min([most, *(self.left[n] // k for n, k in taken.items())])
        for n, k in taken.items():
            self.left[n] -= k * times
            if not self.left[n]:
                del self.left[n]
                self.sizes.remove(n)
        return times


def classes_of(counts: dict[int, int], width: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes (in units of width, rounded up but at most room, ascending) and pieces of each."""
    demand: dict[int, int] = {}
    for n, c in counts.items():
        k = min(room, -(-n // width))
        demand[k] = demand.get(k, 0) + c
    return np.array(sorted(demand), np.int64), np.array([demand[k] for k in sorted(demand)], float)


def packed(counts: dict[int, int], capacity: int = CAPACITY, width: int = 32) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, such sequences): every piece is in one, none is over capacity.

    The program's patterns, those with the largest pieces first, are rounded by carrying fractions on. Each slot but a
    pattern's last gets the largest piece of its class, the last one the largest that fits the room left (best fit), and
    so does what room remains. Pieces that rounding leaves over are packed by best fit.
    """
    if not counts:
        return []
    room = max(1, capacity // width)
    size, demand = classes_of(counts, width, room)
    _, _, used = configuration_program(size, demand, room)
    shelf, found, carried = Shelf(counts), [], 0.0
    for p, x in sorted(used.items(), key=lambda y: (-y[0][-1], -y[1], y[0])):
        carried += x
        quota = int(carried + 0.5)
        carried -= quota
        while quota > 0 and shelf.sizes:
            taken: dict[int, int] = {}
            free = capacity
            for i, k in enumerate(reversed(p)):
                n = shelf.fit(free if i + 1 == len(p) else min(int(size[k]) * width, free), taken)
                if n > (size[k] - 1) * width:
                    taken[n] = taken.get(n, 0) + 1
                    free -= n
            shelf.fill(taken, free)
            if not taken:
                break
            quota -= (t := shelf.take(taken, quota))
            found.append((taken, t))
    while shelf.sizes:
        taken = {shelf.sizes[-1]: 1}
        shelf.fill(taken, capacity - shelf.sizes[-1])
        found.append((taken, shelf.take(taken, sum(counts.values()))))
    return found


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length, ...; length from 1 to capacity) with sequence_id and offset. An empty table gives an empty one.

    Equal rows get places of their own. Which of the pieces of one length takes which place is decided
    by (doc_id, piece).
    """
    spark = parts.sparkSession
    by_length = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in by_length.collect()}  # at most `capacity` rows
    total = sum(counts.values())
    starts, lengths, ranks, bases, copies, offsets = [], [], dict.fromkeys(counts, 0), [], [], []
    first = 0
    for taken, times in packed(counts, capacity):
        at = 0
        for n, k in sorted(taken.items(), reverse=True):
            starts.append(ranks[n])
            lengths.append(n)
            bases.append(first)
            copies.append(k)
            offsets.append(at)
            ranks[n] += k * times
            at += k * n
        first += times
    order = np.lexsort((starts, lengths)) if starts else np.zeros(0, int)
    length_at, start_at, base_at, copies_at, offset_at = (np.array(x, np.int64)[order] for x in (lengths, starts, bases, copies, offsets))
    # Ranks within a length, a third of all rows perhaps: salted groups first, then the groups' offsets.
    salts = max(1, min(1 << 20, total // RANK_ROWS * 4))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))).join(groups, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(length_at * (1 << 44) + start_at, n * (1 << 44) + r, "right") - 1
        q = r - start_at[i]
        return pd.DataFrame({"sequence_id": base_at[i] + q // copies_at[i], "offset": offset_at[i] + q % copies_at[i] * n})

    return ranked.withColumn("_p", place("length", (F.col("_before") + F.col("_own") - 1).cast("long"))).select(*parts.columns, "_p.sequence_id", "_p.offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stored(pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
