"""Language-model scoring with a probabilistic suffix tree over words.

Vocabulary. Every word of the training texts is counted (all texts, all words). A word that occurs `few` times or more is a
symbol of its own, however many such words there are; other words fall into classes by their last bytes, and a word's
probability within its class is smoothed as a unigram is, with room for one unknown word.

Tree. Contexts are suffixes of up to `depth` symbols. A context is a candidate if it occurs `few` times or more, at any
scale; each level's counts cover all training texts. Of a context's next symbols, those seen `seen` times or more are told
apart and the others are taken together. A candidate stays if that distribution diverges from its suffix's: the evidence
(count times Kullback-Leibler divergence) must outweigh what describing it costs. Distributions are smoothed towards the
suffix's and add up to one. A text is scored symbol by symbol from the longest suffix that is a state.

Scale. Texts are split into words twice: to count them, and to write them down as symbols, small numbers for the frequent
ones; levels and scores read symbols. A level's tasks add up what they read and send runs of symbols to be counted in sorted
columns, packed, by a hash of the context; a run whose beginning or end is too rare isn't sent (it can't be frequent). A
state changes log P by a constant for the symbols it has not told apart, and by one more number for each that it has. So a
text's score is a sum over its runs of up to depth + 1 symbols, each with one value, in whatever order. Runs are named by a
64-bit hash, as words are, and counts, states and values are distributed tables. Tasks hold a head of words and of values,
and bit tables of bounded size that say which runs need looking up, one of states and one of what states tell apart, where
only a state's next symbols are asked for (a bit set by another run costs a lookup that finds nothing); what is outside the
heads is looked up by a join: words in rows, runs in packed parts by key. Scratch tables and shuffle files go as soon as nothing reads them.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.llm.common import few as broadcast_few
from tideline.llm.common import forget, materialize, rows_in, shuffles_dropped, words

#: The symbol that ends a text, as a word that no text has.
END = b" "
SEED = 20
MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))


class Numbers(dict):
    """Words numbered in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def hashes(tokens: list[bytes], classes: int) -> np.ndarray:
    """64-bit hashes of words; the low byte is the word's class, which is that of its last two bytes."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w, SEED) >> 8 << 8 | digest(w[-2:], SEED) % classes for w in tokens], dtype=np.uint64).view(np.int64)


def level_of(count: str) -> Column:
    """A count on a log scale, 16 levels for each doubling."""
    return F.floor(F.log2(count) * 16).cast("int")


def class_of(hashed: np.ndarray, classes: int) -> np.ndarray:
    return (hashed.view(np.uint64) & np.uint64(255)).astype(np.int64) % classes


@dataclass
class Bits:
    """A set of keys as bits, two for each: has() is true for all of the set and for few others. 32 MB at most."""

    size: int
    data: np.ndarray
    keys: int

    @classmethod
    def of(cls, table: DataFrame, each: int = 32) -> Bits:
        """Of the column `key`. each: bits of the table for each key, or up to twice as many."""
        n = table.count()
        size = 1 << min(max((each * n).bit_length(), 16), 28)
        places = F.array(*(F.shiftrightunsigned("key", k).bitwiseAND(F.lit(size - 1)) for k in (8, 36)))
        rows = table.select(F.explode(places).alias("b")).groupBy(F.shiftright("b", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
        data = np.zeros((size >> 15, 4096), np.uint8)
        for k, bits in zip(rows["k"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            data[k] = np.frombuffer(bits, np.uint8)
        return cls(size, data.reshape(-1), n)

    def __reduce__(self):
        """Compressed on the way to tasks, whose workers keep what was sent beside what they read from it."""
        return Bits._read, (self.size, zstandard.compress(self.data, 1), self.keys)

    @staticmethod
    def _read(size: int, data: bytes, keys: int) -> Bits:
        return Bits(size, np.frombuffer(zstandard.decompress(data), np.uint8), keys)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for k in (8, 36):
            at = (keys.view(np.uint64) >> np.uint64(k) & np.uint64(self.size - 1)).view(np.int64)
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def spread(keys):
    """Keys of runs, one to one, as Bits wants them: a single symbol's key is a small number, of which Bits would see the upper bits
    alone; so it is there again in both places where Bits looks, turned in one of them. Of an array or a column."""
    if isinstance(keys, Column):
        return reduce(Column.bitwiseXOR, [F.shiftleft(keys, k) for k in (8, 29, 45)], keys)
    return keys ^ keys << 8 ^ keys << 29 ^ keys << 45


def extended(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Keys of runs with one more symbol at their end."""
    x = (keys.view(np.uint64) * MIX[0] ^ symbols.view(np.uint64)) * MIX[1]
    x ^= x >> np.uint64(32)
    x *= MIX[2]
    x ^= x >> np.uint64(29)
    return x.view(np.int64)


def runs(symbols: np.ndarray, most: int) -> list[np.ndarray]:
    """For each place the keys of the 1, 2, .. `most` symbols that end there (meaningless where there are fewer). A single
    symbol's key is the symbol."""
    out = [symbols]
    for _ in range(1, most):
        key = np.zeros_like(symbols)
        key[1:] = extended(out[-1][:-1], symbols[1:])
        out.append(key)
    return out


def found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in a sorted table, and whether they are."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of values with each."""
    keys, at = np.unique(keys, return_inverse=True)
    return [keys, *(np.bincount(at, v, len(keys)) for v in values)]


@dataclass
class Lexicon:
    """Counts of words, and which of them are symbols. Codes: 0 ends a text, 1 to `classes` are classes; then the words of the head
    that are symbols, the most frequent first; other words that are symbols have their hash for a code, with bit 62 set."""

    classes: int
    n: int  # training tokens
    v: int  # distinct ones
    ends: int  # training texts
    own: Bits  # words that are symbols
    singles: int  # how many
    class_n: np.ndarray
    class_v: np.ndarray
    head_hash: np.ndarray  # sorted
    head_count: np.ndarray
    head_code: np.ndarray
    floor: int  # level of counts from which on words are in the head
    vocabulary: DataFrame | None  # h, c; h = 0 ends a text

    @property
    def symbols(self) -> int:
        return 1 + self.singles + self.classes

    @property
    def unit(self) -> float:
        return math.log10(self.n + 0.5 * self.symbols)

    def codes(self, hashed: np.ndarray) -> np.ndarray:
        at, hit = found(hashed, self.head_hash)
        big = (hashed.view(np.uint64) & np.uint64((1 << 63) - 1) | np.uint64(1 << 62)).view(np.int64)
        named = np.where(hit, self.head_code[at], big) if len(self.head_code) else big
        return np.where(hashed == 0, 0, np.where(self.own.has(hashed), named, 1 + class_of(hashed, self.classes)))

    def root(self) -> DataFrame:
        """key (a symbol), c, lp (its log10 probability)."""
        lex, rest = self.held(), pa.table({"key": np.arange(1 + self.classes), "c": np.append(self.ends, self.class_n)})

        def run(batches):
            for b in batches:
                code = lex.codes(b.column(0).to_numpy())
                mine = code > lex.classes
                yield pa.RecordBatch.from_arrays([pa.array(code[mine]), pa.array(b.column(1).to_numpy()[mine])], names=["key", "c"])

        named = self.vocabulary.where("h <> 0").select("h", "c").mapInArrow(run, "key long, c long")
        return named.unionByName(self.vocabulary.sparkSession.createDataFrame(rest)).withColumn("lp", F.log10(F.col("c") + 0.5) - self.unit)

    def held(self) -> Lexicon:
        """Without the table, for tasks."""
        return replace(self, vocabulary=None)


def head_floor(table: DataFrame, most: int) -> int:
    """The level of counts c from which on at most so many rows are left, by a histogram."""
    sizes = table.groupBy(level_of("c").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, floor = 0, 1 << 20
    for row in sorted(sizes, key=lambda r: -r["level"]):
        if held + row["n"] > most:
            break
        held, floor = held + row["n"], row["level"]
    return floor


def _numbered(batches, column: int, span: int, memory: Numbers):
    """(rows, word numbers, lengths) for runs of whole texts of about `span` words or more."""
    rows, parts, size = [], [], 0
    of = memory.__getitem__
    for whole in batches:
        for batch in rows_in(iter([whole])):
            for i, text in enumerate(batch.column(column).to_pylist()):
                tokens = words(text)
                rows.append((batch, i))
                parts.append(np.fromiter(map(of, tokens), np.int64, len(tokens)))
                size += len(tokens) + 1
                if size >= span:
                    yield rows, np.concatenate(parts), np.array([len(p) for p in parts])
                    rows, parts, size = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.array([len(p) for p in parts])


def count_words(texts: DataFrame, classes: int, most: int = 400_000) -> DataFrame:
    """h, c: how often each word occurs (h = 0: ends of texts). Tasks add up what they can hold before anything is shuffled."""

    def run(batches):
        memory, counts, texts = Numbers(), np.zeros(0, np.int64), 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(np.append(hashes(list(memory), classes), 0)), pa.array(np.append(counts, texts))], names=["h", "c"])

        for rows, numbers, _ in _numbered(batches, 0, 1 << 18, memory):
            got = np.bincount(numbers, minlength=len(memory))
            got[: len(counts)] += counts
            counts, texts = got, texts + len(rows)
            if len(memory) > most:
                yield made()
                memory.clear()
                counts, texts = np.zeros(0, np.int64), 0
        yield made()

    return texts.mapInArrow(run, "h long, c long").where("c > 0").groupBy("h").agg(F.sum("c").alias("c"))


def learn_words(texts: DataFrame, classes: int = 256, few: int = 32, singles: int | None = None, head: int = 1 << 18) -> Lexicon:
    """Counts the words of all rows of texts (one column)."""
    vocabulary = materialize(count_words(texts, classes), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    real = vocabulary.where("h <> 0")
    frequent = real.where(F.col("c") >= few) if singles is None else real.orderBy(F.desc("c"), "h").limit(singles)
    own = Bits.of(frequent.select(F.col("h").alias("key")))

    def mark(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.has(b.column(0).to_numpy()))], names=["h", "c", "own"])

    class_n, class_v, held = np.zeros(classes, np.int64), np.zeros(classes, np.int64), 0
    marked = real.mapInArrow(mark, "h long, c long, own boolean")
    for row in marked.groupBy("own", F.when(~F.col("own"), F.pmod(F.col("h").bitwiseAND(255), F.lit(classes))).alias("k")).agg(F.sum("c").alias("n"), F.count("c").alias("v")).collect():
        if row["own"]:
            held = row["v"]
        else:
            class_n[row["k"]], class_v[row["k"]] = row["n"], row["v"]
    ended = vocabulary.where("h = 0").select("c").first()
    floor = head_floor(real, head)
    top = real.where(level_of("c") >= floor).toArrow()
    h, c = top["h"].to_numpy(), top["c"].to_numpy()
    code = np.empty(len(h), np.int64)
    code[np.lexsort((h, -c))] = np.arange(1 + classes, 1 + classes + len(h))
    order = np.argsort(h)
    return Lexicon(classes, int(n), int(v), int(ended["c"]) if ended else 0, own, held, class_n, class_v, h[order], c[order], code[order], floor, vocabulary)


def coded(docs: DataFrame, lexicon: Lexicon, most: int = 400_000) -> DataFrame:
    """Of (t, k, learn): k, learn, row (a number of its own), n_tokens, n_known, base and own (sums of log10 for words held by tasks),
    symbols (codes, the end's included), rare and times (hashes of words that aren't held, and how often the text has them)."""
    lex = lexicon.held()
    unit, unit_own = math.log10(lex.n + 0.5 * (lex.v + 1)), lex.unit
    # What a word's log10 (count + 1/2) is lowered by: that of its class, then of the word within it.
    classed_by = np.log10(lex.class_n + 0.5 * (lex.class_v + 1)) - (np.log10(lex.class_n + 0.5) - unit_own)
    end_log = math.log10(lex.ends + 0.5)
    schema = StructType(docs.select("k", "learn").schema.fields + StructType.fromDDL("row long, n_tokens long, n_known long, base double, own double, symbols array<long>, rare array<long>, times array<int>").fields)

    def run(batches):
        memory, row, known = Numbers(), TaskContext.get().partitionId() << 36, 0
        hashed, code, count, logs, lowered = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float))
        for rows, numbers, lengths in _numbered(batches, 0, 1 << 17, memory):
            if len(memory) > known:
                h = hashes(list(itertools.islice(memory, known, None)), lex.classes)
                at, hit = found(h, lex.head_hash)
                c = np.where(hit, lex.head_count[at] if len(lex.head_count) else 0, -1)
                s = lex.codes(h)
                less = np.full(len(h), unit_own)
                of_class = s <= lex.classes
                less[of_class] = classed_by[s[of_class] - 1]
                # A rare word's count comes by the join, for both scores.
                fresh = (h, s, c, np.where(c < 0, 0.0, np.log10(np.maximum(c, 0) + 0.5)), less)
                hashed, code, count, logs, lowered = (np.concatenate(x) for x in zip((hashed, code, count, logs, lowered), fresh, strict=True))
                known = len(memory)
            m = len(rows)
            text_of = np.repeat(np.arange(m), lengths)
            plain, own = logs[numbers], logs[numbers] - lowered[numbers]
            sums = [np.bincount(text_of, w, m) for w in (count[numbers] > 0, plain - unit, own)]
            ends = np.cumsum(lengths + 1)
            symbols = np.zeros(int(ends[-1]), np.int64)
            symbols[np.arange(len(numbers)) + text_of] = code[numbers]
            rare = np.flatnonzero(count[numbers] < 0)
            which, times = np.unique(text_of[rare] << 32 | numbers[rare], return_counts=True)
            cut = np.searchsorted(which, np.arange(m + 1) << 32).astype(np.int32)
            cut = pa.array(cut)
            columns = [pa.concat_arrays([b.column(j).slice(i, 1) for b, i in rows]) for j in (1, 2)]
            columns += [pa.array(np.arange(row, row + m)), pa.array(lengths + 1), pa.array(sums[0].astype(np.int64) + (lex.ends > 0)), pa.array(sums[1] + (end_log - unit)), pa.array(sums[2] + (end_log - unit_own))]
            columns += [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(symbols)), pa.ListArray.from_arrays(cut, pa.array(hashed[which & 0xFFFFFFFF])), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32)))]
            row += m
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            if len(memory) > most:
                memory.clear()
                known, (hashed, code, count, logs, lowered) = 0, (x[:0] for x in (hashed, code, count, logs, lowered))

    # Room for a dictionary of all symbols that tasks hold: without one, symbols take 8 bytes before they are compressed.
    return materialize(docs.select("t", "k", "learn").mapInArrow(run, schema), "lm-symbols", **{"parquet.dictionary.page.size": 4 << 20})


def _laid(batches, column: int, span: int):
    """(batches, symbols in one array, each place's distance from its text's start, lengths) for about `span` symbols at a time."""
    held, size = [], 0
    for batch in rows_in(batches, 4 * span):
        held.append(batch)
        size += len(batch.column(column).flatten())
        if size >= span:
            yield _joined(held, column)
            held, size = [], 0
    if held:
        yield _joined(held, column)


def _joined(held: list[pa.RecordBatch], column: int):
    symbols = np.concatenate([b.column(column).flatten().to_numpy(zero_copy_only=False) for b in held])
    lengths = np.concatenate([np.asarray(pc.list_value_length(b.column(column))) for b in held]).astype(np.int64)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return held, symbols, place, lengths


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers by planes of bytes, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    """The n columns of packed bytes."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).reshape(-1).view(np.int64) for p in planes]


def count_level(table: DataFrame, length: int, seen: int, contexts: Bits | None, endings: Bits | None, parts: int) -> DataFrame:
    """ctx, suf, key, ends, c: how often a symbol follows a context of `length` symbols, where that is `seen` times or more. suf is the
    key of all but the first symbol. contexts, endings: runs of `length` symbols that are frequent enough, if not all are.
    Tasks send their sums in `parts` parts by the context; a part is counted by itself, so memory is bounded by its size."""

    def send(batches):
        for _, symbols, place, _ in _laid(batches, 0, 1 << 20):
            key = runs(symbols, length)[-1]
            at = np.flatnonzero(place >= length)
            if contexts is not None:
                at = at[contexts.has(key[at - 1])]
                at = at[endings.has(key[at])]
            if not len(at):
                continue
            whole = extended(key[at - 1], symbols[at])
            _, first, times = np.unique(whole, return_index=True, return_counts=True)
            at = at[first]
            columns = [symbols[at - k] for k in range(length, -1, -1)]
            part = ((key[at - 1].view(np.uint64) * MIX[2] >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((columns[1], columns[0], part))
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            columns = [c[order] for c in [*columns, times]]
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pack([c[cut[p] : cut[p + 1]] for c in columns]) for p in some], pa.binary())], names=["part", "data"])

    def counted(held):
        columns = [np.concatenate(c) for c in zip(*(unpack(x, length + 2) for x in held), strict=True)]
        ctx, suf = columns[0], columns[1]
        for c in columns[1:length]:
            ctx = extended(ctx, c)
        for c in columns[2 : length + 1]:
            suf = extended(suf, c)
        key = extended(ctx, columns[length])
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        c = np.bincount(at, columns[-1]).astype(np.int64)
        first, c = first[c >= seen], c[c >= seen]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ctx[first], suf[first], key[first], columns[length][first] == 0, c)], names=["ctx", "suf", "key", "ends", "c"])

    def receive(batches):
        held, now = [], None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield counted(held)
                    held = []
                held.append(data)
                now = part
        if held:
            yield counted(held)

    sent = table.select("symbols").mapInArrow(send, "part long, data binary").repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(receive, "ctx long, suf long, key long, ends boolean, c long")


def parts_for(table: DataFrame, lexicon: Lexicon) -> int:
    """In how many parts packed columns are sent, so that a part has some million tokens' at most."""
    return max(2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), lexicon.n >> 20)


def dealt(keys: np.ndarray, parts: int, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Numbers of parts by key, and packed for each: distances between its mixed keys in order, and columns in that order."""
    mixed = keys.view(np.uint64) * MIX[1]
    order = np.argsort(mixed)
    mixed = mixed[order]
    cut = np.searchsorted((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cut)).tolist()
    columns = [c[order] for c in columns]
    return some, [pack([np.diff(mixed[a:b], prepend=np.uint64(0)), *(c[a:b] for c in columns)]) for a, b in ((cut[k], cut[k + 1]) for k in some)]


def undealt(data: bytes, n: int) -> list[np.ndarray]:
    """Of a part: its mixed keys and n columns."""
    steps, *columns = unpack(data, n + 1)
    return [np.cumsum(steps.view(np.uint64)), *columns]


def looked_up(asks: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """row, own_logs: per row the sum of times * value. asks: (part, data) with rows and times by key as dealt() gives them. table: key,
    value. Both are sent packed; a part is looked up by itself, its sums go back packed by the task that numbered the rows."""

    def send(batches):
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if size and (batch is None or size >= 1 << 18):
                some, data = dealt(np.concatenate([b.column(0).to_numpy() for b in held]), parts, np.concatenate([b.column(1).to_numpy() for b in held]))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([False] * len(some)), pa.array(data, pa.binary())], names=["part", "asks", "data"])
                held, size = [], 0

    def receive(batches):
        now, held, known, value = None, [], None, None
        for batch in batches:
            rows, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part, asked, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, held, known = part, [], None
                if not asked:
                    held.append(undealt(data, 1))
                    continue
                if known is None:
                    known, value = summed(*(np.concatenate(c) for c in zip(*((k, v.view(float)) for k, v in held), strict=True))) if held else (np.zeros(0, np.uint64), np.zeros(0))
                key, row, times = undealt(data, 2)
                at, hit = found(key, known)
                rows.append(row[hit])
                sums.append(times[hit] * value[at[hit]])
            row, total = summed(np.concatenate(rows), np.concatenate(sums))
            cut = np.flatnonzero(np.diff(row >> 36, prepend=-1))
            data = [pack([np.diff(row[a:b], prepend=0), total[a:b]]) for a, b in itertools.pairwise([*cut.tolist(), len(row)])]
            yield pa.RecordBatch.from_arrays([pa.array(row[cut] >> 36), pa.array(data, pa.binary())], names=["task", "data"])

    def add(batches):
        now, held = None, []
        for task, data in itertools.chain((x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), [(None, b"")]):
            if task != now and held:
                row, total = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(total)], names=["row", "own_logs"])
                held = []
            now = task
            if data:
                steps, total = unpack(data, 2)
                held.append((np.cumsum(steps), total.view(float)))

    sent = table.select("key", "value").mapInArrow(send, "part long, asks boolean, data binary")
    sent = sent.unionByName(asks.select("part", F.lit(True).alias("asks"), "data")).repartition("part").sortWithinPartitions("part", "asks")
    back = sent.mapInArrow(receive, "task long, data binary").repartition("task").sortWithinPartitions("task")
    return back.mapInArrow(add, "row long, own_logs double")


@dataclass
class Tree:
    """The fitted model. `terms` (key, length, c, entry, back) has the runs of symbols that change log10 P: by `entry` that of
    their last symbol, in another row by `back` that of the symbol after them (null unless the run is a state). `scratch`: written
    tables that terms reads."""

    depth: int
    lexicon: Lexicon
    terms: DataFrame
    scratch: list[DataFrame]

    @cached_property
    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and log10 probabilities of all symbols, on the driver: for small models. So are the three that follow."""
        got = self.lexicon.root().orderBy("key").toArrow()
        return got["key"].to_numpy(), got["lp"].to_numpy()

    @property
    def root(self) -> np.ndarray:
        return self.names[1]

    @cached_property
    def states(self) -> list[np.ndarray]:
        """Keys of the states, by length - 1."""
        return [np.sort(self.terms.where((F.col("length") == k) & F.col("back").isNotNull()).select("key").toArrow()["key"].to_numpy()) for k in range(1, self.depth + 1)]

    def log10(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 P(symbol | longest suffix that is a state), for each place of texts that follow one another. Symbols are numbers
        (places in `names`); begins: place of each one's text start."""
        got = self.terms.fillna(0.0).toArrow()
        table, entry, back = summed(*(got[c].to_numpy() for c in ("key", "entry", "back")))
        out, place = self.root[symbols].copy(), np.arange(len(symbols)) - begins
        for length, key in enumerate(runs(self.names[0][symbols], self.depth + 1), 1):
            at, hit = found(key, table)
            hit &= place >= length - 1
            out[hit] += entry[at[hit]]
            on = np.flatnonzero(hit[:-1] & (place[1:] > 0))
            out[on + 1] += back[at[on]]
        return out


def grow(table: DataFrame, lexicon: Lexicon, depth: int = 3, few: int = 32, seen: int = 4, least: float = 0.0, pull: float = 64.0) -> Tree:
    """Learns states from the symbols of all rows of table. few, seen: as the module says, the same at any scale. least: for small
    models, contexts need that share of the tokens too. pull: how many tokens the suffix's distribution counts as."""
    least_count = max(least * lexicon.n, few, 2)
    parts = parts_for(table, lexicon)
    root = materialize(lexicon.root(), "lm-root")
    above, contexts, endings, terms, scratch = broadcast_few(root, 1 << 18), None, None, [], [root]
    c, total, p, kept, q = (F.col(x) for x in ("c", "total", "p", "kept", "q"))
    # Level by level: candidates come from the level above, counts from all texts, the test decides what stays.
    for length in range(1, depth + 1):
        level = materialize(count_level(table, length, seen, contexts, endings, parts), "lm-level")
        met = materialize(level.join(above.select(F.col("key").alias("suf"), F.col("lp").alias("p")), "suf").select("ctx", "key", "ends", "c", "p"), "lm-met")
        sums = met.groupBy("ctx").agg(F.sum("c").alias("kept"), F.sum(c * (F.ln("c") - p * math.log(10))).alias("e"), F.sum(F.pow(F.lit(10.0), p)).alias("q"), F.count(F.lit(1)).alias("kinds"))
        sums = sums.join(above.select(F.col("key").alias("ctx"), F.col("c").alias("total")), "ctx").where(total >= least_count)
        left, free = total - kept, F.greatest(1 - q, F.lit(1e-12))
        evidence = F.col("e") - kept * F.ln(total) + F.when(left > 0, left * (F.ln(left / total) - F.ln(free))).otherwise(0.0)
        back = F.when(1 - q > 1e-9, (left + pull * (1 - q)) / ((total + pull) * (1 - q))).otherwise(pull / (total + pull))
        states = materialize(sums.where(evidence > 0.5 * F.col("kinds") * F.ln(F.greatest(total, F.lit(2)))).select("ctx", "total", F.log10(back).alias("back")), "lm-states")
        terms.append(states.select(F.col("ctx").alias("key"), F.lit(length).alias("length"), F.col("total").alias("c"), F.lit(0.0).alias("entry"), "back"))
        smoothed = F.log10((c + pull * F.pow(F.lit(10.0), p)) / (total + pull))
        made = materialize(met.join(broadcast_few(states, 1 << 18), "ctx", "left").select("key", "ends", "c", "back", "p", F.coalesce(smoothed, p).alias("lp")), "lm-made")
        entry = made.where("back IS NOT NULL").select("key", F.lit(length + 1).alias("length"), "c", (F.col("lp") - p - F.col("back")).alias("entry"), F.lit(None).cast("double").alias("back"))
        terms.append(entry)
        forget(level, met)
        scratch += [states, made]
        above = made
        if length < depth:
            contexts, endings = Bits.of(made.where((c >= least_count) & ~F.col("ends")).select("key")), Bits.of(made.select("key"))
    return Tree(depth, lexicon, reduce(DataFrame.unionByName, terms), scratch)


def fit(texts: DataFrame, depth: int = 3, singles: int | None = None, classes: int = 256, few: int = 32, **how) -> Tree:
    """Learns from all rows of texts (one column). singles: for small models, only so many words are symbols. A training set without
    rows gives N = 0, V = 0, and even chances."""
    lexicon = learn_words(texts, classes, few, singles)
    table = coded(texts.select(F.col(texts.columns[0]).alias("t"), F.lit(0).alias("k"), F.lit(True).alias("learn")), lexicon)
    return grow(table, lexicon, depth, few, **how)


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", head: int = 1 << 18, term_head: int = 1 << 21, classes: int = 256, few: int = 32, **how) -> DataFrame:
    """Per row of docs: key, n_tokens, n_known, train_tokens, base_score, score; learns from rows where `learn` holds.

    A null or empty text is its end token alone. base_score: unigrams, each word's count plus a half over N + (V + 1) / 2.
    score: log10 probability of the whole text under the tree. Rows are scored one by one even if keys repeat or are null;
    an empty table gives no rows. head, term_head: words and runs that tasks hold, the most frequent; others are joined. Words
    count by a 56-bit hash: with 10**8 distinct words some tens share theirs and count together.
    """
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        lexicon = learn_words(docs.where(learn).select(F.col(text).alias("t")), classes, few, None, head)
        table = coded(docs.select(F.col(text).alias("t"), F.col(key).alias("k"), F.coalesce(learn, F.lit(False)).alias("learn")), lexicon)
        met = _rare_words(table, lexicon)
        tree = grow(table.where("learn"), lexicon, few=few, **how)
        terms = materialize(tree.terms.select("key", "c", (F.col("entry") + F.coalesce(F.col("back"), F.lit(0.0))).alias("value"), F.col("back").isNotNull().alias("state")), "lm-terms")
        forget(lexicon.vocabulary, *tree.scratch)
        scored, more = _scored(table, terms, tree.depth, term_head, parts_for(table, lexicon))
    rows = scored.join(met, "row", "left").join(more, "row", "left")
    plus = lambda a, *b: sum((F.coalesce(F.col(x), F.lit(0)) for x in b), F.col(a))
    return rows.select(
        F.col("k").alias(key), "n_tokens", plus("n_known", "more").alias("n_known"),
        F.lit(lexicon.n).cast("long").alias("train_tokens"), plus("base", "logs").alias("base_score"), plus("own", "logs", "own_logs").alias("score"),
    )


def _rare_words(table: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row, more, logs: of a text's words that tasks don't hold, how many are known and their sum of log10 (count + 1/2)."""
    words_left = lexicon.vocabulary.where((F.col("h") != 0) & (level_of("c") < lexicon.floor))
    logs = F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    rare = table.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("row", F.col("z.rare").alias("h"), F.col("z.times").alias("times"))
    met = rare.join(words_left, "h", "left").select("row", F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("more"), logs.alias("logs"))
    return materialize(met.groupBy("row").agg(F.sum("more").alias("more"), F.sum("logs").alias("logs")), "lm-rare")


def _scored(table: DataFrame, terms: DataFrame, depth: int, term_head: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """The rows of table with values that tasks hold added to `own`, and row, own_logs: sums of the values that are joined. Deletes
    table."""
    floor = head_floor(terms, term_head)
    top = terms.where(level_of("c") >= floor).select("key", "value").toArrow()
    head_key, head_value = summed(top["key"].to_numpy(), top["value"].to_numpy())
    tail_terms = terms.where(level_of("c") < floor)
    tail = tail_terms.count()
    # A run that isn't a state can only have a value if it is a state with one more symbol.
    stated, told = (Bits.of(terms.where(F.col("state") == s).select(spread(F.col("key")).alias("key")), 16) for s in (True, False))
    passed = ["k", "row", "n_tokens", "n_known", "base", "own"]

    def run(batches):
        for held, symbols, place, lengths in _laid(batches, len(passed), 1 << 18):
            m = len(lengths)
            text_of, own = np.repeat(np.arange(m), lengths), np.zeros(m)
            asked_text, asked_key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            before = np.zeros(len(symbols), bool)
            for length, key_at in enumerate(runs(symbols, depth + 1), 1):
                bit_key, may = spread(key_at), place >= length - 1
                states = may & (symbols != 0) & stated.has(bit_key) if length <= depth else np.zeros(len(symbols), bool)
                after = np.flatnonzero(np.append(False, before[:-1]) & may & ~states)
                chosen = states.copy()
                chosen[after] = told.has(bit_key[after])
                near, before = np.flatnonzero(chosen), states
                near = near[np.argsort(key_at[near])]  # lookups in order are quick
                at, hit = found(key_at[near], head_key)
                own += np.bincount(text_of[near[hit]], head_value[at[hit]], m)
                if tail:
                    asked_text.append(text_of[near[~hit]])
                    asked_key.append(key_at[near[~hit]])
            texts, what = np.concatenate(asked_text), np.concatenate(asked_key)
            order = np.lexsort((what, texts))
            texts, what = texts[order], what[order]
            fresh = np.flatnonzero(np.append(True, (np.diff(texts) != 0) | (np.diff(what) != 0))[: len(what)])
            times = np.diff(np.append(fresh, len(what)))
            columns = [pa.concat_arrays([b.column(j) for b in held]) for j in range(len(passed))]
            columns[-1] = pa.array(columns[-1].to_numpy() + own)
            some, data = dealt(what[fresh], parts, columns[1].to_numpy()[texts[fresh]], times)
            # All that these texts ask for stands in the first one's row.
            asked = pa.StructArray.from_arrays([pa.array(some, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.full(m, len(some))).astype(np.int32)), asked))
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, "asked"])

    schema = StructType(table.select(*passed).schema.fields + StructType.fromDDL("asked array<struct<part: long, data: binary>>").fields)
    scored = materialize(table.select(*passed, "symbols").mapInArrow(run, schema), "lm-scores")
    forget(table)
    asks = scored.select(F.explode("asked").alias("z")).select("z.part", "z.data")
    return scored.select(*passed), materialize(looked_up(asks, tail_terms, parts), "lm-passed")
