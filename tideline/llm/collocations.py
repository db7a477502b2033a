r"""Phrase collocation mining with depth-limited count tries.

Phrases are runs of words inside a piece of text, counted for each language. Each task builds count tries of bounded size
(all windows of up to `longest` words, sorted, with their counts; a node's count is the sum over its windows) and
serialises them in order. Tries of all tasks are merged by prefix range: windows are dealt by ranges of their words, each
range is sorted, and one walk adds up equal prefixes; the few nodes that lie open at a range's borders are added up
afterwards. In the merged trie another walk gives each phrase the counts of its left parts (its ancestors), and suffix
links (a join with the phrase that lacks the first words) those of its right parts.

Scale. A phrase as frequent as `least` has only words and pairs as frequent; so windows end before a word or pair of which
all buckets are rarer. Those buckets are a bit table of bounded size, filled from packed counts of tries; where a corpus
fills it up, more windows are merged and results stay the same. Borders of ranges are whole windows, so a frequent first
word is spread over many ranges, and each task sends a window once however often it occurs. What follows the merge holds
frequent phrases only; there first words and suffixes with many phrases are spread over `SALTS` parts, the node they
share being copied to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import forget, materialize, rows_in, shuffles_dropped

#: Pieces end at these, words at blanks and tabs. Fixed values.
CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes.maketrans(CUTS + b"\x09", b"\n" * len(CUTS) + b" ")
#: Bits of the table of words and pairs, and how many parts it is built in.
BITS, PARTS = 1 << 27, 256
SALTS = 8
TRIE = "lang string, words binary, windows binary, counts binary, n long"


def slices(text: bytes, most: int) -> Iterator[bytes]:
    """A folded text in slices of about `most` bytes, cut before separators; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and text[end] not in b" \n":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class Trie:
    """Words of one language in the order of their texts, 0 for the end of a piece."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, folded: bytes) -> None:
        number = self.words.setdefault
        tokens = [w for w in folded.replace(b"\n", b" \n ").split(b" ") if w]
        self.parts.append(np.fromiter((number(w, len(self.words)) for w in tokens), np.uint32, len(tokens)))
        self.size += len(tokens)

    def last(self, count: int) -> bytes:
        """The last places, as text."""
        names = list(self.words)
        return b" ".join(names[i] for i in np.concatenate(self.parts)[-count:])

    def made(self, longest: int, held_back: int = 0) -> tuple[bytes, bytes, bytes, int]:
        """The words in order, the sorted windows (columns of word numbers from 1, 0 behind the end of a piece), their counts (all three
        compressed: they travel whole), the number of words. The last `held_back` places begin no window."""
        ids, self.parts = np.concatenate([*self.parts, np.zeros(longest - 1, np.uint32)]), []
        number, names = self.words, sorted(w for w, i in self.words.items() if i)
        rank = np.zeros(len(number), np.uint32)
        rank[np.fromiter(map(number.__getitem__, names), np.int64, len(names))] = np.arange(1, len(names) + 1)
        ids = rank[ids]
        n = len(ids) - (longest - 1) - held_back
        columns = windows(ids, n, longest)
        columns = [c[columns[0] > 0] for c in columns]
        columns, counts = added_up(columns, np.ones(len(columns[0]), np.int64))
        packed = [zstandard.compress(raw, 1) for raw in (b" ".join(names), np.stack(columns).astype("<u4").tobytes(), counts.astype("<i8").tobytes())]
        return *packed, int(counts.sum())


def windows(ids: np.ndarray, n: int, longest: int) -> list[np.ndarray]:
    out = [ids[:n]]
    for k in range(1, longest):
        out.append(np.where(out[-1] > 0, ids[k : n + k], np.uint32(0)))
    return out


def added_up(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows in order, and the sums of their counts."""
    if not len(counts):
        return columns, counts
    keys = [columns[i].astype(np.uint64) << np.uint64(32) | (columns[i + 1] if i + 1 < len(columns) else np.uint64(0)) for i in range(0, len(columns), 2)]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    return [c[order[start]] for c in columns], np.add.reduceat(counts[order], start)


def tries(docs: DataFrame, text: str, lang: str, longest: int, span: int = 3 << 18, slice_bytes: int = 4 << 20) -> DataFrame:
    """Serialised tries of about `span` words each, one language to each."""

    def run(batches):
        held: dict[str, Trie] = {}

        def flush(names):
            for name in names:
                row = (name, *held.pop(name).made(longest))
                if row[4]:
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["lang", "words", "windows", "counts", "n"])

        for whole in batches:
            for batch in rows_in(iter([whole])):
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not value:
                        continue
                    trie = held.setdefault(name, Trie())
                    for part in slices(value.encode("utf-8", "surrogatepass").lower().translate(FOLD), slice_bytes):
                        if trie.size > 2 * span:  # in the middle of a long text: its last words go on into the next trie
                            rest = trie.last(longest - 1)
                            row = (name, *trie.made(longest, longest - 1))
                            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["lang", "words", "windows", "counts", "n"])
                            trie = held[name] = Trie()
                            trie.add(rest)
                        trie.add(part)
                    trie.add(b"\n")
                    while sum(t.size for t in held.values()) > 2 * span or max(t.size for t in held.values()) > span:
                        yield from flush([max(held, key=lambda k: held[k].size)])
                        if not held:
                            break
        yield from flush(list(held))

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, TRIE)


def unpacked(batch: pa.RecordBatch, longest: int):
    """(language, words, window columns, counts) of each trie in a batch."""
    for lang, words, packed, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        words, packed, counts = map(zstandard.decompress, (words, packed, counts))
        yield lang, words.split(b" "), list(np.frombuffer(packed, "<u4").reshape(longest, -1)), np.frombuffer(counts, "<i8")


def hashed(lang: str, words: list[bytes]) -> np.ndarray:
    """64-bit hashes of a language's words; the first, for no word, is 0."""
    digest, seed = xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest(lang)
    return np.array([0, *(digest(w, seed) for w in words)], np.uint64)


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first * np.uint64(0x9E3779B97F4A7C15) ^ second) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def buckets(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(BITS - 1)).astype(np.int64)


def frequent_bits(table: DataFrame, longest: int, least: int) -> bytes:
    """A bit for each bucket of words and pairs (compressed): whether `least` occurrences or more fall into it. The table has 16 MB."""
    each = BITS // PARTS

    def count(batches):
        for batch in batches:
            for lang, words, columns, counts in unpacked(batch, longest):
                own = hashed(lang, words)
                (one,), times = added_up([columns[0]], counts)
                (a, b), pair_times = added_up(columns[:2], counts)
                both = b > 0
                places = np.concatenate([buckets(own[one]), buckets(paired(own[a[both]], own[b[both]]))])
                times = np.concatenate([times, pair_times[both]])
                order = np.argsort(places, kind="stable")
                places, times = places[order], np.minimum(times[order], least).astype("<u4")
                cut = np.searchsorted(places, np.arange(PARTS + 1) * each)
                full = np.flatnonzero(np.diff(cut))
                packed = [zstandard.compress(np.concatenate([(places[cut[p] : cut[p + 1]] - p * each).astype("<u4"), times[cut[p] : cut[p + 1]]]).tobytes(), 1) for p in full]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(packed, pa.binary())], names=["part", "packed"])

    def summed(batches):
        """Rows come in order of their part; each is added as it comes."""
        part, total = None, np.zeros(each, np.int64)
        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield bits_of(part, total)
                    part, total[:] = p, 0
                places, times = np.frombuffer(zstandard.decompress(packed), "<u4").reshape(2, -1)
                np.add.at(total, places, times)
        if part is not None:
            yield bits_of(part, total)

    def bits_of(part, total):
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["part", "bits"])

    sent = table.mapInArrow(count, "part long, packed binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((PARTS, each // 8), np.uint8)
    got = sent.mapInArrow(summed, "part long, bits binary").toArrow()
    for part, bits in zip(got["part"].to_pylist(), got["bits"], strict=True):
        out[part] = np.frombuffer(bits.as_buffer(), np.uint8)
    return zstandard.compress(out.tobytes(), 1)


def pruned(table: DataFrame, longest: int, bits: bytes) -> DataFrame:
    """Windows of all tries (lang, w1.., c), each ending before the first word or pair that is too rare."""
    names = ["lang", *word_columns(longest), "c"]

    def run(batches):
        held = np.frombuffer(zstandard.decompress(bits), np.uint8)

        def frequent(keys):
            at = buckets(keys)
            return (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            for lang, words, columns, counts in unpacked(batch, longest):
                own = hashed(lang, words)
                known = frequent(own)
                known[0] = False
                good = known[columns[0]]
                columns, counts = [c[good] for c in columns], counts[good]
                for k in range(1, longest):
                    a, b = columns[k - 1], columns[k]
                    on = known[b]
                    on[on] = frequent(paired(own[a[on]], own[b[on]]))
                    columns[k] = np.where(on, b, np.uint32(0))
                columns, counts = added_up(columns, counts)
                spelled = pa.array([b"", *words], pa.binary()).cast(pa.string())
                for at in range(0, len(counts), 1 << 16):
                    rows = [spelled.take(pa.array(c[at : at + (1 << 16)])) for c in columns]
                    tag = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(rows[0]), np.int32)))
                    yield pa.RecordBatch.from_arrays([tag, *rows, pa.array(counts[at : at + (1 << 16)])], names=names)

    return table.mapInArrow(run, ", ".join(f"{c} string" for c in names[:-1]) + ", c long")


def word_columns(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def ranged(parts: DataFrame, longest: int, least: int) -> DataFrame:
    """Nodes of each range of the merged trie: lang, w1.. (empty behind a phrase's end), depth, f, border; those with f >= least.

    Each range of windows is sorted, so the windows of all tries under a prefix are neighbours in it; prefixes that are open at the
    beginning or the end of a range leave it (border) with what they have there.
    """
    names = word_columns(longest)
    order = ["w1", "lang", *names[1:]]
    dealt = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(["lang string", *(f"{c} string" for c in names), "depth int", "f long", "border boolean"])

    def run(batches):
        key: list[str] | None = None  # lang and words of the last row
        sums, first = [0] * longest, [True] * longest

        def node(depth, words_, f, border):
            gone = pa.array([""], pa.string()).take(pa.array(np.zeros(len(f), np.int32)))
            columns = [*words_[: depth + 1], *[gone] * (longest - depth)]
            tail = [pa.array(np.full(len(f), depth, np.int32)), pa.array(f), pa.array(border)]
            return pa.RecordBatch.from_arrays(columns + tail, names=["lang", *names, "depth", "f", "border"])

        def closed(depth):
            """The open prefix of that depth."""
            mine, first[depth - 1] = first[depth - 1], False
            if key[depth] and (mine or sums[depth - 1] >= least):
                yield node(depth, [pa.array([v], pa.string()) for v in key], np.array([sums[depth - 1]]), [mine])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in range(longest + 1)]  # lang, w1, ..
            counts = batch.column(longest + 1).to_numpy()
            starts = np.zeros(len(counts), bool)
            starts[1:] = pc.not_equal(columns[0][1:], columns[0][:-1]).to_numpy(zero_copy_only=False)
            same = key is not None and columns[0][0].as_py() == key[0]
            for depth in range(1, longest + 1):
                c = columns[depth]
                starts[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
                same = same and c[0].as_py() == key[depth]
                if key is not None and not same:
                    yield from closed(depth)
                    sums[depth - 1] = 0
                begin = np.flatnonzero(starts | (np.arange(len(counts)) == 0))
                total = np.add.reduceat(counts, begin)
                total[0] += sums[depth - 1]
                sums[depth - 1] = int(total[-1])
                done, border = slice(0, len(begin) - 1), np.zeros(len(begin) - 1, bool)
                if len(border):
                    border[0], first[depth - 1] = first[depth - 1], False
                at, f = begin[done], total[done]
                whole = pc.not_equal(c, "").to_numpy(zero_copy_only=False)[at] & ((f >= least) | border)
                if whole.any():
                    rows = pa.array(at[whole])
                    yield node(depth, [x.take(rows) for x in columns], f[whole], border[whole])
            key = [c[-1].as_py() for c in columns]
        if key is not None:
            for depth in range(1, longest + 1):
                first[depth - 1] = True  # what follows may be in the next range
                yield from closed(depth)

    return dealt.mapInArrow(run, schema)


def merged(nodes: DataFrame, longest: int, least: int) -> DataFrame:
    """Nodes of the whole trie, of those of its ranges: what is open at borders (a few nodes a range) is added up."""
    keys = ["lang", *word_columns(longest), "depth"]
    at_borders = nodes.where("border").select(*keys).distinct()
    split = nodes.join(F.broadcast(at_borders), keys, "left_semi").groupBy(*keys).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return nodes.join(F.broadcast(at_borders), keys, "left_anti").select(*keys, "f").unionByName(split)


def salt(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def with_left_parts(nodes: DataFrame, longest: int) -> DataFrame:
    """Phrases (depth 2 and more) with `left`: f of their first word, first two words and so on, by a walk in the trie's order."""
    names = word_columns(longest)
    every = F.array(*(F.lit(i) for i in range(SALTS)))
    spread = nodes.withColumn("salt", F.explode(F.when(F.col("depth") == 1, every).otherwise(F.array(salt(F.col("w2"))))))
    dealt = spread.repartition("lang", "w1", "salt").sortWithinPartitions("lang", "w1", "salt", *names[1:])
    kept = ["lang", *names, "depth", "f"]

    def run(batches):
        last = np.zeros(longest, np.int64)  # f of the open node at each depth; a frequent phrase's ancestors are all frequent and come before it
        for batch in batches:
            depth, f = batch.column(longest + 1).to_numpy(), batch.column(longest + 2).to_numpy()
            above = np.zeros((longest - 1, len(f)), np.int64)
            for k in range(1, longest):
                at = np.maximum.accumulate(np.where(depth == k, np.arange(1, len(f) + 1), 0))
                above[k - 1] = np.append(last[k - 1], f)[at]
                if len(f):
                    last[k - 1] = above[k - 1][-1]
            rows = np.flatnonzero(depth > 1)
            lengths = depth[rows] - 1
            values = above.T[rows][np.arange(longest - 1) < lengths[:, None]]
            left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(rows)) for i in range(longest + 3)] + [left], names=[*kept, "left"])

    schema = ", ".join(["lang string", *(f"{c} string" for c in names), "depth int", "f long", "left array<long>"])
    return dealt.select(*kept).mapInArrow(run, schema)


def with_cuts(phrases_: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """Phrases with their lowest-scoring cut: l, r and score. Right parts come by suffix links, one for each cut.

    Both sides are shuffled: compressed files look smaller than what a broadcast of all nodes would take from the driver."""
    names = word_columns(longest)
    cuts = phrases_.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)))
    words_ = F.array(*(F.col(c) for c in names))
    suffix = F.slice(F.concat(words_, F.array(*[F.lit("")] * longest)), F.col("cut") + 1, F.lit(longest))
    links = cuts.withColumn("suffix", suffix).withColumn("salt", salt(F.struct(*names, "cut")))
    ends = nodes.select(F.col("lang").alias("s_lang"), words_.alias("s_words"), F.col("f").alias("r"), F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("s_salt"))
    met = links.join(ends.hint("merge"), (F.col("lang") == F.col("s_lang")) & (F.col("suffix") == F.col("s_words")) & (F.col("salt") == F.col("s_salt")))
    met = met.withColumn("l", F.get("left", F.col("cut") - 1))
    score = F.expr("CAST(CAST(2000000 * CAST(f AS DECIMAL(20,0)) AS DECIMAL(30,0)) DIV (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return met.groupBy("lang", *names, "depth").agg(F.first("f").alias("a"), least).select("lang", *names, "depth", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, longest: int, percent: int) -> DataFrame:
    """Candidates of which no longer candidate that contains them has `percent` or more of their occurrences."""
    names = word_columns(longest)
    if longest < 3:
        return candidates
    parts = []
    for depth in range(3, longest + 1):
        for k in range(2, depth):
            for i in range(depth - k + 1):
                own = [F.col(names[i + j]) if j < k else F.lit("") for j in range(longest)]
                parts.append(F.struct(*(c.alias(n) for c, n in zip(own, names, strict=True)), F.lit(depth).alias("of")))
    listed = F.explode(F.filter(F.array(*parts), lambda p: p["of"] == F.col("depth")))
    longer = candidates.where("depth > 2").select("lang", "a", listed.alias("p")).groupBy("lang", *(F.col(f"p.{n}").alias(n) for n in names)).agg(F.max("a").alias("longer"))
    enough = F.expr(f"CAST({percent} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(20,0)) <= CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(20,0))")
    return candidates.join(longer.hint("merge"), ["lang", *names], "left").where(F.coalesce(~enough, F.lit(True))).drop("longer")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, covered: int = 80, most: int = 2000, span: int = 3 << 18, slice_bytes: int = 4 << 20) -> DataFrame:
    """Each language's best phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; n: words of the language; a: occurrences of the phrase, `least` or more; l and r: those of the two parts of its
    lowest-scoring cut (of ties the first), score: floor(2000000 a / (l + r)). A phrase inside a longer one with `covered` percent of its
    occurrences gives way. Order: score, a, then the phrase's bytes; `most` rows a language. Null and empty texts have no words, null
    languages are `und`; repeated rows count each; other columns don't matter; an empty table gives no rows. longest: 2 or more.
    """
    names = word_columns(longest)
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        table = materialize(tries(docs, text, lang, longest, span, slice_bytes), "tries")
        totals = materialize(table.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")
        windows_ = materialize(pruned(table, longest, frequent_bits(table, longest, least)), "trie-windows")
        forget(table)
        ranges = materialize(ranged(windows_, longest, least), "trie-ranges")
        forget(windows_)
        nodes = materialize(merged(ranges, longest, least), "trie-nodes")
        forget(ranges)
        scored = materialize(with_cuts(with_left_parts(nodes, longest), nodes, longest), "phrase-cuts")
    best = uncovered(scored, longest, covered).withColumn("phrase", F.array_join(F.filter(F.array(*names), lambda w: w != ""), " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = materialize(best.withColumn("rank", rank).where(F.col("rank") <= most).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    forget(totals, nodes, scored)
    return best
