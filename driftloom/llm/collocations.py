"""Phrase collocations by Toivonen's mining: a sample proposes phrases, a full pass counts them and their negative border, and an expansion closes what the sample missed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm import shingles
from driftloom.llm.common import BROADCAST_BYTES, maybe_broadcast, scratch, stage, text_of

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: A phrase goes if a longer one around it has at least so many hundredths of its occurrences.
ABSORB = 100
#: One document of so many proposes; a phrase is proposed from this share of the occurrences that it would have there at the minimum.
SAMPLE, SLACK = 8, 0.5
#: Proposed phrases are kept as a table of 2**BITS bits, whatever the size of the corpus; phrases that share a bit are only counted in vain.
BITS = 26
#: Bytes of text that are counted at once, and windows that a task holds before it sends them.
CHUNK, HELD = 1 << 20, 1 << 21
#: Bits of a task's number that its names are marked by.
TASKS = (1 << 24) - 1
#: Parts that a language's candidates are ranked in before they meet.
SALTS = 64

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAKS.copy()
_OUTSIDE[[0x20, 0x09]] = True


class Windows:
    """The word windows of some texts (text, language), with hashes that name them."""

    def __init__(self, texts: list[tuple[bytes, str]], max_words: int):
        self.buffer = b"\n".join([t.lower() for t, _ in texts]) + b"\n"
        self.langs, self.max_words = [lang for _, lang in texts], max_words
        raw = np.frombuffer(self.buffer, np.uint8)
        self.starts, self.words = shingles.runs(raw, _OUTSIDE)
        out = _OUTSIDE[raw]
        self.ends = np.flatnonzero(out & ~np.concatenate([[True], out[:-1]]))
        self.piece = np.cumsum(_BREAKS[raw], dtype=np.int32)[self.starts]
        bounds = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t, _ in texts]))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], bounds])))
        known = {lang: shingles.runs(np.frombuffer((lang or " ").replace(" ", "_").encode() + b" ", np.uint8), _OUTSIDE)[1].sum() for lang in set(self.langs)}
        own = np.array([known[lang] for lang in self.langs], np.uint64)
        self.salt = own[self.doc] if len(own) else np.zeros(0, np.uint64)

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it lies in one piece) of each window of so many words, by its first word. A hash holds the length in its last three bits."""
        n = max(len(self.words) - length + 1, 0)
        h = self.salt[:n] + np.uint64(length)
        for k in range(length):
            h = h + self.words[k : k + n] * shingles._PLACE[k]
        return shingles.mix(h) & ~np.uint64(7) | np.uint64(length), self.piece[:n] == self.piece[length - 1 : length - 1 + n]

    def proposed(self, known: np.ndarray | None, depth: int, lengths: range) -> np.ndarray:
        """The hashes of the windows to count: those whose parts of depth words, or of one word fewer than they have, are all known."""
        member, found = [np.zeros(0, bool)], []
        for length in range(1, max(lengths) + 1):
            h, whole = self.of(length)
            if length in lengths:
                found.append(h[whole & self._inner(member, length, depth, len(h))])
            member.append(whole & in_table(known, h) if known is not None and length <= depth else np.zeros(0, bool))
        return np.concatenate(found)

    @staticmethod
    def _inner(member: list[np.ndarray], length: int, depth: int, n: int) -> np.ndarray:
        """Whether all parts of a window of so many words that have depth words, or one word fewer than it has, are members."""
        d, ok = min(length - 1, depth), np.ones(n, bool)
        for k in range(length - d + 1 if d else 0):
            ok &= member[d][k : k + n]
        return ok

    def named(self, names: np.ndarray, known: np.ndarray, new: np.ndarray, depth: int, task: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """(hash, first word) of the windows that this task names, and of those that an expansion adds: a part of them is new, and their parts of depth words are known."""
        member, fresh, named, added = [np.zeros(0, bool)], np.zeros(len(self.words) + 1, bool), [], []
        for length in range(1, self.max_words + 1):
            h, whole = self.of(length)
            at = np.flatnonzero(whole & in_table(names, h ^ np.uint64((task & TASKS) << 40)))
            named.append((h[at], at))
            if depth:
                around = fresh[: len(h)] | fresh[1 : len(h) + 1]
                at = np.flatnonzero(whole & around & self._inner(member, length, depth, len(h))) if length > 1 else at[:0]
                added.append((h[at], at))
                member.append(whole & in_table(known, h) if length <= depth else np.zeros(0, bool))
                fresh = np.append(around | (whole & in_table(new, h)), False) if length < self.max_words else fresh
        return tuple(tuple(np.concatenate([f[i] for f in x]) if x else np.zeros(0, np.int64) for i in range(2)) for x in (named, added))

    def text(self, first: int, length: int) -> bytes:
        return b" ".join(self.buffer[self.starts[first] : self.ends[first + length - 1]].split())


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits that hashes point to are set."""
    at = h >> np.uint64(64 - (len(table).bit_length() + 5))
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits with those of the hashes (h) set. Spark combines them; at most 2**bits / 64 words come to the driver."""
    words = hashes.select(F.shiftrightunsigned("h", 64 - bits + 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return table


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, str]]]:
    own, total = [], 0
    for batch in batches:
        for text, lang in zip(shingles.texts_of(batch.column(0)), batch.column(1), strict=True):
            own.append((text, lang.as_py()))
            total += len(text)
            if total >= CHUNK:
                yield own
                own, total = [], 0
    if own:
        yield own


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts with those of equal hashes added."""
    h, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def _hashed(docs: DataFrame, known, depth: int, lengths: range, max_words: int) -> DataFrame:
    """(h, n, task): counts of the windows to count, by hash alone, and the first task that holds each. A task sums what it holds before it sends anything."""

    def batches_of(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(h), 1 << 16):
            own = h[i : i + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[i : i + (1 << 16)]), pa.array(np.full(len(own), TaskContext.get().partitionId(), np.int32))], names=["h", "n", "task"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts in _chunks(batches):
            h, n = np.unique(Windows(texts, max_words).proposed(known.value if known else None, depth, lengths), return_counts=True)
            held.append((h, n.astype(np.int64)))
            size += len(h)
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from batches_of(*held[0])
                    held, size = [], 0
        if held:
            yield from batches_of(*_summed(held))

    return docs.mapInArrow(count, "h long, n long, task int").groupBy("h").agg(F.sum("n").alias("n"), F.min("task").alias("task"))


_NAMED = "h long, lang string, length int, phrase string, n long"


def _named(docs: DataFrame, tables, depth: int, max_words: int, by_task: bool = True) -> DataFrame:
    """(h, lang, length, phrase, n): the texts of the windows that a task names, without a count; those that an expansion adds; and all words of a language, of length 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if by_task else 0
        told: set[int] = set()
        held: dict[int, list] = {}
        totals: dict[str, int] = {}
        for texts in _chunks(batches):
            own = Windows(texts, max_words)
            for lang, k in zip(own.langs, np.bincount(own.doc, minlength=len(own.langs)).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + k
            (h, at), (more, where) = own.named(*tables.value, depth, task)
            h, first = np.unique(h, return_index=True)
            rows = [[key, own.langs[own.doc[i]], key & 7, own.text(i, key & 7), None] for key, i in zip(h.tolist(), at[first].tolist(), strict=True) if key not in told]
            told.update(h.tolist())
            more, first, n = np.unique(more, return_index=True, return_counts=True)
            for key, i, k in zip(more.tolist(), where[first].tolist(), n.tolist(), strict=True):
                if key in held:
                    held[key][4] += k
                else:
                    held[key] = [key, own.langs[own.doc[i]], key & 7, own.text(i, key & 7), k]
            if len(held) > HELD // 8:
                rows, held = [*rows, *held.values()], {}
            if rows:
                yield _rows(rows)
        yield _rows([*held.values(), *([0, lang, 0, b"", k] for lang, k in totals.items())])

    return docs.mapInArrow(count, _NAMED)


def _rows(rows: list[list]) -> pa.RecordBatch:
    h, lang, length, phrase, n = zip(*rows, strict=True) if rows else ((),) * 5
    columns = [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(lang, pa.string()), pa.array(length, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["h", "lang", "length", "phrase", "n"])


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample: int = SAMPLE, slack: float = SLACK, bits: int = BITS, on_pass: Callable[[str], None] = lambda name: None) -> DataFrame:
    """(lang, length, phrase, n) of every phrase of up to max_words words of docs (text, lang, at) with at least min_count occurrences, n being exact; of length 0, all words.

    One document of `sample`, by a hash of at and the text, proposes phrases at a lowered threshold. The full pass counts, by 61 bits of a hash (each
    language's words hash apart), what has all its shorter parts proposed: the proposed phrases and their negative border. In the next pass one task that holds
    a frequent phrase tells its text, so that texts are not sent from every task. Where phrases of the border were frequent, the
    sample failed, and that pass is an expansion too: let d be the words of the shortest failure. All frequent phrases of d words or fewer are known by
    then. Counted are all windows around a failure whose parts of d words are known, whatever their length, and so every frequent phrase
    that the full pass had to leave out: it holds a failure, and its parts are frequent. So one expansion closes the border.

    Two passes over docs read the same files in the same tasks; where docs is no such plan, texts that no task told are asked of all in one more.
    """
    spark = docs.sparkSession
    drawn = docs.where(F.pmod(F.xxhash64("at", "text"), F.lit(sample)) == 0).select("text", "lang")
    least, often = max(1, int(min_count / sample * slack)), F.col("n") >= min_count
    texts = docs.select("text", "lang")
    share = lambda table: spark.sparkContext.broadcast(table)
    with scratch(spark):
        drawn = stage(drawn, "phrase-sample")
        on_pass("sample")
        known = bit_table(_hashed(drawn, None, 0, range(1, min(2, max_words) + 1), max_words).where(F.col("n") >= least), bits)
        if max_words > 3:
            held = share(known)
            known = known | bit_table(_hashed(drawn, held, 2, range(3, max_words), max_words).where(F.col("n") >= least), bits)
            held.unpersist()
        on_pass("full")
        held = share(known)
        found = stage(_hashed(texts, held, max_words - 1, range(1, max_words + 1), max_words).where(often).withColumn("length", F.col("h").bitwiseAND(F.lit(7))), "frequent-hashes")
        held.unpersist()
        new = {k: bit_table(found.where(F.col("length") == k), bits) & ~known for k in range(1, max_words)}  # bits that the table of proposals lacks
        failed = [k for k, bits_ in new.items() if bits_.any()]
        fresh = np.bitwise_or.reduce([*new.values(), np.zeros_like(known)])
        on_pass("expansion" if failed else "names")
        names = found.select(F.col("h").bitwiseXOR(F.shiftleft(F.col("task").bitwiseAND(F.lit(TASKS)).cast("long"), 40)).alias("h"))
        told = stage(_named(texts, share((bit_table(names, bits), known | fresh, fresh)), min(failed, default=0), max_words), "phrase-texts")
        of_text = lambda rows: rows.where("n IS NULL").groupBy("h").agg(F.min(F.struct("lang", "phrase")).alias("t")).select("h", "t.lang", "t.phrase")
        named = of_text(told)
        missing = stage(found.join(named, "h", "left_anti").select("h"), "untold")
        if not missing.isEmpty():
            on_pass("names")
            none = np.zeros_like(known)
            named = named.unionByName(of_text(_named(texts, share((bit_table(missing, bits), none, none)), 0, max_words, False)).join(missing, "h", "left_semi"))
        old = found.join(named, "h").select("lang", F.col("length").cast("int").alias("length"), "phrase", "n")
        more = told.where("n IS NOT NULL AND length > 0").groupBy("h", "lang", "length", "phrase").agg(F.sum("n").alias("n")).where(often).join(found.select("h"), "h", "left_anti")
        total = told.where("length = 0").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(0).alias("length"), F.lit("").alias("phrase"), "n")
        every = old.unionByName(more.select("lang", "length", "phrase", "n")).unionByName(total)
        return stage(every, "frequent-phrases", lasting=True)


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, absorb: int = ABSORB, top: int | None = TOP, sample: int = SAMPLE, slack: float = SLACK, bits: int = BITS, broadcast_bytes: int = BROADCAST_BYTES, on_pass: Callable[[str], None] = lambda name: None) -> DataFrame:
    """Phrases of 2 to max_words words that stand together more often than their parts would by chance, ranked in each language.

    Letters A-Z are lowered; `.,;:!?` and line ends cut a text into pieces, blanks and tabs a piece into words. A phrase with a occurrences, at least
    min_count, is cut after its first k words into parts with l and r occurrences: the lowest floor(1000 * a * n / (l * r)) over its cuts is its score, n
    being the language's words, and the least such k its cut. A phrase inside a longer one with absorb hundredths of its occurrences goes. Returns lang, rank,
    phrase, a, l, r, n, score and cut of each language's first `top` by score, a (both descending) and phrase in byte order; all of them if top is None.

    Counts are exact and of all documents; see frequent_phrases. A null language counts as `und`, a null text as empty. Rows that repeat
    count as often as they stand there. Other columns are ignored. An empty table gives an empty result.
    """
    body = docs.select(F.col(id_col).cast("string").alias("at"), text_of(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    with scratch(docs.sparkSession):
        counted = frequent_phrases(body, min_count, max_words, sample, slack, bits, on_pass)
        n = F.broadcast(counted.where("length = 0").select("lang", F.col("n").alias("words"))) if counted.where("length = 0").limit(1001).count() <= 1000 else counted.where("length = 0").select("lang", F.col("n").alias("words"))
        parts = maybe_broadcast(stage(counted.where(F.col("length").between(1, max_words - 1)).select("lang", "phrase", "n"), "phrase-parts"), 24, broadcast_bytes)
        own = stage(counted.where("length > 1").select("lang", "phrase", "length", F.col("n").alias("a")), "phrase-candidates")

        words = F.split("phrase", " ")
        cuts = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("cut"), "length")
        cuts = cuts.select("lang", "phrase", "a", "cut", _part(words, F.lit(1), F.col("cut")).alias("left"), _part(words, F.col("cut") + 1, F.col("length") - F.col("cut")).alias("right"))
        cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"]).join(n, "lang")
        big = lambda c: F.col(c).cast("decimal(20,0)")
        cuts = cuts.withColumn("over", (F.lit(1000) * big("a") * big("words")).cast("decimal(38,0)")).withColumn("under", (big("l") * big("r")).cast("decimal(38,0)")).withColumn("score", F.expr("`over` div `under`"))
        scored = cuts.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

        inner = own.where("length > 2").select("lang", "phrase", "a", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("k"))
        inner = inner.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("k") + 1)).alias("start"))
        around = inner.select("lang", _part(words, F.col("start"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        left = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < absorb * F.col("a")))
        rows = stage(left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("words").alias("n"), F.col("best.score").alias("score"), F.col("best.cut").alias("cut")), "collocations", lasting=True)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        part = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        rows = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top).drop("place", "salt")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
