"""Removal of repeated passages by longest-previous-factor arrays over suffix order.

Suffixes matter only to a depth of min_bytes, so the suffix array is cut into buckets: a suffix goes to the bucket named by
the least hash among the grams at the start of its min_bytes-byte prefix. Equal prefixes share that hash, so each bucket holds every suffix that a member
can match. Neighbouring suffixes of a document mostly share a bucket and travel together as one snippet of text. Buckets
that only one document has are dropped before any text moves. A bucket of many documents, whose common gram stands between differing
neighbours, is dealt out again: its suffixes travel one by one as 128-bit hashes of their min_bytes-byte prefixes and are put in the order of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import shingles
from driftloom.llm.common import BROADCAST_BYTES, maybe_broadcast, scratch, stage, text_of
from driftloom.llm.exact_dedup import exact_duplicates

MIN_BYTES = 50
GRAM = 16
#: Bytes of snippets that are put in suffix order at once; a bucket that alone is larger doubles it as it goes.
CHUNK = 1 << 21
#: Documents of a bucket above which its suffixes are dealt out one by one.
HOT = 8192
#: What tasks are sized for: bytes of text whose buckets, and snippets that, one task sorts.
TASK_BYTES, TASK_SNIPPETS = 64 << 20, 400_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(text: bytes, width: int = 8) -> np.ndarray:
    """The big-endian integer of the bytes at each place of a text."""
    return np.ndarray((len(text) - width + 1,), f">u{width}", text, strides=(1,)).astype(np.uint64)


def bucket_runs(text: bytes, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first start) of each maximal run of starts of min_bytes-byte strings with the same bucket; a text too short has none."""
    if len(text) < min_bytes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    eight = _words(text)
    least = shingles.mix(eight[: len(text) - GRAM + 1] * _A + eight[GRAM - 8 :] * _B)
    wide, span = 1, min_bytes - GRAM + 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value, or -1. All places jump at once over places already known not to be smaller."""
    at = np.arange(-1, len(values) - 1)
    live = np.arange(len(values))
    while True:
        live = live[at[live] >= 0]
        live = live[values[at[live]] >= values[live]]
        if not len(live):
            return at
        at[live] = at[at[live]]


def _suffix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The places in the order of the keys, the first one first. Most suffixes are told apart by that one; only ties are sorted by all."""
    order = np.argsort(keys[0], kind="stable")
    same = keys[0][order[1:]] == keys[0][order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    own = order[tied]
    order[tied] = own[np.lexsort([k[own] for k in keys[::-1]])]
    return order


def reaches_earlier(text: bytes, starts: np.ndarray, docs: np.ndarray, min_bytes: int = MIN_BYTES) -> np.ndarray:
    """Whether the longest previous factor of each suffix of text, previous meaning in a smaller document, has min_bytes bytes.

    The suffixes are put in order to that depth. The longest previous factor of a suffix is its common prefix with its
    previous or its next smaller document in that order, whichever is longer.
    """
    text += b"\0" * 8
    eight = _words(text)
    keys = [eight[starts + i] for i in range(0, min_bytes - 7, 8)]
    if min_bytes % 8:
        keys.append(eight[starts + min_bytes - 8])
    order = _suffix_order(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    block = np.concatenate([[0], np.cumsum(~same)])  # suffixes of a block have min_bytes bytes in common
    own = docs[order]
    before = _nearest_smaller(own)
    after = len(own) - 1 - _nearest_smaller(own[::-1])[::-1]
    long = (before >= 0) & (block[before] == block)
    inside = after < len(own)
    long |= inside & (block[np.where(inside, after, 0)] == block)
    found = np.empty(len(order), bool)
    found[order] = long
    return found


def _bucket_rows(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(bucket, doc) of every bucket of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 256):
                own = [np.unique(bucket_runs(x.encode(), min_bytes)[0]) for x in texts[at : at + 256]]
                doc = np.repeat(np.array(ids[at : at + 256], np.int64), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(doc)], names=["bucket", "doc"])

    return docs.select("doc", "text").mapInArrow(run, "bucket long, doc long")


def _shared(rows: Iterator[pa.RecordBatch], hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, doc), sorted, those of buckets with two documents or more, and whether the bucket has more than so many rows.

    A bucket may run over any number of batches; of an unfinished one no more than `hot` rows are held beside a batch.
    """

    def told(bucket: np.ndarray, doc: np.ndarray, is_hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(doc), pa.array(is_hot)], names=["bucket", "doc", "hot"])

    def whole(bucket: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(starts, len(bucket)))
        several = np.repeat(np.logical_or.reduceat(doc != np.repeat(doc[starts], sizes), starts), sizes)
        return told(bucket[several], doc[several], np.repeat(sizes > hot, sizes)[several])

    held_b, held_d, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in rows:
        bucket, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if open_ is not None:
            n = int(np.searchsorted(bucket, open_, side="right"))
            if n:
                yield told(bucket[:n], doc[:n], np.ones(n, bool))
            bucket, doc = bucket[n:], doc[n:]
        bucket, doc = np.concatenate([held_b, bucket]), np.concatenate([held_d, doc])
        if not len(bucket):
            continue
        open_ = None
        last = int(np.searchsorted(bucket, bucket[-1]))
        if last:
            yield whole(bucket[:last], doc[:last])
        held_b, held_d = bucket[last:], doc[last:]
        if len(held_b) > hot:
            if (held_d != held_d[0]).any():
                yield told(held_b, held_d, np.ones(len(held_b), bool))
                open_, held_b, held_d = held_b[0], held_b[:0], held_d[:0]
            else:  # rows of one id
                held_b, held_d = held_b[:1], held_d[:1]
    if len(held_b):
        yield whole(held_b, held_d)


def _prefix_hashes(text: bytes, starts: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the min_bytes bytes at each of the starts."""
    eight = _words(text)
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for i in (*range(0, min_bytes - 7, 8), min_bytes - 8):
        word = eight[starts + i]
        one, two = shingles.mix(one * _A + word * _B), shingles.mix(two * _B + (word ^ _A))
    return one.view(np.int64), two.view(np.int64)


def _spans(parts: list[tuple[int, int]]) -> list[list[int]]:
    """The maximal runs that parts cover."""
    spans: list[list[int]] = []
    for a, b in sorted(parts):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


_SNIPPET = "bucket long, second long, doc long, mark long, start long, starts array<long>, snippet binary"
#: What stands in a snippet's place where there is none: a hot suffix's prefix hashes are its bucket and second, or starts holds a part's ends.
_PREFIX, _GONE = None, b""


def _hot_rows(one: np.ndarray, two: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, min_bytes: int) -> list[list]:
    """Columns of rows for suffixes of hot buckets: one per prefix, of the least of these documents that has it, with all its starts there; what the others
    repeat of it is gone already, as merged parts."""
    order = np.lexsort((start, mark, doc, two, one))
    one, two, doc, mark, start = (x[order] for x in (one, two, doc, mark, start))
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    least = doc[new][np.cumsum(new) - 1]
    stays = doc == least
    heads = np.flatnonzero(stays & (new | np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])))
    counts = np.diff(np.append(np.cumsum(stays)[heads] - 1, stays.sum()))
    out = [[one[heads], two[heads], doc[heads], mark[heads], start[heads], counts, start[stays], _PREFIX]]
    if not stays.all():
        at = np.lexsort((start[~stays], mark[~stays], doc[~stays]))
        doc, mark, start = (x[~stays][at] for x in (doc, mark, start))
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + min_bytes)]))
        ends = start[np.append(first[1:], len(start)) - 1] + min_bytes
        anywhere = shingles.mix(doc[first].view(np.uint64) ^ (start[first].view(np.uint64) << np.uint64(20))).view(np.int64)
        out.append([anywhere, np.zeros_like(anywhere), doc[first], mark[first], start[first], np.full(len(first), 2), np.stack([start[first], ends], axis=1).ravel(), _GONE])
    return out


def _snippets(docs: DataFrame, min_bytes: int) -> DataFrame:
    """Rows of _SNIPPET: the runs of each document whose bucket is among its shared ones, as text, or one by one as hashes if the bucket is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, buckets, starts, parts, hot, hot_texts, size, hot_size = [], [], [], [], [], [], 0, 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                text = text.encode()
                bucket, first = bucket_runs(text, min_bytes)
                signed = bucket.view(np.int64)
                last = np.append(first[1:], len(text) - min_bytes + 1)
                shared = np.isin(signed, batch.column(3)[row].values.to_numpy())
                own, ends = first[shared], last[shared] + min_bytes - 1
                parts += [text[a:b] for a, b in zip(own.tolist(), ends.tolist(), strict=True)]
                rows += [row] * len(own)
                buckets.append(signed[shared])
                starts.append(own)
                if len(hots := batch.column(4)[row].values):
                    wide = np.isin(signed, hots.to_numpy())
                    counts = (last - first)[wide]
                    each = np.arange(counts.sum()) + np.repeat(first[wide] - np.cumsum(counts) + counts, counts)
                    hot.append((np.full(len(each), row), each, np.full(len(each), hot_size)))
                    hot_texts.append(text)
                    hot_size += len(text)
                size += len(text)
                if size > 1 << 21 or row == batch.num_rows - 1:
                    at, n = np.array(rows, np.int64), len(rows)
                    if n:
                        none = pa.nulls(n, pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.zeros(n, np.int64)), pa.array(ids[at]), pa.array(marks[at]), pa.array(np.concatenate(starts)), none, pa.array(parts, pa.binary())], names=names)
                    if sum(len(x[0]) for x in hot):
                        at, each, base = map(np.concatenate, zip(*hot, strict=True))
                        one, two = _prefix_hashes(b"".join(hot_texts), each + base, min_bytes)
                        for *own, counts, flat, what in _hot_rows(one, two, ids[at], marks[at], each, min_bytes):
                            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int64)))
                            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in own), listed, pa.array([what] * len(counts), pa.binary())], names=names)
                    rows, buckets, starts, parts, hot, hot_texts, size, hot_size = [], [], [], [], [], [], 0, 0

    names = [x.split()[0] for x in _SNIPPET.split(", ")]
    return docs.select("doc", "mark", "text", "buckets", "hots").mapInArrow(run, _SNIPPET)


class _Prefixes:
    """Finds the suffixes of hot buckets, sorted by their prefixes' hashes and document, that a smaller document has too; a prefix may run over any number of batches."""

    def __init__(self, min_bytes: int):
        self.min_bytes, self.last, self.first = min_bytes, None, 0

    def found(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two, doc, mark = (batch.column(i).to_numpy() for i in range(4))
        new = np.concatenate([[(one[0], two[0]) != self.last], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        heads = doc[new] if new[0] else np.concatenate([[self.first], doc[new]])
        least = heads[np.cumsum(new) - (1 if new[0] else 0)]
        self.last, self.first = (one[-1], two[-1]), heads[-1]
        gone = doc > least
        starts = batch.column(5).filter(pa.array(gone))
        at = np.repeat(np.flatnonzero(gone), starts.value_lengths().to_numpy(zero_copy_only=False))
        own = starts.flatten().to_numpy()
        return _parts(doc[at], mark[at], own, own + self.min_bytes)


def _parts(doc, mark, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, mark, start, stop)], names=["doc", "mark", "from", "to"])


class _Buckets:
    """Solves snippets that come sorted by bucket and document, many small buckets or a part of a large one at a time.

    Strings of different buckets are never equal, so buckets may be solved together. When a bucket is larger than a chunk,
    its snippets with a start that no smaller document had stay as sources for the rest of it, and the next chunk is at least as large again.
    """

    def __init__(self, min_bytes: int):
        self.min_bytes = min_bytes
        self.out: list[tuple[int, int, int, int]] = []
        self.sources: list[tuple] = []
        self.fresh: list[tuple] = []
        self.bucket, self.first_of, self.from_, self.size, self.most = None, {}, 0, 0, CHUNK
        self.sources_current = False

    def add(self, bucket: int, doc: int, mark: int, start: int, snippet: bytes) -> None:
        if bucket != self.bucket:
            if self.size >= CHUNK:
                self.solve(False)
            self.bucket, self.first_of, self.from_, self.sources_current = bucket, {}, len(self.fresh), False
        if self.first_of.setdefault(snippet, doc) < doc:  # all its suffixes stand next to those of an equal snippet
            self.out.append((doc, mark, start, start + len(snippet)))
            return
        self.fresh.append((doc, mark, start, snippet))
        self.size += len(snippet)
        if self.size >= self.most:
            self.solve(True)

    def solve(self, goes_on: bool) -> None:
        every, new = self.sources + self.fresh, []
        if self.fresh:
            doc, mark, start = (np.array([x[i] for x in every], np.int64) for i in range(3))
            sizes = np.array([len(x[3]) for x in every])
            base, counts = np.cumsum(sizes) - sizes, sizes - self.min_bytes + 1
            begins = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(every)), counts)
            found = reaches_earlier(b"".join(x[3] for x in every), np.arange(len(owner)) - begins[owner] + base[owner], doc[owner], self.min_bytes)
            edge = np.zeros(len(owner) + 1, bool)
            edge[begins] = edge[-1] = True
            first = np.flatnonzero(found & (edge[:-1] | ~np.append(False, found[:-1])))
            last = np.flatnonzero(found & (edge[1:] | ~np.append(found[1:], False)))
            own = owner[first] >= len(self.sources)
            first, last, who = first[own], last[own], owner[first[own]]
            at = start[who] - begins[who]
            self.out += zip(doc[who].tolist(), mark[who].tolist(), (at + first).tolist(), (at + last + self.min_bytes).tolist(), strict=True)
            whole = np.logical_and.reduceat(found, begins)[len(self.sources) + self.from_ :]
            new = [x for x, w in zip(self.fresh[self.from_ :], whole, strict=True) if not w]
        self.sources = (self.sources if self.sources_current else []) + new if goes_on else []
        self.sources_current, self.fresh, self.from_ = goes_on, [], 0
        self.size = sum(len(x[3]) for x in self.sources)
        self.most = max(CHUNK, 2 * self.size)

    def take(self) -> list[pa.RecordBatch]:
        out, self.out = self.out, []
        return [_parts(*zip(*out, strict=True))] if out else []


def _matches(min_bytes: int):
    """Of sorted rows of _SNIPPET, the parts (doc, mark, from, to) of texts that repeat a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, prefixes = _Buckets(min_bytes), _Prefixes(min_bytes)
        for batch in batches:
            snippet = batch.column(6)
            hot, gone = snippet.is_null(), pc.equal(pc.binary_length(snippet), 0)
            if (own := batch.filter(hot)).num_rows:
                yield prefixes.found(own)
            if (own := batch.filter(gone)).num_rows:
                ends = own.column(5).flatten().to_numpy().reshape(-1, 2)
                yield _parts(own.column(2), own.column(3), ends[:, 0], ends[:, 1])
            own = batch.filter(pc.greater(pc.binary_length(snippet), 0))
            for row in zip(*(own.column(i).to_pylist() for i in (0, 2, 3, 4, 6)), strict=True):
                buckets.add(*row)
            yield from buckets.take()
        buckets.solve(False)
        yield from buckets.take()

    return run


def _cut(text: bytes, parts: list[tuple[int, int]]) -> tuple[list[list[int]], bytes]:
    """The maximal runs covered by parts, and what is left of the text."""
    spans = _spans(parts)
    ends = [0, *(x for s in spans for x in s), len(text)]
    return spans, b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, keep_bytes: bool = False, partitions: int | None = None, hot: int = HOT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Remove every byte covered by a min_bytes-byte string that also starts in a document with a smaller id; the first document keeps it.

    Returns per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of from, to) and with keep_bytes the bytes left, as
    binary since a cut may split a character. Strings are judged on the input and never cross documents.

    Ids must be integers. Rows that share an id are one document among themselves: they do not remove each other's strings.
    A null id neither removes nor is removed; a null text is empty. Whole copies of a smaller document are
    found by exact_duplicates first and removed whole if they have min_bytes bytes; they add nothing to what others match. An empty table gives none.
    """
    if not 2 * GRAM <= min_bytes:
        raise ValueError(f"min_bytes must be at least {2 * GRAM}")
    text = text_of(text_col)
    body = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    with scratch(docs.sparkSession):
        # An id may have several texts, so a copy is named by its id and its text's mark; equal texts have one mark, so the least id stays the least.
        named = body.where("doc is not null").select(F.struct("doc", "mark").alias("named"), "text")
        copies = stage(exact_duplicates(named, "named", "text", keep="min").where("not kept").select("named.doc", "named.mark").distinct(), "repeat-copies")
        whole = body.join(maybe_broadcast(copies, 24, broadcast_bytes), ["doc", "mark"], "left_anti").where("doc is not null")

        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sized = lambda n, each: partitions or max(least, -(-n // each))
        n_bytes = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        rows = _bucket_rows(whole, min_bytes).repartition(sized(n_bytes, TASK_BYTES), "bucket").sortWithinPartitions("bucket", "doc")
        listed = lambda is_hot: F.collect_list(F.when(F.col("hot") == is_hot, F.col("bucket")))
        shared = rows.mapInArrow(lambda own: _shared(own, hot), "bucket long, doc long, hot boolean").groupBy("doc").agg(listed(False).alias("buckets"), listed(True).alias("hots"))
        shared = stage(shared, "repeat-buckets")
        n_snippets = shared.agg(F.sum(2 * F.size("buckets") + 8 * F.size("hots"))).first()[0] or 0
        met = whole.join(shared.hint("merge"), "doc")  # both grow with the corpus, so they are shuffled at every size
        snippets = _snippets(met, min_bytes).repartition(sized(n_snippets, TASK_SNIPPETS), "bucket").sortWithinPartitions("bucket", "second", "doc")
        parts = snippets.mapInArrow(_matches(min_bytes), "doc long, mark long, from long, to long")
        parts = stage(parts.groupBy("doc", "mark").agg(F.collect_list(F.struct("from", "to")).alias("parts")), "repeat-parts")

        # A copy is removed whole; rows of its id with other texts keep theirs.
        marks = body.select("doc", "mark", F.octet_length("text").alias("n")).join(maybe_broadcast(copies, 24, broadcast_bytes), ["doc", "mark"])
        gone = marks.where(f"n >= {min_bytes}").select("doc", "mark", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").cast("long").alias("to"))).alias("parts")).distinct()
        parts = stage(parts.join(gone.select("doc", "mark"), ["doc", "mark"], "left_anti").unionByName(gone), "repeat-all", lasting=True)
    found = body.join(parts.hint("merge"), ["doc", "mark"], "left")

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>" + (", kept binary" if keep_bytes else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text.encode()
                spans, left = _cut(text, [(p["from"], p["to"]) for p in own or ()])
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"from": a, "to": b} for a, b in spans], left))
            if out:
                kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)][: 6 if keep_bytes else 5]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names[: len(columns) + 1])

    return found.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "text", "parts").mapInArrow(cut, schema)
