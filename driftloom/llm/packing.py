"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import stage, text_of

MAX_TOKENS = 1024
#: Bins that a packing task holds open.
OPEN_BINS = 4096
#: Pieces that one packing task takes.
TASK_PIECES = 100_000
#: Distinct pre-tokens whose ids a worker keeps; frequent ones come early, later ones are encoded each time.
CACHED = 300_000

# Pre-tokens of texts below U+0250, where Python's `re` can name the classes: letters, numbers and white space, fixed by Unicode.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_BLANK = "\t-\r \u0085 "
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_BEYOND = re.compile("[^\u0000-ɏ]")


class _Ids(dict):
    """Little-endian 32-bit ids by pre-token; unknown ones are encoded on first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece), "<u4").tobytes()
        if len(self) < CACHED:
            self[piece] = ids
        return ids


class ByteBPE:
    """Ids of texts as the tokenizers file of a byte-level BPE gives them without adding special tokens, packed as unsigned 32-bit integers.

    The vocabulary is read from that file; its merges are run by tiktoken, several times faster, and the ids of pre-tokens
    are cached, since most words of a corpus repeat. The file's added tokens are cut out of a text first, wherever their
    content stands in it, and give their own ids.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, added = file["model"]["vocab"], file["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        # The byte alphabet of such files: printable Latin-1 characters stand for themselves, others for U+0100 onward.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in vocab.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ids = _Ids(self.encoding.encode_ordinary)
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None

    def encode(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added[x] if n % 2 else self._plain(x) for n, x in enumerate(self.cut.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _BEYOND.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, _PIECE.findall(text)))


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The tokenizer of this worker, loaded once."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Every text's ids with end_id appended, cut into pieces of at most max_tokens.

    A text that fits is one piece; of a longer one all pieces but the first are full. Returns id, piece, start, length,
    ids_crc32 and with keep_ids also ids (32-bit little-endian binary). A null text is the end token alone.
    """
    kind = docs.schema[id_col].dataType
    fields = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "binary"} if keep_ids else {})
    schema = f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields.items())
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            rows, cols = [], {n: [] for n in fields}
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                stop = total % max_tokens or max_tokens
                start = 0
                piece = 0
                while start < total:
                    part = ids[4 * start : 4 * stop]
                    rows.append(row)
                    cols["piece"].append(piece)
                    cols["start"].append(start)
                    cols["length"].append(stop - start)
                    cols["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        cols["ids"].append(part)
                    start, stop, piece = stop, stop + max_tokens, piece + 1
            types = {"piece": pa.int32(), "ids": pa.binary()}
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(v, types.get(n, pa.int64())) for n, v in cols.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *fields])

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(cut, schema)


class OpenBins:
    """A fixed number of open bins, found by a bitset over free space.

    Bit f is set while a bin with f tokens free is open. A piece goes to the bin with the least sufficient free space; if
    there is none and all bins are open, the fullest, the one of the lowest set bit, closes for a new one.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made, self.bits = size, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of that length."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            found = self._pop(free)
        else:
            if self.open >= self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            found, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(found)
            self.open += 1
        return found, self.size - free


def pack(pieces: DataFrame, length_col: str = "length", max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: best fit into sequences of max_tokens, gapless from offset 0.

    Pieces are dealt to tasks at random whatever their source, so no key can be hot; each task takes about task_pieces and
    packs them alone, in an order fixed by a hash of the row and its place in a staged table, so that equal rows part and a task that runs again after a lost executor packs alike.
    Lengths must lie in 1..max_tokens. Repeated rows are packed as often as they come. An empty table gives none.
    """
    pieces = stage(pieces, "pieces")
    tasks = max(1, -(-pieces.count() // task_pieces))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns], F.monotonically_increasing_id())  # numbers of the staged table's rows, so that equal rows part
    dealt = pieces.withColumn("_deal", row).repartition(tasks, F.pmod("_deal", F.lit(tasks * 64))) if tasks > 1 else pieces.withColumn("_deal", row).coalesce(1)
    dealt = dealt.withColumn("sequence_id", F.spark_partition_id().cast("long")).withColumn("offset", F.lit(0).cast("long"))
    dealt = dealt.sortWithinPartitions("_deal", *[f"`{c}`" for c in pieces.columns])
    at = pieces.columns.index(length_col)
    schema = dealt.drop("_deal").schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(max_tokens, open_bins)
        for batch in batches:
            n = batch.num_columns
            task = (batch.column(n - 2)[0].as_py() if batch.num_rows else 0) << 40
            placed = np.array([bins.place(x) for x in batch.column(at).to_pylist()], np.int64).reshape(-1, 2)
            arrays = [batch.column(i) for i in range(n - 3)] + [pa.array(placed[:, 0] + task), pa.array(placed[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return dealt.mapInArrow(place, schema)


def packed_sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence of a table packed with keep_ids: its ids and the boundaries of its pieces. At most max_tokens ids each, so the groups are bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.concat(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))).alias("ids"), F.transform("parts", lambda p: F.struct(p["id"], p["piece"], p["offset"], p["length"])).alias("pieces"))
