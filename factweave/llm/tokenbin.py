"""Token-id output: documents in ascending order as one id array, with Elias-Fano coded document boundaries.

Both rising sequences of a segment, the documents' ends in the id array and their doc_ids, are Elias-Fano coded: the low bits of each number packed, the high bits in unary, with the place of each
64th set bit. No table of 64-bit numbers is kept; `read` asks the select structure for each document's bounds and id.

A *segment* is the unit of the file format (see `pack`). It holds whole documents only and about `segment_ids` ids; a longer
document makes a segment of its own. Segments are written as rows (part, seg, start_in_part, n_docs, n_ids, segment) of a Parquet
folder: Spark's committer makes that write atomic on any store and under lost executors, and each value of `segment` is
byte for byte what `export` writes as a file of its own.

A tokenizer whose ids of a text are those of its words in a row (it drops white space and treats each word alone: told from its settings and then tried) is asked for each word
once; any other gets whole texts.

Edge cases: a null or empty text gives the end id alone; null doc_ids come first, counted in the segment; repeated doc_ids give a row each,
in order of their texts' hashes; an empty table gives an empty folder; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.util import coded, release, shared_path, ship, shuffle_partitions, slices, words

MAGIC = b"EFIDS02\n"
HEADER = struct.Struct("<8sBHIQQq")  # magic, bytes per id, 0, null doc_ids, documents, ids, smallest doc_id
RISING = struct.Struct("<BIQ")  # low bits, select step, bytes of the upper bits
SELECT_STEP = 64
SCHEMA = "part int, seg long, start_in_part long, n_docs long, n_ids long, segment binary"


# --- the file format ---------------------------------------------------------------------------------------------------------


def pack_rising(values: np.ndarray) -> bytes:
    """Elias-Fano code of numbers that never fall, from 0 on: header, low bits, upper bits in unary, the position of each 64th set bit (uint32). Bits are in little order."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    values = values.astype(np.uint64)
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = np.packbits(((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low else np.zeros(0, np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    upper = np.packbits(bits, bitorder="little")
    return b"".join([RISING.pack(low, SELECT_STEP, len(upper)), lows.tobytes(), upper.tobytes(), ones[::SELECT_STEP].astype("<u4").tobytes()])


class Rising:
    """Reads what pack_rising wrote, from `at` on; `end` is where it ends."""

    def __init__(self, data: bytes, at: int, n: int):
        self.low, step, upper = RISING.unpack_from(data, at)
        if step != SELECT_STEP:
            raise ValueError("not this select step")
        at += RISING.size
        self.lows = data[at : (at := at + (n * self.low + 7) // 8)]
        self.upper = data[at : (at := at + upper)]
        self.samples = np.frombuffer(data, "<u4", -(-n // SELECT_STEP), at)
        self.end = at + 4 * len(self.samples)

    def select(self, i: int) -> int:
        """The i-th number: its set bit in the upper bits, from the nearest sample, and its low bits."""
        at, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        byte, first = at // 8, at % 8
        while True:  # eight bytes at a time
            bits = int.from_bytes(self.upper[byte : byte + 8], "little") >> first << first
            if left < (have := bits.bit_count()):
                for _ in range(left):
                    bits &= bits - 1
                at = byte * 8 + (bits & -bits).bit_length() - 1
                break
            left, byte, first = left - have, byte + 8, 0
        bit = i * self.low
        low = int.from_bytes(self.lows[bit // 8 : (bit + self.low + 7) // 8], "little") >> bit % 8 & ((1 << self.low) - 1)
        return (at - i) << self.low | low


def pack(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: header, the documents' ends, the doc_ids that aren't null less the smallest (nulls come first), ids. All integers are little-endian."""
    known = doc_ids[int(nulls.sum()) :].astype(np.int64)
    least = int(known[0]) if len(known) else 0
    rest = (known.view(np.uint64) - np.array([least], np.int64).view(np.uint64)) if len(known) else known.astype(np.uint64)
    head = HEADER.pack(MAGIC, ids.dtype.itemsize, 0, int(nulls.sum()), len(counts), int(counts.sum()), least)
    return b"".join([head, pack_rising(np.cumsum(counts, dtype=np.int64)), pack_rising(rest), ids.tobytes()])


class Segment:
    """Reads a packed segment: `bounds(i)` and `doc_id(i)` answer from the coded sequences, `document(i)` gives the ids."""

    def __init__(self, data: bytes):
        magic, width, _, self.nulls, self.n, self.total, self.least = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self.ends = Rising(data, HEADER.size, self.n)
        self.keys = Rising(data, self.ends.end, self.n - self.nulls)
        self.ids = np.frombuffer(data, f"<u{width}", self.total, self.keys.end)

    def end(self, i: int) -> int:
        return self.ends.select(i)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.end(i - 1) if i else 0, self.end(i)

    def doc_id(self, i: int) -> int | None:
        return self.least + self.keys.select(i - self.nulls) if i >= self.nulls else None

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


# --- encoding ----------------------------------------------------------------------------------------------------------------

#: A word of Latin-1 letters, with signs after it: the tokenizer splits these apart, so both parts are kept once.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*)]*)")
SPLIT = rf"^{PLAIN.pattern.replace('([A', '(?P<letters>[A').replace('([.', '(?P<signs>[.')}$"


def taken(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of stretches (starts, lengths), those of the stretch of each code in a row, and where each one's items end."""
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n)
    at += np.arange(len(at))
    return at, ends


class Encoder:
    """Ids of words. The tokenizer drops white space, so a text's ids are those of its words in a row, and a word that comes again
    need not be encoded again. At most `keep` parts of words are remembered."""

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keep, self.parts = keep, {}
        # lower-case letters are one piece to the tokenizer, so its model can take them without the steps before it; that is tried on
        # all letters first, and on words of each two of them
        letters = [c for c in map(chr, range(256)) if PLAIN.fullmatch(c) and c == c.lower()]
        pieces = [self.tokenizer.pre_tokenizer.pre_tokenize_str(c) if self.tokenizer.pre_tokenizer else [] for c in letters]
        self.table = str.maketrans({c: p[0][0] for c, p in zip(letters, pieces, strict=True) if len(p) == 1})
        tried = [x + y + z for x in letters for y in letters for z in ("", "en")]
        self.direct = all(len(p) == 1 for p in pieces) and self.by_model(tried) == self.raw(tried)
        self.by_words = self.words_alone()

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def by_model(self, letters: list[str]) -> list[bytes]:
        tokenize, kind = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, [t.id for t in tokenize(x.translate(self.table))]).tobytes() for x in letters]

    def words_alone(self) -> bool:
        """Whether a text's ids are those of its words in a row, in either case of their letters: the settings must drop white space and change each character on its own, and texts of all
        sorts must come out the same either way."""
        import json

        said = json.loads(self.tokenizer.to_str())
        flat = lambda x, key: x.get(key, [x]) if x else []
        steps, splits = flat(said.get("normalizer"), "normalizers"), flat(said.get("pre_tokenizer"), "pretokenizers")
        known = lambda x: x.get("type") in ("BertNormalizer", "Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents") or (x.get("type"), x.get("pattern"), x.get("content")) == ("Replace", {"Regex": r"\s+"}, " ")
        drops = lambda x: x.get("type") in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit") or (x.get("type"), x.get("behavior"), x.get("invert")) == ("Split", "Removed", True)
        late = lambda x: x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")
        if said.get("truncation") or not splits or not all(map(known, steps)) or not drops(splits[0]) or not all(map(late, splits[1:])):
            return False
        words = "Mixed CASE words, and (signs) -- don't 12,345.67 a_b x/y é É ÄÖÜß ñ œ 東京 привет #tag @me $5 100% e.g. U.S.A. \u2014 \u2019s".split()
        for gap in (" ", "  ", "\t", "\n", "\r\n \n", "\x0b", "\x0c"):
            text = gap + gap.join(words) + gap
            if self.raw([text]) != [self.words(pa.array(words))[0].tobytes()]:
                return False
        return True

    def known(self, found: list[str], letters: bool) -> list[bytes]:
        """Ids of parts of words, each of letters or each of anything, asked for once."""
        parts = self.parts
        new = [x for x in found if x not in parts]
        parts.update(zip(new, (self.by_model if letters and self.direct else self.raw)(new), strict=True))
        return [parts[x] for x in found]

    def words(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has. Kernels split the words into letters and signs, so that Python sees each part once."""
        if len(self.parts) > self.keep:
            self.parts.clear()
        split = pc.extract_regex(unique, SPLIT)
        plain = split.is_valid()
        letters = pc.utf8_lower(pc.struct_field(split, "letters")).filter(plain).dictionary_encode()
        signs = pc.struct_field(split, "signs").filter(plain).dictionary_encode()
        other = unique.filter(pc.invert(plain))
        each = [*self.known(letters.dictionary.to_pylist(), True), *self.known([x for x in signs.dictionary.to_pylist() if x], False), b"", *self.known(other.to_pylist(), False)]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        n, filled = len(letters.dictionary), [x != "" for x in signs.dictionary.to_pylist()]
        nothing = n + sum(filled)
        sign = np.where(filled, n + np.cumsum(filled) - 1, nothing)
        pieces = np.full((len(unique), 2), nothing, np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        pieces[is_plain, 0] = letters.indices.to_numpy()
        pieces[is_plain, 1] = sign[signs.indices.to_numpy()] if len(signs) else nothing
        pieces[~is_plain, 0] = nothing + 1 + np.arange(len(other))
        at, _ = taken(np.cumsum(lengths) - lengths, lengths, pieces.ravel())
        return np.frombuffer(b"".join(each), self.dtype)[at], lengths[pieces].sum(axis=1)

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and each text's count."""
        if not self.by_words:
            stop = np.array([end_id], self.dtype).tobytes()
            each = [x + stop for x in self.raw([t or "" for t in texts.to_pylist()])]
            return np.frombuffer(b"".join(each), self.dtype), np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        flat, offsets = words(texts)
        codes, unique = coded(flat)
        ids, lengths = self.words(unique)
        ids, lengths = np.append(ids, np.array([end_id], self.dtype)), np.append(lengths, 1)
        codes = np.insert(codes.astype(np.int64), offsets[1:], len(lengths) - 1)
        at, ends = taken(np.cumsum(lengths) - lengths, lengths, codes)
        stops = ends[offsets[1:] + np.arange(len(offsets) - 1)]
        return ids[at], np.diff(stops, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_segments(path: str | None, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path or default_path())
        held, size, seg, start = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, seg, start
            doc_ids, nulls, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": [seg], "start_in_part": [start], "n_docs": [len(counts)], "n_ids": [len(ids)], "segment": pa.array([pack(doc_ids, nulls, counts, ids)], pa.binary())})
            held, size, seg, start = [], 0, seg + 1, start + len(ids)
            return row

        for b in slices(batches, limit=5 << 20):
            ids, counts = enc.texts(b.column("text"), end_id)
            key = b.column("doc_id")
            nulls, doc_ids = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy()
            ends, a = np.cumsum(counts), 0
            while a < len(counts):
                base = ends[a - 1] if a else 0
                z = max(int(np.searchsorted(ends, base + segment_ids - size, side="right")), a + (not held))
                if z > a:
                    held.append((doc_ids[a:z], nulls[a:z], counts[a:z], ids[base : ends[z - 1]]))
                    size += int(ends[z - 1] - base)
                a = z
                if a < len(counts) or size >= segment_ids:
                    yield out()
        if held:
            yield out()
        enc.parts.clear()  # the worker lives on into other stages
        release()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, segment_ids: int = 1 << 19, partitions: int | None = None) -> None:
    """Encodes docs(doc_id, text) and writes the segments, in ascending order of doc_id over `part` and then `seg`.
    The text's hash is the second key, so that rows that share a doc_id can lie in several parts."""
    spark = docs.sparkSession
    ship(spark)
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(partitions or shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    rows.mapInArrow(encode_segments(tokenizer, end_id, segment_ids), SCHEMA).write.option("compression", "zstd").parquet(path)


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, start, base in zip(b.column("segment"), b.column("start_in_part"), b.column("base"), strict=True):
            s = Segment(data.as_py())
            bounds = np.array([0, *map(s.end, range(s.n))], np.int64)
            crc = [zlib.crc32(s.ids[x:y].astype("<u4")) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(map(s.doc_id, range(s.n)), pa.int64()), "start": bounds[:-1] + start.as_py() + base.as_py(), "n_tokens": np.diff(bounds), "ids_crc32": pa.array(crc, pa.int64())})


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments. The sums over parts that the driver adds up
    are one number for each write task."""
    ship(spark)
    segments = spark.read.schema(SCHEMA).parquet(path)
    base, bases = 0, []
    for part, n in sorted(tuple(r) for r in segments.groupBy("part").agg(F.sum("n_ids")).collect()):
        bases.append((part, base))
        base += n
    bases = spark.createDataFrame(bases, "part int, base long")
    return segments.join(F.broadcast(bases), "part").select("segment", "start_in_part", "base").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Writes each segment as a file of its own, one at a time, into a folder of the driver."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for r in spark.read.schema(SCHEMA).parquet(path).select("part", "seg", "segment").toLocalIterator():
        Path(folder, f"{r.part:06d}-{r.seg:06d}.efids").write_bytes(r.segment)
        n += 1
    return n


def token_output(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    path = shared_path(spark, "tokens")
    write(docs, path, **options)
    return read(spark, path)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
