"""Token-ID / binary output: token ids in independent blocks of an interleaved static range asymmetric numeral system.

A block holds whole documents in ascending id order. Its bytes, all numbers little-endian:
header ``<8sIIIIQII``: magic, lanes, checkpoint every so many steps, checkpoints, documents, ids, words of the stream, crc32 of the ids;
then int64 ids of documents (least value: null), uint32 lengths, the lanes' final uint64 states, for each checkpoint a
uint64 place in the stream and the lanes' states, the uint32 stream, and the crc32 of everything before.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.session import bounded_batches, fresh_path, written

MAGIC = b"TRKRANS1"
_HEAD = struct.Struct("<8sIIIIQII")
SCALE = 20
LOW = 1 << 31
BLOCK_IDS = 1 << 21
LANES = 8192
CHECK_STEPS = 64
NULL_ID = -(1 << 63)
END_ID = 2
#: The tokenizer's own pattern, for all alphabets, that _CUT stands for on the plain one (fixed pattern of the format).
_CUT_ALIKE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a task remembers, in each of two generations.
WORDS = 800_000

#: A character outside the plain alphabet: blanks, ASCII, and letters whose normal form is themselves, whose lower case one letter.
_ODD = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: How the tokenizer cuts a lowered plain text (fixed pattern of the format, for this alphabet).
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


#: How byte-level models write bytes as characters: printable ones as themselves, the others from 256 on (fixed rule of the format).
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _SHOWN else 256 + i - sum(s < b for s in _SHOWN) for i, b in enumerate(range(256))}


class Words(dict):
    """Ids of words by the library's model, each asked for once; a full generation ages, what is used again moves to the new one."""

    def __init__(self, tokenizer, kind: np.dtype) -> None:
        self.model, self.code, self.old = tokenizer.model, kind.char, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
            ids = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > WORDS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts by a tokenizers file, those of the whole text.

    The tokenizer lowers texts, drops white space and cuts them into words, digits and runs of marks before it encodes each
    on its own. Plain texts are cut the same way here, and the ids of each part are asked for once; any other text
    goes to the library whole.
    """

    def __init__(self, file: str, reuse: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.reuse = reuse and _CUT_ALIKE in str(self.tokenizer.pre_tokenizer)  # any other tokenizer gets whole texts
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.words = Words(self.tokenizer, self.kind)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian numbers of self.kind; null and empty texts have none."""
        self.words.age()
        get, out = self.words.__getitem__, []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.reuse and "<|" not in t and not _ODD.search(t):
                out.append(b"".join(map(get, _CUT.findall(t.lower()))))
            else:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind).tobytes())
        return out


@lru_cache(2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


class Tables:
    """Frequencies that sum to 2**SCALE, at least 1 each, so that every id can be coded; bounded by the vocabulary."""

    def __init__(self, counts: np.ndarray) -> None:
        """Counts that already sum to 2**SCALE without a zero are the frequencies themselves."""
        total, n = int(counts.sum()), len(counts)
        f = np.asarray(counts, np.int64)
        if total != 1 << SCALE or not f.all():
            room = (1 << SCALE) - n
            f = 1 + (np.array([int(c) * room // max(1, total) for c in counts], np.int64) if total else np.zeros(n, np.int64))
            f[int(np.argmax(f))] += (1 << SCALE) - int(f.sum())
        self.f = f.astype(np.uint64)
        self.c = (np.cumsum(f) - f).astype(np.uint64)
        self.limit = self.f << np.uint64(63 - SCALE)
        self.symbol = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.uint32), f)


def encode_block(ids: np.ndarray, tables: Tables, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The block of the documents' ids. Lane j codes ids j, j + lanes, ...; a step codes one id of every lane."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    k, low32, half = np.uint64(SCALE), np.uint64(0xFFFFFFFF), np.uint64(32)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []  # words still to come when the decoder stands before a step, and its states
    sent = 0
    place = ids.astype(np.intp)
    freq, start, limit = tables.f[place], tables.c[place], tables.limit[place]
    for t in range(steps - 1, -1, -1):
        at = slice(t * lanes, min((t + 1) * lanes, n))
        y = x[: at.stop - at.start]
        over = y >= limit[at]
        if over.any():
            words.append((y[over] & low32).astype("<u4"))
            sent += len(words[-1])
            y = np.where(over, y >> half, y)
        q = y // freq[at]
        x[: len(y)] = (q << k) + (y - q * freq[at]) + start[at]
        if t and t % CHECK_STEPS == 0:
            marks.append((sent, x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks = [(sent - left, state) for left, state in reversed(marks)]
    head = _HEAD.pack(MAGIC, lanes, CHECK_STEPS, len(marks), len(lengths), n, len(stream), zlib.crc32(ids.astype("<u4")))
    body = [head, np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), x.astype("<u8").tobytes()]
    body += [struct.pack("<Q", at) + state for at, state in marks] + [stream.tobytes()]
    raw = b"".join(body)
    return raw + struct.pack("<I", zlib.crc32(raw))


class Block:
    """A block read back; damage raises ValueError."""

    def __init__(self, raw: bytes) -> None:
        if len(raw) < _HEAD.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        magic, self.lanes, self.every, n_marks, n_docs, self.n, n_words, self.crc = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = _HEAD.size
        self.doc_ids = [None if d == NULL_ID else d for d in np.frombuffer(raw, "<i8", n_docs, at).tolist()]
        self.lengths = np.frombuffer(raw, "<u4", n_docs, at + 8 * n_docs)
        at += 12 * n_docs
        self.marks = [(0, np.frombuffer(raw, "<u8", self.lanes, at))]
        at += 8 * self.lanes
        for _ in range(n_marks):
            self.marks.append((struct.unpack_from("<Q", raw, at)[0], np.frombuffer(raw, "<u8", self.lanes, at + 8)))
            at += 8 + 8 * self.lanes
        self.stream = np.frombuffer(raw, "<u4", n_words, at)

    def section(self, i: int, tables: Tables) -> np.ndarray:
        """Ids from checkpoint i to the next one: sections can be decoded in parallel."""
        place, state = self.marks[i]
        x = state.copy()
        first = i * self.every
        steps = -(-self.n // self.lanes)
        last = min(first + self.every, steps) if self.lanes else 0
        out = np.empty(max(0, min(last * self.lanes, self.n) - first * self.lanes), np.uint32)
        k, mask, low, half = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(LOW), np.uint64(32)
        for t in range(first, last):
            m = min(self.lanes, self.n - t * self.lanes)
            y = x[:m]
            slot = y & mask
            s = tables.symbol[slot]
            y = tables.f[s] * (y >> k) + slot - tables.c[s]
            need = y < low
            c = int(need.sum())
            if c:
                y[need] = (y[need] << half) | self.stream[place : place + c].astype(np.uint64)
                place += c
            x[:m] = y
            out[(t - first) * self.lanes : (t - first) * self.lanes + m] = s
        return out

    def some_ids(self, tables: Tables, first: int, last: int) -> np.ndarray:
        """Ids number first to last - 1 of the block: only the sections that hold them are decoded."""
        first, last, size = max(0, first), min(last, self.n), self.every * self.lanes
        if first >= last:
            return np.zeros(0, np.uint32)
        held = [self.section(i, tables) for i in range(first // size, (last - 1) // size + 1)]
        return np.concatenate(held)[first - first // size * size :][: last - first]

    def ids(self, tables: Tables) -> np.ndarray:
        out = np.concatenate([self.section(i, tables) for i in range(len(self.marks))]) if self.n else np.zeros(0, np.uint32)
        if zlib.crc32(out.astype("<u4", copy=False)) != self.crc:
            raise ValueError("ids do not match their checksum")
        return out


def sorted_ids(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """part, doc_id, local_start, n_tokens, ids in ascending doc_id order over parts and rows, and each part's id counts; written.

    Nulls and empty texts have no ids but the end id. A null doc_id stands first. Rows with one doc_id stand in the order of
    their texts' hashes. The last row of a part holds its counts (int64 by id) and no ids: it is no document.
    """
    bounded_batches(docs.sparkSession, 512)
    schema = "part int, doc_id long, local_start long, n_tokens long, ids binary, counts binary"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, encode_texts, part = 0, encoder(tokenizer_file), None
        kind = encode_texts.kind
        counts = np.zeros(vocabulary(tokenizer_file, end_id), np.int64)
        tail = b"" if end_id is None else np.array([end_id], kind).tobytes()
        for b in batches:
            ids = [x + tail for x in encode_texts(b["text"].tolist())]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize
            counts += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(counts))
            yield pd.DataFrame({"part": b["part"], "doc_id": b["doc_id"].astype("Int64"), "local_start": start + np.cumsum(n) - n, "n_tokens": n, "ids": ids, "counts": None})
            start += int(n.sum())
            part = b["part"].iloc[-1] if len(b) else part
        if part is not None:
            yield pd.DataFrame({"part": [part], "doc_id": pd.array([None], "Int64"), "local_start": [start], "n_tokens": [0], "ids": [None], "counts": [counts.tobytes()]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(rows.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInPandas(encode, schema), "ids")


def vocabulary(tokenizer_file: str, end_id: int | None) -> int:
    return max(encoder(tokenizer_file).size, (-1 if end_id is None else end_id) + 1)


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id over all documents: the parts' counts, summed by id; the result is bounded by the vocabulary."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for raw in b["counts"]:
                total += np.frombuffer(raw, np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    out = np.zeros(size, np.int64)
    for r in ids.where("counts is not null").select("counts").mapInPandas(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_blocks(docs: DataFrame, tokenizer_file: str, path: str, end_id: int | None = END_ID, **columns) -> None:
    """Write docs' ids under path: all that a reader needs.

    path/blocks is a Parquet folder of (part, start, n_ids, block): start is the number of ids before the block in the whole
    output, so a reader can seek. Blocks hold whole documents and about BLOCK_IDS ids; each can be read alone. path/tables is
    one row: the scale, the shared frequencies (int32 by id) and their crc32. Empty docs: no blocks.
    """
    ids = sorted_ids(docs, tokenizer_file, end_id=end_id, **columns)
    tables = Tables(id_counts(ids, vocabulary(tokenizer_file, end_id)))
    raw = tables.f.astype("<i4").tobytes()
    docs.sparkSession.createDataFrame([(SCALE, raw, zlib.crc32(raw))], "scale int, frequencies binary, crc32 long").write.parquet(f"{path}/tables")
    kind = encoder(tokenizer_file).kind
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    # one row per part: at most as many as the shuffle had partitions
    sums = ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, offsets = 0, {}
    for r in sums:
        offsets[r["part"]] = before
        before += r["n"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, start, expect, held, names, n = None, 0, -1, [], [], 0

        def block() -> pd.DataFrame:
            values = np.frombuffer(b"".join(held), kind)
            raw = encode_block(values, shared.value, names, [len(h) // kind.itemsize for h in held])
            return pd.DataFrame({"part": [part], "start": [offsets[part] + start], "n_ids": [len(values)], "block": [raw]})

        for b in batches:
            for p, d, s, m, x in zip(b["part"].tolist(), b["doc_id"].astype("Int64").tolist(), b["local_start"].tolist(), b["n_tokens"].tolist(), b["ids"], strict=True):
                if held and (p != part or s != expect or n + m > BLOCK_IDS):
                    yield block()
                    held, names, n = [], [], 0
                if not held:
                    part, start = p, s
                held.append(x)
                names.append(None if d is pd.NA else d)
                n += m
                expect = s + m
        if held:
            yield block()

    docs_only = ids.where("ids is not null").select("part", "doc_id", "local_start", "n_tokens", "ids")
    docs_only.mapInPandas(pack, "part int, start long, n_ids long, block binary").write.parquet(f"{path}/blocks")


def read_tables(spark, path: str) -> Tables:
    """The shared frequencies of a folder; bounded by the vocabulary. Damage raises ValueError."""
    row = spark.read.parquet(f"{path}/tables").first()
    if row["scale"] != SCALE or zlib.crc32(row["frequencies"]) != row["crc32"]:
        raise ValueError("damaged frequency table")
    return Tables(np.frombuffer(row["frequencies"], "<i4").astype(np.int64))


def read_range(spark, path: str, first: int, last: int) -> DataFrame:
    """The ids number first to last - 1 of the whole output as (at long, id int): only the blocks and sections that hold them are decoded."""
    shared = spark.sparkContext.broadcast(read_tables(spark, path))
    bounded_batches(spark, 1)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, raw in zip(b["start"].tolist(), b["block"], strict=True):
                ids = Block(raw).some_ids(shared.value, first - start, last - start)
                yield pd.DataFrame({"at": max(first, start) + np.arange(len(ids)), "id": ids.astype(np.int32)})

    held = spark.read.parquet(f"{path}/blocks").where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
    return held.select("start", "block").mapInPandas(unpack, "at long, id int")


def read_blocks(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the blocks of a folder in parallel: doc_id, start (ids before the document), n_tokens, ids_crc32 (unsigned), ids (array of int).

    Everything is read from the folder, so any session can. Without with_ids the ids are decoded and digested all the same,
    but not handed on.
    """
    shared = spark.sparkContext.broadcast(read_tables(spark, path))
    bounded_batches(spark)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, raw in zip(b["start"].tolist(), b["block"], strict=True):
                block = Block(raw)
                ids = block.ids(shared.value)
                ends = np.cumsum(block.lengths, dtype=np.int64)
                begins = ends - block.lengths
                parts = [ids[a:z] for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(block.doc_ids, "Int64"), "start": start + begins, "n_tokens": ends - begins, "ids_crc32": [zlib.crc32(p) for p in parts]})
                yield out.assign(ids=[p.astype(np.int32) for p in parts]) if with_ids else out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.parquet(f"{path}/blocks").select("start", "block").mapInPandas(unpack, schema)


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int | None = END_ID, with_ids: bool = True, **columns) -> DataFrame:
    """Write docs' ids under the shared folder and read them back, see write_blocks() and read_blocks()."""
    path = fresh_path(docs.sparkSession, "rans")
    write_blocks(docs, tokenizer_file, path, end_id, **columns)
    return read_blocks(docs.sparkSession, path, with_ids)
