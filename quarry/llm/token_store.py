"""Operator 5: token ids as binary shards with a minimal perfect hash index.

Documents are dealt out by ranges of their key and sorted, so that shard after shard holds them in ascending order.
A shard is nothing but raw little-endian ids (two bytes each where the vocabulary allows it, else four). The index is
split into buckets by key hash. A bucket file holds a minimal perfect hash over its keys: a cascade of bit arrays in
which each key owns one bit of the first array where nothing else hashes to; the rank of that bit is the key's slot,
and the slot stores a fingerprint, the shard, the offset and the length. Every 512 bits carry the rank before them, so that the
lookup of a key reads the head, one such block of each array up to its own and one slot, whatever the size of the corpus, and the stored
fingerprint tells unknown keys apart. Where many keys of a bucket are asked for at once its file is read once instead.

Edge cases: a null text is empty and holds the end id alone; a null key sorts first; rows with the same key stand
next to each other (ordered by a hash of the text, then as they were read), may fill several shards, and get the ordinals 0, 1, ...
under which the index holds each of them; texts of any length are encoded whole; an empty table gives no
shards and an empty result; columns other than the key and the text are not read. A repeated task writes the same bytes over the
same file, through a temporary name.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import SIGNS, BulkEncoder, TwoGenerations, encode_pieces, in_blocks
from quarry.llm.common import arrow_map, fresh_dir, qualified, table, text_of, written

MAGIC = b"QRMPH02\n"
#: Bits of a level for each key that is still without one.
GAMMA = 2.0
#: 64-bit words of a block of the index; a block is led by the rank before it.
BLOCK_WORDS = 8
U64 = np.uint64


# ------------------------------------------------------------------------------------------------ storage


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme, as :func:`qualified` gives it, and the path there."""
    return fs.FileSystem.from_uri(uri)


def _write_file(uri: str, chunks: Iterator[bytes]) -> None:
    """Writes under a name of this attempt, then moves: readers see whole files only."""
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
    if store.get_file_info(path).type != fs.FileType.NotFound:  # by an earlier attempt, with the same bytes
        store.delete_file(path)
    store.move(attempt, path)


# ------------------------------------------------------------------------------------------------ minimal perfect hash


def _mix(h: np.ndarray, step: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key for one level."""
    with np.errstate(over="ignore"):
        x = h + (step | U64(1)) * U64(level * 2 + 1)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class PerfectHash:
    """Slots 0 .. n-1 for n keys, each key given as two 64-bit hashes.

    A level is a matrix of blocks: the number of bits set before the block, on all levels together, and its words.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, h: np.ndarray, step: np.ndarray) -> PerfectHash:
        levels, level, before = [], 0, 0
        while len(h):
            if level > 200:
                raise ValueError("keys repeat: a perfect hash needs different ones")
            blocks = max(1, int(np.ceil(GAMMA * len(h) / (64 * BLOCK_WORDS))))
            bits = 64 * BLOCK_WORDS * blocks
            at = (_mix(h, step, level) % U64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8").reshape(blocks, BLOCK_WORDS)
            inside = np.bitwise_count(words).sum(1).astype(np.int64)
            rank = before + np.cumsum(inside) - inside
            levels.append(np.column_stack([rank.astype("<u8"), words]))
            before += int(inside.sum())
            left = ~alone[at]
            h, step, level = h[left], step[left], level + 1
        return cls(levels)

    @staticmethod
    def within(block: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of blocks (one a row) and places in them: whether the bit is set, and its rank."""
        word, inner = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        own = block[np.arange(len(block)), 1 + word]
        earlier = np.where(np.arange(BLOCK_WORDS)[None] < word[:, None], np.bitwise_count(block[:, 1:]), 0).sum(1)
        below = np.bitwise_count(own & ((U64(1) << inner) - U64(1)))
        return (own >> inner) & U64(1) == 1, block[:, 0].astype(np.int64) + earlier + below

    def slots(self, h: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has a bit for it."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        per = U64(64 * BLOCK_WORDS)
        for level, blocks in enumerate(self.levels):
            if not len(todo):
                break
            at = _mix(h[todo], step[todo], level) % (per * U64(len(blocks)))
            hit, rank = self.within(blocks[(at // per).astype(np.int64)], at % per)
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        return out


ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("start", "<u8"), ("n", "<u4")])


def _fingerprint(step: np.ndarray) -> np.ndarray:
    return (step >> U64(32)).astype(np.uint32)


def _index_bytes(keys: pd.DataFrame) -> bytes:
    """A bucket file: magic, number of levels and keys, blocks of each level; the levels; the entries by slot."""
    h, step = (keys[c].to_numpy(np.int64).view(U64) for c in ("h", "step"))
    mph = PerfectHash.build(h, step)
    entries = np.zeros(len(keys), ENTRY)
    slot = mph.slots(h, step)
    entries["print"][slot] = _fingerprint(step)
    for c in ("shard", "at", "start", "n"):
        entries[c][slot] = keys[c].to_numpy()
    head = MAGIC + struct.pack("<IQ", len(mph.levels), len(keys)) + b"".join(struct.pack("<Q", len(b)) for b in mph.levels)
    return head + b"".join(b.astype("<u8").tobytes() for b in mph.levels) + entries.tobytes()


class IndexBucket:
    """One bucket file. Keys are looked up by reading their blocks and slots alone, or after :meth:`load` in memory."""

    #: Bytes of a block, and of the longest head.
    BLOCK, HEAD = 8 * (1 + BLOCK_WORDS), len(MAGIC) + 12 + 8 * 256

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.reads = file, file.size(), 0
        head = self._read(0, min(self.HEAD, self.size))
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index bucket")
        n_levels, self.n = struct.unpack_from("<IQ", head, len(MAGIC))
        self.blocks = struct.unpack_from(f"<{n_levels}Q", head, len(MAGIC) + 12)
        self.starts = np.cumsum([len(MAGIC) + 12 + 8 * n_levels, *(self.BLOCK * b for b in self.blocks)]).tolist()
        self.whole: tuple[PerfectHash, np.ndarray] | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.reads += 1
        return self.file.read_at(n, at)

    def load(self) -> IndexBucket:
        data = self._read(0, self.size)
        levels = [np.frombuffer(data, "<u8", b * (1 + BLOCK_WORDS), at).reshape(b, -1) for b, at in zip(self.blocks, self.starts, strict=False)]
        self.whole = PerfectHash(levels), np.frombuffer(data, ENTRY, self.n, self.starts[-1])
        return self

    def _one(self, h: np.ndarray, step: np.ndarray) -> np.ndarray | None:
        """The entry of one key by a few reads of fixed size."""
        per = U64(64 * BLOCK_WORDS)
        for level, blocks in enumerate(self.blocks):
            at = _mix(h, step, level) % (per * U64(blocks))
            block = np.frombuffer(self._read(self.starts[level] + self.BLOCK * int(at[0] // per), self.BLOCK), "<u8")[None]
            hit, rank = PerfectHash.within(block, at % per)
            if hit[0]:
                entry = np.frombuffer(self._read(self.starts[-1] + ENTRY.itemsize * int(rank[0]), ENTRY.itemsize), ENTRY)
                return entry if entry["print"][0] == _fingerprint(step)[0] else None
        return None

    def get(self, h: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its entry (any entry where it isn't)."""
        if self.whole is None:
            found = [self._one(h[k : k + 1], step[k : k + 1]) for k in range(len(h))]
            entries = np.concatenate([np.zeros(1, ENTRY) if e is None else e for e in found]) if found else np.zeros(0, ENTRY)
            return np.array([e is not None for e in found], bool), entries
        mph, all_entries = self.whole
        slot = mph.slots(h, step)
        entries = all_entries[np.maximum(slot, 0)] if len(all_entries) else np.zeros(len(h), ENTRY)
        return (slot >= 0) & (entries["print"] == _fingerprint(step)), entries


def _key_hashes(key: str, ordinal: str) -> list[Column]:
    k, n = F.col(key), F.col(ordinal).cast("long")
    return [F.xxhash64(k, k.isNull(), n).alias("h"), F.xxhash64(F.lit("slot"), n, k.isNull(), k).alias("step")]


# ------------------------------------------------------------------------------------------------ writing


class PieceEncoder:
    """Ids of texts as bytes. Pre-tokens of this kind of vocabulary hold no white space and depend on nothing beyond it, so
    a text is encoded as its pieces between blanks and line feeds; the ids of pieces are kept in two generations. New pieces that
    are a Latin word and signs behind it go to the library's model in one call; the whole tokenizer encodes the rest.
    """

    def __init__(self, path: str, width: str, generation: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.width, self.known = width, TwoGenerations(generation)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        # Words go to the model as they are only under normalisation and pre-tokens of this kind.
        self.plain = '"Lowercase"' in steps and '"NFC"' in steps and r"|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in steps
        self.words = BulkEncoder(spec["model"]) if self.plain else None
        self.tails: dict[str, bytes] = {"": b""}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        # Letters below U+0130 are composed already, and each has one lower-case letter.
        latin = [p for p in new if p.isalpha() and (p.isascii() or max(p) < "\u0130")] if self.plain else []
        rest, named, words, tails = [], [], [], []
        for piece in set(new).difference(latin):
            word = piece.rstrip(SIGNS)
            if self.plain and word.isalpha() and (word.isascii() or max(word) < "\u0130"):
                named.append(piece)
                words.append(word.lower())
                tails.append(piece[len(word) :])
            else:
                rest.append(piece)
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        young, of_tail = self.known.young, self.tails
        if unknown := list(set(tails).difference(of_tail)):
            of_tail.update(zip(unknown, self._encode(unknown), strict=True))
        low = list(map(str.lower, latin))
        if different := list({*low, *words}):
            ids = dict(zip(different, self.words(different, self.width), strict=True))
            young.update(zip(latin, map(ids.__getitem__, low), strict=True))
            young.update(zip(named, map(bytes.__add__, map(ids.__getitem__, words), map(of_tail.__getitem__, tails)), strict=True))
        if rest:
            young.update(zip(rest, self._encode(rest), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for block in in_blocks(texts):
            out += encode_pieces([t.replace("\n", " ").split(" ") for t in block], self.known, self.learn)
        return out

    def __call__(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def _encoder(path: str, width: str) -> PieceEncoder:
    """One encoder a worker process and file. What it keeps holds no cycles, so that the collector need not walk it often."""
    if (path, width) not in _ENCODERS:
        gc.set_threshold(200_000, 20, 100)
        _ENCODERS[path, width] = PieceEncoder(path, width)
    return _ENCODERS[path, width]


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", keys_per_bucket: int = 200_000, root: str | None = None) -> dict:
    """Encodes every whole text, writes shards and index, and returns ``{"root", "width", "buckets", "n_ids", "listing"}``.

    ``listing`` is a DataFrame of ``key, ordinal``: what the index can be asked for.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    root = qualified(spark, root) if root else fresh_dir(spark, "token-store")
    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 65536 else "<u4"
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], width).tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = _encoder(tokenizer_path, width), TaskContext.get().partitionId()
        rows: list[pa.RecordBatch] = []

        def chunks() -> Iterator[bytes]:
            at, last, ordinal = 0, None, -1
            for b in batches:
                keys, ordinals = b.column(0).to_pylist(), []
                out = [ids + end for ids in encoder.encode_all(b.column(1).to_pylist())]
                for k in keys:
                    ordinal = ordinal + 1 if ordinal >= 0 and k == last else 0
                    last = k
                    ordinals.append(ordinal)
                sizes = np.array([len(ids) // len(end) for ids in out], np.int64)
                ends = at + np.cumsum(sizes)
                at = int(ends[-1])
                rows.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(ordinals, pa.int64()), pa.array([number] * len(keys), pa.int32()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())], ["key", "ordinal", "shard", "at", "n"]))
                yield b"".join(out)

        first = next(batches, None)
        if first is None:
            return
        source = batches

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from source

        batches = again()
        _write_file(f"{root}/shards/{number:06d}.ids", chunks())
        yield from rows

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Rows of one key are told apart by text and place, so that a key of any size is dealt out over shards.
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    listing = written(ordered.mapInArrow(shard, f"key {kind}, ordinal long, shard int, at long, n long"), "token-listing")
    listing = _numbered(listing)

    # One row a shard: as many as tasks, whatever the number of documents.
    totals = sorted((r["shard"], r["n"]) for r in listing.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    base, n_ids = {}, 0
    for number, n in totals:
        base[number] = n_ids
        n_ids += n
    n_keys = listing.count()
    buckets = max(1, -(-n_keys // keys_per_bucket))
    starts = spark.createDataFrame(list(base.items()) or [(0, 0)], "shard int, base long")
    entries = listing.join(F.broadcast(starts), "shard").select(*_key_hashes("key", "ordinal"), "shard", "at", (F.col("base") + F.col("at")).alias("start"), "n")

    def build(bucket: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        _write_file(f"{root}/index/{int(bucket[0]):06d}.mph", iter([_index_bytes(keys)]))
        return pd.DataFrame({"bucket": [int(bucket[0])], "n": [len(keys)]})

    built = entries.withColumn("bucket", F.pmod("h", F.lit(buckets))).groupBy("bucket").applyInPandas(build, "bucket long, n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    if built != n_keys:
        raise RuntimeError(f"the index holds {built} of {n_keys} keys")
    return {"root": root, "width": width, "buckets": buckets, "n_ids": n_ids, "listing": listing.select(F.col("key").alias(key), "ordinal"), "key": key}


def _numbered(listing: DataFrame) -> DataFrame:
    """The listing with ordinals that go on where a key goes on in the next shard: only the first key of a shard can have begun earlier."""
    firsts = listing.where("at = 0").select(F.col("key").alias("k")).distinct()  # one row a shard at most
    counts = listing.join(F.broadcast(firsts), F.col("key").eqNullSafe(F.col("k"))).groupBy("k", "shard").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = written(counts.select("k", F.col("shard").alias("s"), earlier.alias("before")).where("before > 0"), "ordinals")
    if before.isEmpty():
        return listing
    out = listing.join(F.broadcast(before), F.col("key").eqNullSafe(F.col("k")) & (F.col("shard") == F.col("s")), "left")
    return out.select("key", (F.col("ordinal") + F.coalesce("before", F.lit(0))).alias("ordinal"), "shard", "at", "n")


# ------------------------------------------------------------------------------------------------ reading


def locate(store: dict, keys: DataFrame) -> DataFrame:
    """``key, ordinal, shard, at, start, n`` for the keys (``key, ordinal``) that the index holds; others get no row."""
    root, buckets, key = store["root"], store["buckets"], store["key"]
    kind = keys.schema[key].dataType.simpleString()

    def probe(bucket: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        files, path = _store(f"{root}/index/{int(bucket[0]):06d}.mph")
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return asked.iloc[:0].reindex(columns=["key", "ordinal", "shard", "at", "start", "n"])
        with files.open_input_file(path) as f:
            index = IndexBucket(f)
            if 64 * len(asked) > index.n:
                index.load()
            there, e = index.get(*(asked[c].to_numpy(np.int64).view(U64) for c in ("h", "step")))
        out = asked.loc[there, ["key", "ordinal"]].reset_index(drop=True)
        return out.assign(**{c: e[c][there].astype(np.int64) for c in ("shard", "at", "start", "n")})

    asked = keys.select(F.col(key).alias("key"), F.col("ordinal").cast("long").alias("ordinal"), *_key_hashes(key, "ordinal")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    return asked.groupBy("bucket").applyInPandas(probe, f"key {kind}, ordinal long, shard long, at long, start long, n long").withColumnRenamed("key", key)


def read_store(store: dict, keys: DataFrame, digest: bool = False) -> DataFrame:
    """The ids stored under ``keys``: ``key, ordinal, start, n_tokens`` and ``ids array<int>``, or with ``digest`` their ``ids_crc32``.

    Located keys are dealt out by shard and sorted by offset: each task reads its shard front to back.
    """
    root, width, key = store["root"], np.dtype(store["width"]), store["key"]
    places = locate(store, keys)
    kind = places.schema[key].dataType.simpleString()

    def make():
        opened: dict[int, pa.NativeFile] = {}

        def ids(shard: int, at: int, n: int) -> np.ndarray:
            if shard not in opened:
                for f in opened.values():
                    f.close()
                opened.clear()
                files, path = _store(f"{root}/shards/{shard:06d}.ids")
                opened[shard] = files.open_input_file(path)
            return np.frombuffer(opened[shard].read_at(n * width.itemsize, at * width.itemsize), width)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [ids(*x) for x in zip(*(b.column(c).to_pylist() for c in ("shard", "at", "n")), strict=True)]
            last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([b.column("key"), b.column("ordinal"), b.column("start"), pa.array([len(x) for x in found], pa.int64()), last], ["key", "ordinal", "start", "n_tokens", "out"])

        return each

    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = places.withColumnRenamed(key, "key").repartitionByRange(parts, "shard", "at").sortWithinPartitions("shard", "at")
    out = arrow_map(dealt, make, f"key {kind}, ordinal long, start long, n_tokens long, out {'long' if digest else 'array<int>'}")
    return out.withColumnsRenamed({"key": key, "out": "ids_crc32" if digest else "ids"})


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_store(store, store["listing"], digest=True).drop("ordinal")
