"""Token ids in files of static range asymmetric numeral systems (rANS).

Documents are ordered by id into contiguous shards, each a row group of frames. A frame holds some million ids:
a frequency table that all its blocks share, and blocks that are coded independently, each by ``LANES`` interleaved
states; a directory gives every block's place, size and checksum, so blocks can be decoded alone, in parallel, or
checked without the others. Block b holds the ids from b * ``BLOCK`` on: its begin is the checkpoint from which decoding
can start, and there is none inside a block. Frames are rows of a Parquet file (shard, frame, first, last, n_docs, n_ids, data).

Frame, little-endian: magic, u32 counts (docs, ids, symbols, blocks), symbols u32[], frequencies u32[], ids of the
documents i64[], their lengths u32[], directory of the blocks (place u32[], bytes u32[], crc32 u32[]), the blocks: 64-bit
end states of the lanes, then 32-bit words.

Defined results: a null or empty text is the end id alone; rows without an id are left out; rows with the same id
follow each other, by text; an empty table gives no files' rows and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import slices
from .shared import parts, shared_dir
from .tokens import definition, encoder

MAGIC = b"RNS1"
SCALE, LANES, BLOCK, FRAME = 18, 128, 1 << 16, 1 << 21
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
FILE = "shard int, frame int, first long, last long, n_docs long, n_ids long, data binary"


def frequencies(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts scaled to the sum 2**SCALE, none under 1."""
    total, most = int(counts.sum()), 1 << SCALE
    if len(symbols) > most:
        raise ValueError("more symbols in a frame than the table has places")
    out = np.maximum(1, counts * most // max(total, 1)).astype(np.int64)
    gap = most - int(out.sum())
    order = np.argsort(-counts, kind="stable")
    if gap > 0:
        out[order[0]] += gap
    for i in order if gap < 0 else ():
        take = min(int(out[i]) - 1, -gap)
        out[i] -= take
        gap += take
        if not gap:
            break
    return out.astype(np.uint32)


def encode_blocks(ids: np.ndarray, freq: np.ndarray, low: np.ndarray, place: np.ndarray) -> list[bytes]:
    """The blocks of a frame, all lanes of all blocks advanced together. place: of each id in the table."""
    n_blocks = -(-len(ids) // BLOCK)
    f, c = np.ones((n_blocks, BLOCK), np.uint64), np.zeros((n_blocks, BLOCK), np.uint64)
    f.ravel()[: len(ids)], c.ravel()[: len(ids)] = freq[place], low[place]
    size = np.minimum(BLOCK, len(ids) - np.arange(n_blocks) * BLOCK)
    f, c = f.reshape(n_blocks, -1, LANES), c.reshape(n_blocks, -1, LANES)
    x = np.full((n_blocks, LANES), LOW, np.uint64)
    step_at = np.arange(LANES)
    words, owner = [], []
    for step in range(int(-(-size.max() // LANES)) - 1, -1, -1):
        live = step * LANES + step_at[None, :] < size[:, None]
        fs, cs = f[:, step], c[:, step]
        full = live & (x >= (fs << np.uint64(63 - SCALE)))
        if full.any():
            # lanes are read in ascending order, and everything is read backwards
            b, lane = np.nonzero(full)
            words.append((x[b, lane] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
            owner.append(b[::-1])
            x[b, lane] >>= WORD
        q = x // fs
        x = np.where(live, (q << np.uint64(SCALE)) + (x - q * fs) + cs, x)
    word, own = (np.concatenate(words), np.concatenate(owner)) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    word, own = word[::-1], own[::-1]
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(n_blocks + 1))
    word = word[order].astype("<u4")
    return [x[b].astype("<u8").tobytes() + word[edges[b] : edges[b + 1]].tobytes() for b in range(n_blocks)]


def decode_blocks(blocks: list[bytes], sizes: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The ids of blocks of the given sizes."""
    low = np.concatenate([[0], np.cumsum(freq.astype(np.int64))])
    slot = np.repeat(np.arange(len(freq)), freq)
    freq, low = freq.astype(np.uint64), low.astype(np.uint64)
    n = len(blocks)
    x = np.stack([np.frombuffer(b, "<u8", LANES) for b in blocks]).astype(np.uint64)
    words = np.concatenate([np.frombuffer(b, "<u4", offset=8 * LANES) for b in blocks] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([(len(b) - 8 * LANES) // 4 for b in blocks])])[:-1]
    steps = int(-(-sizes.max() // LANES))
    out = np.zeros((n, steps, LANES), np.uint32)
    lane, mask = np.arange(LANES), np.uint64((1 << SCALE) - 1)
    for step in range(steps):
        live = step * LANES + lane[None, :] < sizes[:, None]
        got = x & mask
        s = slot[got.astype(np.int64)]
        out[:, step] = symbols[s]
        x = np.where(live, freq[s] * (x >> np.uint64(SCALE)) + got - low[s], x)
        need = live & (x < LOW)
        rank = np.cumsum(need, axis=1)
        b, k = np.nonzero(need)
        x[b, k] = (x[b, k] << WORD) | words[at[b] + rank[b, k] - 1]
        at = at + rank[:, -1]
    return np.concatenate([out[i].ravel()[: sizes[i]] for i in range(n)]) if n else np.zeros(0, np.uint32)


def pack(doc_ids: list[int], texts: list[bytes]) -> bytes:
    """A frame of the documents' ids (each as bytes of u32)."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    every = np.bincount(ids)
    symbols = np.flatnonzero(every).astype(np.uint32)
    counts, place = every[symbols], np.zeros(len(every), np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    place = place[ids]
    freq = frequencies(symbols, counts)
    low = np.concatenate([[0], np.cumsum(freq.astype(np.uint64))[:-1]]).astype(np.uint64)
    blocks = encode_blocks(ids, freq.astype(np.uint64), low, place)
    size = np.array([len(b) for b in blocks], "<u4")
    parts = [MAGIC, struct.pack("<4I", len(doc_ids), len(ids), len(symbols), len(blocks)), symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array([len(t) // 4 for t in texts], "<u4").tobytes()]
    parts += [np.concatenate([[0], np.cumsum(size)[:-1]]).astype("<u4").tobytes(), size.tobytes(), np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes(), *blocks]
    return b"".join(parts)


def unpack(data: bytes, only: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a frame; with ``only``, the ids of those blocks. A wrong checksum raises."""
    if data[:4] != MAGIC:
        raise ValueError("not a frame")
    n_docs, n_ids, n_symbols, n_blocks = struct.unpack_from("<4I", data, 4)
    at = 20
    got = []
    for kind, n in (("<u4", n_symbols), ("<u4", n_symbols), ("<i8", n_docs), ("<u4", n_docs), ("<u4", n_blocks), ("<u4", n_blocks), ("<u4", n_blocks)):
        got.append(np.frombuffer(data, kind, n, at))
        at += got[-1].nbytes
    symbols, freq, docs, lengths, place, size, crc = got
    chosen = list(range(n_blocks)) if only is None else only
    blocks = [data[at + int(place[b]) : at + int(place[b]) + int(size[b])] for b in chosen]
    for b, block in zip(chosen, blocks):
        if zlib.crc32(block) != int(crc[b]):
            raise ValueError(f"block {b} is damaged")
    sizes = np.array([min(BLOCK, n_ids - b * BLOCK) for b in chosen], np.int64)
    return docs, lengths, decode_blocks(blocks, sizes, symbols, freq) if blocks else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> None:
    """Encode every text, add ``end_id``, and write frames in ascending order of ids. tokenizer: path of a tokenizer's JSON."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(definition(tokenizer))
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, frame = encoder(spec.value), TaskContext.get().partitionId(), 0
        held: tuple[list, list] = ([], [])
        size = 0

        def flush() -> pa.RecordBatch:
            row = (shard, frame, held[0][0], held[0][-1], len(held[0]), size, pack(*held))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "frame", "first", "last", "n_docs", "n_ids", "data"])

        for b in slices(batches, most=4 << 20, keep="tokens"):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                held[0].append(doc_id)
                held[1].append(ids + tail)
                size += len(held[1][-1]) // 4
                if size >= FRAME:
                    yield flush()
                    held, size, frame = ([], []), 0, frame + 1
        if held[0]:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    ordered = rows.repartitionByRange(parts(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document, decoded from the files: (doc_id, start, n_tokens, ids_crc32[, ids])."""
    files = spark.read.schema(FILE).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, frame, data in zip(b.column("shard").to_pylist(), b.column("frame").to_pylist(), b.column("data")):
                docs, lengths, ids = unpack(data.as_buffer().to_pybytes())
                end = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                texts = [raw[4 * (e - n) : 4 * e] for e, n in zip(end.tolist(), lengths.tolist())]
                cols = [pa.array([shard] * len(docs), pa.int32()), pa.array([frame] * len(docs), pa.int32()), pa.array(docs), pa.array(end - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                names = ["shard", "frame", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(t, "<u4").astype(np.int64) for t in texts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = files.select("shard", "frame", "data").mapInArrow(run, "shard int, frame int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # where frames begin: shards first, then frames inside their shard, so that no window sees more rows than there are shards
    sizes = files.groupBy("shard", "frame").agg(F.sum("n_ids").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    frames = sizes.select("shard", "frame", (F.sum("n").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n")).alias("within"))
    place = frames.join(before, "shard").select("shard", "frame", (F.col("before") + F.col("within")).alias("at"))
    return rows.join(place, ["shard", "frame"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, **options: object) -> DataFrame:
    """Write the documents' ids and read them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/tables/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, **options)
    return read_ids(docs.sparkSession, path)
