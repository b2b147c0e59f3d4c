"""Token ids as length-delimited binary records with an offset index.

A shard ``part-N.rec`` holds records in ascending (doc_id, text hash, text) order, nulls
first; shards follow each other in that order.  A record is

    length  unsigned 64-bit, bytes of the payload
    check   unsigned 32-bit, masked crc32 of the eight length bytes
    payload flag byte (1: has an id; 2: ids are 16 bits wide), doc_id (8 bytes), ids
    check   unsigned 32-bit, masked crc32 of the payload

all little-endian; the mask is TFRecord's rotation by 15 bits plus a constant.  The index
``part-N.idx`` holds (offset, number of ids) of each record as two unsigned 64-bit
integers, so a reader can fetch records in any order.  A task writes to a name of its own
and moves the finished file, so a retried task leaves one whole shard.

Defined cases: null and empty texts hold the end id alone; repeated rows give one record
each; an empty table gives no shard; a damaged length or payload raises.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlens.llm import shared
from reviewlens.llm import textbatch as tb
from reviewlens.llm.units import Store, take

END_ID = 2
READ_BYTES = 8 << 20
UNITS = 600_000  # kept by a worker; fewer are encoded over again
WRITE_BYTES = 4 << 20
JOINED = 256
HAS_ID, NARROW = 1, 2


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def payload_of(doc_id: int | None, ids: np.ndarray, narrow: bool) -> bytes:
    flag = HAS_ID * (doc_id is not None) | NARROW * narrow
    return struct.pack("<Bq", flag, doc_id or 0) + ids.astype("<u2" if narrow else "<u4").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    flag, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u2" if flag & NARROW else "<u4", offset=9).astype("<u4")
    return doc_id if flag & HAS_ID else None, ids


def unframe(read) -> bytes | None:
    """Next record from ``read(n)``; None at the end of the file."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record payload")
    return body[:size]


@lru_cache(maxsize=2)
def _tokens(path: str) -> tuple[Store, bool]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    vocabulary = tokenizer.get_vocab()
    width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: a character stands for a byte
    for token, i in vocabulary.items():
        width[i] = len(token)

    def library(texts):
        found = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def encode(units):
        """Units that start with a blank go to the library as runs of JOINED, cut again by their bytes."""
        blank = np.array([u[0] == " " and not u[-1].isspace() for u in units], bool)
        order = np.concatenate([np.flatnonzero(blank), np.flatnonzero(~blank)])
        spaced = [units[i] for i in order[:blank.sum()]]
        ids, _ = library(["".join(spaced[k:k + JOINED]) for k in range(0, len(spaced), JOINED)])
        ends = np.cumsum(pc.binary_length(pa.array(spaced, pa.large_string())).to_numpy())
        cut = np.searchsorted(np.cumsum(width[ids]), ends, side="left") + 1
        rest, rest_sizes = library([units[i] for i in order[blank.sum():]])
        sizes = np.concatenate([np.diff(cut, prepend=0), rest_sizes])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[np.argsort(order)]
        sizes = sizes[np.argsort(order)]
        return take(np.concatenate([ids, rest]), at, at + sizes)[0], sizes

    return Store(encode, UNITS), max(tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16


def write_records(docs: DataFrame, path: str, folder: str, text: str = "text") -> DataFrame:
    """Write the shards; returns the manifest (shard, n_docs, n_ids), one row per shard."""
    spark = docs.sparkSession
    order = ["doc_id", "text_hash", "text"]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
            .withColumn("text_hash", F.xxhash64("text"))
            .repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order))

    def write(batches):
        store, narrow = _tokens(path)
        shard = TaskContext.get().partitionId()
        system, root = shared.opened(folder)
        system.create_dir(root, recursive=True)
        draft = f"{root}/draft-{shard}-{uuid.uuid4().hex}"
        n_docs = n_ids = offset = 0
        with system.open_output_stream(f"{draft}.rec") as out, system.open_output_stream(f"{draft}.idx") as index:
            for batch in batches:
                for part in tb.chunks(batch, "text", WRITE_BYTES):
                    ids, bounds = store.tokens([t or "" for t in part.column("text").to_pylist()])
                    for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                        own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(END_ID))
                        record = frame(payload_of(doc_id, own, narrow))
                        out.write(record)
                        index.write(struct.pack("<QQ", offset, len(own)))
                        offset += len(record)
                        n_docs += 1
                        n_ids += len(own)
        for kind in ("rec", "idx"):
            system.move(f"{draft}.{kind}", f"{root}/part-{shard:05d}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids]})

    manifest = rows.select("doc_id", "text").mapInArrow(write, "shard long, n_docs long, n_ids long")
    return shared.written(manifest, "records-manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record: shard, place in the shard, doc_id, ids (packed 32-bit), local_start."""
    shards = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        system, root = shared.opened(folder)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                rows, held, start, place = [], 0, 0, 0
                with system.open_input_stream(f"{root}/part-{shard:05d}.rec") as file:
                    while (payload := unframe(file.read)) is not None:
                        doc_id, ids = parse(payload)
                        rows.append((shard, place, doc_id, ids.tobytes(), start))
                        place, start, held = place + 1, start + len(ids), held + 4 * len(ids)
                        if held >= READ_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return manifest.select("shard").repartitionByRange(shards, "shard").mapInArrow(read, _READ)


_READ = "shard long, place long, doc_id long, ids binary, local_start long"
_ARROW = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()),
                    ("ids", pa.binary()), ("local_start", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def with_starts(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all records before.  The window runs over one row per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_before"))
    return (records.join(F.broadcast(offsets), "shard")
            .withColumn("start", F.col("_before") + F.col("local_start")).drop("_before", "local_start"))


def read_shuffled(spark: SparkSession, manifest: DataFrame, folder: str, seed: int = 0) -> DataFrame:
    """Records in a shuffled order: every index entry is dealt out by a hash, and each task
    fetches its records by their offsets."""
    def entries(batches):
        system, root = shared.opened(folder)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with system.open_input_file(f"{root}/part-{shard:05d}.idx") as file:
                    index = np.frombuffer(file.read(), "<u8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"shard": [shard] * len(index), "offset": index[:, 0].astype("i8")})

    def fetch(batches):
        system, root = shared.opened(folder)
        files: dict = {}
        for batch in batches:
            rows, held = [], 0
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist()):
                if shard not in files:
                    files[shard] = system.open_input_file(f"{root}/part-{shard:05d}.rec")
                files[shard].seek(offset)
                doc_id, ids = parse(unframe(files[shard].read))
                rows.append((shard, offset, doc_id, ids.tobytes(), 0))
                held += 4 * len(ids)
                if held >= READ_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64(F.lit(seed), "shard", "offset")
    listed = manifest.select("shard").mapInArrow(entries, "shard long, offset long")
    return (listed.withColumn("_order", order).repartition(n, "_order").sortWithinPartitions("_order")
            .select("shard", "offset").mapInArrow(fetch, _READ).select("doc_id", "ids"))


def crc32_long(column):
    """crc32 of a binary column as a non-negative long."""
    return F.crc32(column).cast("long")
