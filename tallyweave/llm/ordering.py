"""Token sequences in training order: a keyed Feistel permutation of slots, written as fixed-stride shards."""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import Staging, partitions
from .similarity import mixed

#: Fixed value: the public pattern by which byte-level vocabularies of this kind cut text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_FILE_BYTES = 64 << 20
_ROUNDS = 6
#: Up to so many input splits their first numbers are broadcast; beyond it they are joined.
_SPLITS = 200_000


def feistel_slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each index below ``n`` under a keyed bijection of 0..n-1.

    A balanced Feistel network permutes the smallest even number of bits that
    holds n - 1; a value that falls outside is sent through again until it is
    inside (cycle-walking), which keeps the map a bijection.
    """
    bits = max(2, int(n - 1).bit_length() if n > 1 else 1)
    half = np.uint64((bits + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = x = left << half | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=table, special_tokens={}), max(table.values()) + 1


_LOADED: dict[str, tuple] = {}


def packed_sequences(docs: DataFrame, ranks_path: str, length: int) -> DataFrame:
    """tokens (little-endian uint16), pieces (doc_id, piece_no, at, n_tokens), and (file, start, part, local), the place in reading order.

    Every whole text is encoded and closed by the end token (the first free
    id); null and empty texts give the end token alone. The texts of an input
    split stand one after the other and are cut into sequences of ``length``
    tokens; only a split's last sequence is shorter. ``pieces`` tells which
    document stands where in a sequence.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read(MAX_FILE_BYTES + 1)
    if len(ranks) > MAX_FILE_BYTES:
        raise ValueError(f"{ranks_path} is larger than {MAX_FILE_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(ranks).hexdigest()
    piece = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("at", pa.int32()), ("n_tokens", pa.int32())]))
    kinds = {"tokens": pa.binary(), "pieces": piece, "file": pa.string(), "start": pa.int64(), "part": pa.int32(), "local": pa.int64()}

    def run(batches):
        if name not in _LOADED:
            _LOADED[name] = _encoding(shared.value)
        encoding, end = _LOADED[name]
        if end >= 1 << 16:
            raise ValueError("token ids need more than 16 bits")
        out, place, local, ids, pieces = {c: [] for c in kinds}, None, 0, array("H"), []

        def cut(n):
            nonlocal ids, pieces, local
            for c, v in zip(out.values(), (np.asarray(ids[:n], "<u2").tobytes(), pieces, *place, local), strict=True):
                c.append(v)
            ids, pieces, local = ids[n:], [], local + 1

        def given():
            batch = pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in out.items()], names=list(kinds))
            for v in out.values():
                v.clear()
            return batch

        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                for doc_id, text, *now in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "file", "start", "part")), strict=True):
                    if now != place:
                        if ids:
                            cut(len(ids))
                        place, local = now, 0
                    new, number, done = array("H", [*encoding.encode_ordinary(text or ""), end]), 0, 0
                    while done < len(new):
                        fits = new[done : done + length - len(ids)]
                        pieces.append({"doc_id": doc_id, "piece_no": number, "at": len(ids), "n_tokens": len(fits)})
                        ids, done, number = ids + fits, done + len(fits), number + 1
                        if len(ids) == length:
                            cut(length)
                yield given()
        if ids:
            cut(len(ids))
        yield given()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.input_file_name().alias("file"), F.input_file_block_start().cast("long").alias("start"), F.spark_partition_id().alias("part")
    )
    return rows.mapInArrow(run, "tokens binary, pieces array<struct<doc_id:long,piece_no:int,at:int,n_tokens:int>>, file string, start long, part int, local long")


def training_order(
    docs: DataFrame, ranks_path: str, path: str, *, length: int = 512, shard_sequences: int = 8_192, key: int = 20_240_601, pad: int = 65_535, staging: Staging | None = None
) -> DataFrame:
    """Write the shards below ``path`` now; the rows that come back tell where each piece of each document stands.

    doc_id, piece_no, slot, shard, byte_offset, n_tokens: a document is its
    pieces in the order of their numbers. Sequences of ``length`` tokens are
    numbered in the order of the files that ``docs`` is read from (rows that
    come from no file: in the order of the partitions, so a rerun repeats the
    order only if it deals them alike). Each gets the slot of its number under
    the keyed permutation, and tasks of shard ranges write
    ``shard-NNNNNNNN.bin``: slot s stands at byte (s mod shard_sequences) * 2 *
    length of shard s div shard_sequences, so any stretch of the order is one
    sequential read and a run resumes from a slot number. The last sequence of
    an input split is filled with ``pad``. A shard is written under a name of
    the task's attempt and then renamed, so retried and speculative tasks
    leave it whole.

    Null ids stay null; repeated rows are documents of their own; texts of any
    length are written whole; no rows give no shards.
    """
    spark = docs.sparkSession
    staging = staging or Staging(spark, "order")
    rows = staging.save(packed_sequences(docs, ranks_path, length), "sequences", compression="zstd", level=5)
    group = ["file", "start", "part"]
    counts = staging.save(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.sum("n").over(W.orderBy(*group).rowsBetween(W.unboundedPreceding, -1))  # a row per input split
    firsts = counts.withColumn("first", F.coalesce(before, F.lit(0))).drop("n")
    splits, n = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if splits <= _SPLITS:
        firsts = F.broadcast(firsts)
    shards = max(1, -(-n // shard_sequences))
    tasks = min(partitions(spark), shards)
    # a compression dictionary from a bounded sample: short sequences hardly compress by themselves
    some = [r["tokens"] for r in rows.where(F.xxhash64("file", "start", "part", "local") % max(1, n // 4_000) == 0).select("tokens").limit(6_000).collect()]
    try:
        common = zstandard.train_dictionary(1 << 16, some).as_bytes()
    except zstandard.ZstdError:  # too few
        common = b"".join(some[:8])
    shared = spark.sparkContext.broadcast(common)
    pieces = "array<struct<doc_id:long,piece_no:int,at:int,n_tokens:int>>"

    def places(batches):
        for batch in batches:
            slot = feistel_slots(batch.column("index").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([batch.column("pieces"), pa.array(slot)], names=["pieces", "slot"])

    def slots(batches):
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(shared.value))
        for batch in batches:
            slot = feistel_slots(batch.column("index").to_numpy(), n, key)
            tokens = [packer.compress(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(slot)], names=["tokens", "slot"])

    numbered = rows.join(firsts, group).withColumn("index", F.col("first") + F.col("local"))
    # pieces stay where they are: only tokens are shuffled
    found = staging.save(numbered.select("pieces", "index").mapInArrow(places, f"pieces {pieces}, slot long"), "placed", compression="zstd")
    placed = numbered.select("tokens", "index").mapInArrow(slots, "tokens binary, slot long")
    # slots are a permutation, so equal ranges of shards are equal shares; no sampling is needed
    dealt = placed.repartitionById(tasks, F.expr(f"cast((slot div {shard_sequences}) * {tasks} div {shards} as int)")).sortWithinPartitions("slot")
    stride = 2 * length

    def write(batches):
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value))
        attempt = TaskContext.get().taskAttemptId()
        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        filler = np.array([pad], "<u2").tobytes()
        open_shard, out = None, None

        def close():
            out.close()
            name = f"{base}/shard-{open_shard:08d}.bin"
            store.move(f"{name}.part-{attempt}", name)

        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for shard, packed in zip((slot // shard_sequences).tolist(), batch.column("tokens").to_pylist(), strict=True):
                if shard != open_shard:
                    if out is not None:
                        close()
                    open_shard, out = shard, store.open_output_stream(f"{base}/shard-{shard:08d}.bin.part-{attempt}")
                tokens = opener.decompress(packed)
                out.write(tokens + filler * ((stride - len(tokens)) // 2))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
        if out is not None:
            close()

    written = dealt.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if written != n:
        raise RuntimeError(f"{written} of {n} sequences were written")
    staging.drop("sequences", "counts")
    found = found.select("slot", F.explode("pieces").alias("p"))
    offset = (F.col("slot") % shard_sequences) * stride + 2 * F.col("p.at")
    shard = F.expr(f"slot div {shard_sequences}")
    return found.select("p.doc_id", "p.piece_no", "slot", shard.alias("shard"), offset.cast("long").alias("byte_offset"), "p.n_tokens")


def read_slots(path: str, first: int, count: int, *, length: int, shard_sequences: int) -> np.ndarray:
    """``count`` sequences from slot ``first`` on (rows of ``length`` ids), each shard read in one stretch."""
    store, base = pafs.FileSystem.from_uri(path)
    parts, stride = [], 2 * length
    while count > 0:
        shard, place = divmod(first, shard_sequences)
        n = min(count, shard_sequences - place)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(place * stride)
            raw = f.read(n * stride)
        if not raw:
            break
        parts.append(np.frombuffer(raw, "<u2").reshape(-1, length))
        first, count = first + n, count - n
    return np.concatenate(parts) if parts else np.empty((0, length), "<u2")


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every shard below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
