"""Token ids in directly addressable codes: chunk levels with continuation bitmaps and rank directories.

A store is a folder of raw files and an index of them as a Parquet table. A
file holds blocks of codes, each of a run of documents in order of doc_id; any
token of a block can be read from the file without decoding the others.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.bpe import Pieces, byte_alphabet, default_path
from quillframe.llm.common import map_batches, pieces, table
from quillframe.shared import new_path

#: The id that ends each document.
END = 2
_MAGIC = b"DACS"
_SPAN = 512  # bits under one entry of a rank directory
_JOINED = 1000  # pieces that go through the library in one text


class DirectCodes:
    """Unsigned 32-bit values in chunks of eight bits, read in place.

    Level 0 has the low chunk of every value, level k the next chunk of those
    that went on. A level's bitmap says which of its values go on, and its
    directory how many did before each 512th place, so that a value's place in
    the next level is one lookup and a count of at most 512 bits.

    Layout, little-endian: "DACS", count of values, count of levels; for each
    level its length and whether any value goes on; then for each level the
    chunks and, if any goes on, the bitmap (padded to 64 bytes) and the
    directory of unsigned 32-bit counts.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        """read gives so many bytes from a place on; size: of the whole block."""
        self.read = read
        magic, self.n, levels = struct.unpack("<4sII", read(0, 12)) if size >= 12 else (b"", 0, 0)
        if magic != _MAGIC or size < 12 + 5 * levels:
            raise ValueError("not a block of directly addressable codes")
        at, self.levels = 12 + 5 * levels, []
        for n, more in struct.iter_unpack("<IB", read(12, 5 * levels)):
            blocks = -(-n // _SPAN) if more else 0
            self.levels.append((at, at + n, at + n + 64 * blocks, more))
            at += n + 68 * blocks
        if at != size:
            raise ValueError("the block's length doesn't fit its header")

    @classmethod
    def of(cls, blob: bytes) -> DirectCodes:
        return cls(lambda at, n: blob[at : at + n], len(blob))

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        heads, body, rest = [], [], values.astype(np.uint32)
        while len(rest) or not heads:
            chunk, more = rest.astype(np.uint8), rest > 255
            going = bool(more.any())
            heads.append(struct.pack("<IB", len(rest), going))
            body.append(chunk.tobytes())
            if not going:
                break
            size = -(-len(rest) // _SPAN)
            padded = np.zeros(size * _SPAN, dtype=bool)
            padded[: len(rest)] = more
            count = padded.reshape(size, _SPAN).sum(axis=1)
            body += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(count) - count).astype("<u4").tobytes()]
            rest = rest[more] >> np.uint32(8)
        return b"".join([struct.pack("<4sII", _MAGIC, len(values), len(heads)), *heads, *body])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One value: of each level that it has, a chunk, the 64 bytes of bitmap around it, and a count."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunk, bits, ranks, more in self.levels:
            value |= self.read(chunk + i, 1)[0] << shift
            if not more:
                break
            block, place = divmod(i, _SPAN)
            word = int.from_bytes(self.read(bits + 64 * block, 64), "little")
            if not word >> place & 1:
                break
            before = struct.unpack("<I", self.read(ranks + 4 * block, 4))[0]
            i, shift = before + (word & ((1 << place) - 1)).bit_count(), shift + 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop, from the chunks of these alone."""
        out = np.zeros(max(0, stop - start), dtype=np.uint32)
        at, shift = None, 0
        for chunk, bits, ranks, more in self.levels:
            if stop <= start:
                break
            low = np.frombuffer(self.read(chunk + start, stop - start), np.uint8).astype(np.uint32)
            if at is None:
                out |= low
            else:
                out[at] |= low << np.uint32(shift)
            if not more:
                break
            block, place = divmod(start, _SPAN)
            on = np.unpackbits(np.frombuffer(self.read(bits + 64 * block, -(-stop // 8) - 64 * block), np.uint8), bitorder="little")
            before = struct.unpack("<I", self.read(ranks + 4 * block, 4))[0] + int(np.count_nonzero(on[:place]))
            here = np.flatnonzero(on[place : place + stop - start])
            at, shift = here if at is None else at[here], shift + 8
            start, stop = before, before + len(here)
        return out


class Library(Pieces):
    """Whole texts to ids with the tokenizers library, which encodes each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab, space = self.tokenizer.get_vocab(with_added_tokens=False), byte_alphabet()[32]
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(space)]] = True
        super().__init__({t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()})

    def encode_pieces(self, new: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of prefix + piece for all pieces in one flat array, and where each piece begins and the last ends.

        Pieces behind a space go through the library in long texts: only the
        first id of each has a space at its start, and none a space elsewhere.
        """
        if prefix:
            texts = [prefix + prefix.join(new[k : k + _JOINED]) for k in range(0, len(new), _JOINED)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            return ids, np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))))
        return np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(ends[-1])), ends


_loaded: dict[str, Library] = {}


def library(path: str | None) -> Library:
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Library(path)
    return _loaded[path]


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_store(docs: DataFrame, path: str | None = None, end: int = END, partitions: int | None = None) -> DataFrame:
    """Write the token files in the shared folder and return their index: part, before, doc_ids, lengths, file, at, size.

    A file holds blocks of codes one after the other; the index says which
    documents, in ascending order, a block at some place of a file holds, and
    how many ids each. part counts the stretches of doc_ids in ascending order,
    before the ids of the part's earlier blocks. Documents are dealt out by
    ranges of (doc_id, hash of the text), so that no doc_id can fill a stretch
    alone unless its texts are equal too. Every attempt of a task writes a file
    of its own, and the index names those of attempts that ended well.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_q_hash")]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_q_hash")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    folder = new_path(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, before, at, out = library(path), TaskContext.get().partitionId(), 0, 0, None
        file = f"{part}-{uuid.uuid4().hex}.dacs"
        try:
            for rows in pieces(batches, "text"):
                if out is None:
                    store, root = _folder(folder)
                    store.create_dir(root)
                    out = store.open_output_stream(f"{root}/{file}")
                found = [np.append(x, np.uint32(end)) for x in tokenizer.encode_batch(rows.column("text").to_pylist())]
                lengths, ids = [len(x) for x in found], rows.column("doc_id")
                blob = DirectCodes.encode(np.concatenate(found))
                out.write(blob)
                yield pa.record_batch(
                    [
                        pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([lengths], pa.list_(pa.int64())), pa.array([f"{folder}/{file}"]), pa.array([at], pa.int64()), pa.array([len(blob)], pa.int64()),
                    ],
                    ["part", "before", "doc_ids", "lengths", "file", "at", "size"],
                )
                before, at = before + sum(lengths), at + len(blob)
        finally:
            if out is not None:
                out.close()

    schema = f"part int, before long, doc_ids array<{kind}>, lengths array<long>, file string, at long, size long"
    return table(map_batches(dealt.drop("_q_hash"), run, schema))


class TokenFile:
    """Blocks of one token file; a token costs the reads of DirectCodes and no more."""

    def __init__(self, uri: str):
        store, path = _folder(uri)
        self.file = store.open_input_file(path)

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def block(self, at: int, size: int) -> DirectCodes:
        """The codes of a block, read from the file as they are asked for."""
        return DirectCodes(lambda k, n: self.file.read_at(n, at + k), size)

    def loaded(self, at: int, size: int) -> DirectCodes:
        """The same over bytes that one read has brought, for a block of which most documents are wanted."""
        return DirectCodes.of(self.file.read_at(size, at))


def tokens(store: DataFrame, doc_id, start: int = 0, stop: int | None = None) -> list[int]:
    """Ids start to stop of the first document under an id, each level's bytes of these read from its file alone; [] without such a document."""
    row = store.filter(F.array_contains("doc_ids", F.lit(doc_id))).orderBy("part", "before").first()
    if row is None:
        return []
    k = row["doc_ids"].index(doc_id)
    first, n = sum(row["lengths"][:k]), row["lengths"][k]
    with TokenFile(row["file"]) as file:
        return file.block(row["at"], row["size"]).slice(first + min(start, n), first + min(n if stop is None else stop, n)).tolist()


def read_store(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, each addressed in its file's codes without those around it.

    start counts the ids of all documents before. The driver sees one total
    for each part only.
    """
    kind = dict(store.dtypes)["doc_ids"][6:-1]
    totals = store.groupBy("part").agg(F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    offsets, at = {}, 0
    for r in sorted(totals.collect()):
        offsets[r["part"]] = at
        at += r["n"]
    shared = store.sparkSession.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["part", "before", "lengths", "file", "at", "size"]).to_pylist()):
                lengths = np.array(row["lengths"], dtype=np.int64)
                cut = np.concatenate(([0], np.cumsum(lengths)))
                with TokenFile(row["file"]) as file:
                    codes = file.loaded(row["at"], row["size"])
                crc = [zlib.crc32(codes.slice(a, b).astype("<u4")) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                start = cut[:-1] + row["before"] + shared.value[row["part"]]
                yield pa.record_batch(
                    [batch.slice(k, 1).column("doc_ids").flatten(), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # the index is small beside the files, so it is dealt out by its rows
    dealt = store.repartition(max(1, len(offsets)), "file", "at")
    return map_batches(dealt, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row of docs, out of a store written for it.

    A null or empty text has the end id alone. Null doc_ids come first; rows
    with the same doc_id follow each other in the order of a hash of their
    texts. Repeated rows are kept, other columns not read; an empty table
    gives an empty one.
    """
    return read_store(write_store(docs, path))
