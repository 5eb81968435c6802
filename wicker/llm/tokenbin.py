"""Token ids as flat unsigned integer files with 64-bit document offsets, written by ranges of doc_id and memory-mapped.

Format, in one folder: for each partition k, ``ids-k.bin`` holds its documents' ids one after another, little-endian, 16
bits each if the vocabulary has at most 65,536 ids, else 32; ``docs-k.npy`` and ``offsets-k.npy`` (64 bits, one more than
documents) hold its doc_ids and where each document starts in the file. ``bases.json`` lists the partitions in doc_id
order with the ids and documents before each: prefix sums over the partitions' totals, which are all that the driver sees.

A task writes its files under a name of its own and reports it; bases.json lists the reported ones only, so that tasks
that are run again after an executor is lost leave at most files that nothing names.

The folder is a path that all executors have mounted (a file: address or none); any other file system is refused, as it can't
be memory-mapped. Partitions are ranges of (doc_id, hash of the text), so that many rows of one id, or without one, are
dealt over several.

Defined results: null and empty texts give just the end id; ids must be integers (anything else is refused by name); rows with
one doc_id follow each other by their texts' hashes, a null doc_id comes first; very long texts are encoded whole; special-token strings in a text are special tokens, as in the library; an
empty table gives a folder without partitions. Only the named columns are read.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import integers, local_path, shared_dir, sliced, spread, texts_of
from .segment import Words, core_and_tail, flattened

REMEMBERED = 250_000
#: Text bytes encoded at once; the sort beside it takes the JVM's share of an executor's memory.
SLICE_BYTES = 4 << 20
#: Text bytes of a partition of the files, about.
PARTITION_BYTES = 32 << 20


class WordIds:
    """Ids by the tokenizers library for a vocabulary that drops blanks; each distinct word is encoded once in a while."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.lower = '"Lowercase"' in file.read(4000)
        self.chars = str.maketrans({chr(b): c for b, c in byte_chars().items()})
        self.memo: dict[str, list[int]] = {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def words(self, texts: list[str]) -> list[list[int]]:
        """Ids of lower-case words of letters: the model alone does it, as normaliser and pattern leave them whole."""
        memo, model, chars, out = self.memo, self.tokenizer.model, self.chars, []
        for x in texts:
            ids = memo.get(x)
            if ids is None:
                ids = [t.id for t in model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(chars))]
                if len(memo) > REMEMBERED:
                    memo.clear()
                if len(x) < 100:
                    memo[x] = ids
            out.append(ids)
        return out

    def any(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and each text's first (one more than texts)."""
        w = Words(*texts_of(texts))
        codes, distinct = w.distinct()
        core, tail, plain = core_and_tail(distinct)
        latin = pc.equal(pc.binary_length(pc.utf8_trim(core, LATIN)), 0).to_numpy(zero_copy_only=False)
        plain &= latin
        low = (pc.utf8_lower(core) if self.lower else core).filter(pa.array(plain)).dictionary_encode()
        ends = tail.filter(pa.array(plain)).dictionary_encode()
        rest = distinct.filter(pa.array(~plain)).to_pylist()
        lists = self.words(low.dictionary.to_pylist())
        n = len(lists)
        lists += self.any(ends.dictionary.to_pylist()) + self.any(rest)
        pool, head, size = flattened(lists)
        table = np.full((len(distinct), 2), -1, np.int64)
        table[plain, 0], table[plain, 1] = low.indices.to_numpy(), ends.indices.to_numpy() + n
        table[~plain, 0] = np.arange(len(rest)) + n + len(ends.dictionary)
        units = table[codes].ravel()
        used = units >= 0
        each = np.where(used, size[units], 0)
        total = np.append(0, np.cumsum(each.reshape(-1, 2).sum(1)))
        units = units[used]
        return pool[spread(head[units], size[units])], total[w.first]


#: Letters that lower-case to one letter and are in composed form, whatever stands beside them.
LATIN = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))


@lru_cache(2)
def load(path: str) -> WordIds:
    return WordIds(path)


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write the files in ascending id order; returns the number of partitions. The folder is on storage that all executors share."""
    integers(docs, id_col)
    spark, place = docs.sparkSession, local_path(folder)
    os.makedirs(place, exist_ok=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-int(size) // PARTITION_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, name = load(path), uuid.uuid4().hex
        keys, sizes, tokens = [], [], 0
        with open(f"{place}/ids-{name}.bin", "wb") as out:
            for batch in sliced(batches, "text", SLICE_BYTES):
                flat, first = ids.encode(batch.column(1))
                n = batch.num_rows
                full = np.full(len(flat) + n, end_id, f"<u{ids.width}")
                full[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(first))] = flat
                out.write(full)
                sizes.append(np.diff(first) + 1)
                keys.append(batch.column(0))
                tokens += len(full)
        if not keys:
            os.remove(f"{place}/ids-{name}.bin")
            return
        every = pa.chunked_array(keys)
        if every.null_count:
            np.save(f"{place}/nulls-{name}.npy", every.is_null().to_numpy(zero_copy_only=False) if isinstance(every, pa.Array) else np.array(every.is_null()))
        np.save(f"{place}/docs-{name}.npy", every.fill_null(0).to_numpy())
        np.save(f"{place}/offsets-{name}.npy", np.append(0, np.cumsum(np.concatenate(sizes))).astype("<i8"))
        low = every[0].as_py()
        yield pa.RecordBatch.from_pylist([{"name": name, "low": low, "n_docs": len(every), "n_tokens": tokens, "width": ids.width}], pa.schema([("name", pa.string()), ("low", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    ordered = rows.repartitionByRange(parts, "doc_id", "h") if parts > 1 else rows.coalesce(1)
    found = ordered.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(run, "name string, low long, n_docs long, n_tokens long, width int").withColumn("part", F.spark_partition_id()).collect()
    bases, token, doc = [], 0, 0
    for r in sorted(found, key=lambda r: r["part"]):  # prefix sums: one row for each partition
        bases.append({"name": r["name"], "width": r["width"], "token_base": token, "doc_base": doc, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        token, doc = token + r["n_tokens"], doc + r["n_docs"]
    with open(f"{place}/bases.tmp", "w") as out:
        json.dump({"partitions": bases, "n_tokens": token, "n_docs": doc}, out)
    os.replace(f"{place}/bases.tmp", f"{place}/bases.json")
    return len(bases)


class TokenFile:
    """One partition, memory-mapped: ``file[i]`` are the ids of its i-th document."""

    def __init__(self, place: str, part: dict):
        self.base, name = part["token_base"], part["name"]
        self.docs = np.load(f"{place}/docs-{name}.npy", mmap_mode="r")
        self.offsets = np.load(f"{place}/offsets-{name}.npy", mmap_mode="r")
        nulls = f"{place}/nulls-{name}.npy"
        self.nulls = np.load(nulls, mmap_mode="r") if os.path.exists(nulls) else None
        with open(f"{place}/ids-{name}.bin", "rb") as file:
            self.ids = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), f"<u{part['width']}") if part["n_tokens"] else np.zeros(0, "<u2")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, and ids_crc32 of its ids as little-endian 32-bit integers."""
    place = local_path(folder)
    with open(f"{place}/bases.json") as file:
        parts = json.load(file)["partitions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                f = TokenFile(place, json.loads(part))
                for i in range(0, len(f), 20_000):
                    j = min(len(f), i + 20_000)
                    at = np.asarray(f.offsets[i : j + 1])
                    crc = [zlib.crc32(f[k].astype("<u4")) for k in range(i, j)]
                    keys = pa.array(np.asarray(f.docs[i:j]), pa.int64(), mask=None if f.nulls is None else np.asarray(f.nulls[i:j]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(at[:-1] + f.base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(json.dumps(p),) for p in parts], "part string")
    return listed.repartition(max(1, len(parts)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a table's token files to shared storage, then describe what is read back from them."""
    folder = shared_dir(docs.sparkSession)
    write(docs, folder, path, end_id, id_col, text_col)
    return read(docs.sparkSession, folder)
