"""Token ids as flat binary files with 64-bit document offsets, made for memory-mapping.

A corpus is a folder with, for each partition p in ascending order of the ids of its documents:

    p.tokens    the ids of all its documents on end, unsigned 16 or 32 bits by the size of the vocabulary, little-endian
    p.offsets   n + 1 signed 64-bit numbers: where each document starts in p.tokens, in ids, then the end
    p.docs      n signed 64-bit document ids (0 for null)
    p.nulls     n bytes, 1 where the document id is null

and manifest.json: the partitions with their numbers of documents and ids, and the prefix sums of those as bases.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowset.llm.tokenizing import END_ID, default_tokenizer, encoder, groups

#: There are as many partitions as keep the mean size of their texts under this, and at least as many as shuffles have.
PARTITION_BYTES = 128 << 20


def _at(uri: str):
    """(file system, path): local, HDFS, S3 and what else pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def id_bits(vocabulary: int) -> int:
    return 16 if vocabulary <= 1 << 16 else 32


def write_tokens(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None, added_as_text: bool = False) -> dict:
    """Write the corpus of df to the shared folder; returns the manifest.

    Documents come in ascending order of id, null first, equal ids by a hash of their text. Null text is empty: such a
    document is the end id alone. An empty table gives a manifest without partitions. Partitions hold ranges of
    documents, as many as keep the mean of their texts under PARTITION_BYTES; a task streams its documents into its
    files. It writes under a name of its own try and the manifest lists the try that Spark counted, so lost or doubled
    tasks leave only unused files. The driver gets three numbers and a name for each partition.

    Texts are shuffled, once: compressed they are as small as their ids, and ids would have to be kept first, as dealing
    out by ranges reads its input twice.
    """
    path = tokenizer or default_tokenizer()
    text = F.col(f"`{text_col}`")
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").drop("h")
    from tokenizers import Tokenizer

    bits = id_bits(Tokenizer.from_file(path).get_vocab_size())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(path, added_as_text)
        dtype = np.dtype(f"<u{bits // 8}")
        end = np.array([end_id], dtype).tobytes()
        context = TaskContext.get()
        fs, base = _at(folder)
        fs.create_dir(base, recursive=True)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        docs, total = 0, 0
        with fs.open_output_stream(f"{base}/{name}.tokens") as tokens, fs.open_output_stream(f"{base}/{name}.offsets") as offsets, fs.open_output_stream(f"{base}/{name}.docs") as ids, fs.open_output_stream(f"{base}/{name}.nulls") as nulls:
            for batch in batches:
                keys = batch.column(0)
                ids.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nulls.write(keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                for _, texts in groups(batch.column(1), 1_000_000):
                    own = [np.frombuffer(raw, "<u4").astype(dtype).tobytes() + end for raw in enc.ids(texts)]
                    sizes = np.fromiter(map(len, own), np.int64, len(own)) // (bits // 8)
                    tokens.write(b"".join(own))
                    offsets.write((total + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                    docs, total = docs + len(own), total + int(sizes.sum())
            offsets.write(np.array([total], "<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "name": name, "docs": docs, "tokens": total}])

    done = sorted(rows.mapInArrow(run, "part long, name string, docs long, tokens long").collect())
    manifest = {"bits": bits, "parts": []}
    first_doc = first_token = 0
    for r in done:
        if r["docs"]:
            manifest["parts"].append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "doc_base": first_doc, "token_base": first_token})
            first_doc, first_token = first_doc + r["docs"], first_token + r["tokens"]
    manifest |= {"docs": first_doc, "tokens": first_token}
    fs, base = _at(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, base = _at(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def _array(fs, path: str, dtype: str):
    """The file as an array: mapped into memory where it is local, else read."""
    from pyarrow.fs import LocalFileSystem

    if isinstance(fs, LocalFileSystem):
        import os

        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype)


def documents_of(folder: str, part: dict, bits: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start among all ids of the corpus, ids) of each document of one partition."""
    fs, base = _at(folder)
    tokens, offsets, docs, nulls = (_array(fs, f"{base}/{part['name']}.{kind}", dtype) for kind, dtype in (("tokens", f"<u{bits // 8}"), ("offsets", "<i8"), ("docs", "<i8"), ("nulls", "u1")))
    for k in range(part["docs"]):
        yield None if nulls[k] else int(docs[k]), part["token_base"] + int(offsets[k]), tokens[offsets[k] : offsets[k + 1]]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files, a task for each partition."""
    manifest = read_manifest(folder)
    bits = manifest["bits"]
    schema = "name string, docs long, tokens long, doc_base long, token_base long"
    parts = spark.createDataFrame([tuple(p[c] for c in ("name", "docs", "tokens", "doc_base", "token_base")) for p in manifest["parts"]], schema)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for part in batch.to_pylist():
                out: list[tuple] = []
                for doc_id, start, ids in documents_of(folder, part, bits):
                    out.append((doc_id, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return parts.repartition(max(1, len(manifest["parts"]))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
