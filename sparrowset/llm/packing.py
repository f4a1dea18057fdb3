"""Packing documents into sequences: length patterns fitted to the histogram by non-negative least squares.

1. Documents longer than a sequence are cut into full pieces, after a shorter first piece that holds the remainder.
2. The histogram of piece lengths (one number per length up to the capacity) goes to the driver.
3. Patterns of two or three lengths that fill a sequence exactly are enumerated, and non-negative least squares finds
   how often to use each so that together they use up the histogram. The counts are rounded down to what there is.
4. What is left is packed on counts per length rather than on documents, best-fit decreasing and by fullest subsets of
   the lengths; the way that needs fewer sequences is taken.
5. The result is a list of runs: "pieces number a to b of length L go to sequences s, s + 1, ... at offset o". Pieces
   are numbered within their length, and each finds its place in the runs.

The driver's work and the runs follow the capacity and not the number of documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed
from sparrowset.llm.tokenizing import END_ID, FAR_PIECES, NEAR_PIECES, default_tokenizer, encoder, groups, run_chars

CAPACITY = 1024
#: Patterns of three lengths beside all of two; if there are more, lengths of a coarser grid are combined.
MAX_TRIPLES = 120_000
STEPS = 400
#: Pieces of one length are numbered in shards of about so many; the driver-side table has a number for each shard.
SHARD_PIECES = 20_000
#: Smaller tables are numbered in about so many shards, so that a hot length's pieces are spread there, too.
LEAST_SHARDS = 4_096


def enumerate_patterns(capacity: int, present: np.ndarray, max_triples: int = MAX_TRIPLES) -> np.ndarray:
    """Rows of three lengths (0: none), falling, that fill the capacity exactly and use only lengths that occur."""
    a = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([capacity - a, a, np.zeros_like(a)], 1)
    step = max(1, int(np.ceil(np.sqrt(capacity**2 / 12 / max_triples))))
    small = np.arange(1, capacity // 3 + 1, step)
    b, c = np.meshgrid(np.arange(1, capacity), small, indexing="ij")
    first = capacity - b - c
    ok = (b >= c) & (first >= b)
    triples = np.stack([first[ok], b[ok], c[ok]], 1)
    rows = np.concatenate([pairs, triples])
    seen = np.zeros(capacity + 1, bool)
    seen[0] = True
    seen[1:] = present[1 : capacity + 1] > 0
    return rows[seen[rows].all(1)]


def fit_counts(patterns: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that brings sum(x * pattern) close to the histogram in least squares, by accelerated projected gradients."""
    if not len(patterns):
        return np.zeros(0)
    size = len(hist)
    weight = (patterns > 0).astype(float)
    target = hist.astype(float).copy()
    target[0] = 0
    flat = patterns.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (x[:, None] * weight).ravel(), size)

    # the largest eigenvalue of A'A is at most the largest row sum of A A' bound: columns meet through shared lengths
    lipschitz = 3.0 * max(1.0, used(np.ones(len(patterns))).max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        gradient = ((used(y) - target)[patterns] * weight).sum(1)
        nxt = np.maximum(0, y - gradient / lipschitz)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


@dataclass
class Runs:
    """Parallel arrays, by length and then by the first number."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def longest_that_fit(left: np.ndarray, there: np.ndarray, capacity: int) -> list[int]:
    """Best fit, decreasing: the longest piece, then again and again the longest that still fits."""
    room, lengths, taken = capacity, [], {}
    while room > 0:
        n = next((int(n) for n in there[there <= room][::-1] if left[n] > taken.get(int(n), 0)), 0)
        if not n:
            break
        lengths.append(n)
        taken[n] = taken.get(n, 0) + 1
        room -= n
    return lengths


def fullest_subset(left: np.ndarray, there: np.ndarray, capacity: int) -> list[int]:
    """The longest piece and those other lengths, each once, that leave the least room; long ones are preferred."""
    first = int(there[-1])
    others = [int(n) for n in there if n <= capacity - first and (n != first or left[n] > 1)]
    mask = (1 << (capacity - first + 1)) - 1
    sums = [1]  # bit k of sums[j]: the first j of the others can add up to k
    for n in others:
        sums.append((sums[-1] | sums[-1] << n) & mask)
    room, lengths = sums[-1].bit_length() - 1, [first]
    for j in range(len(others), 0, -1):
        if room >= others[j - 1] and sums[j - 1] >> (room - others[j - 1]) & 1:
            lengths.append(others[j - 1])
            room -= others[j - 1]
    return lengths


def pack_rest(left: np.ndarray, capacity: int, choose) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) until nothing is left; each step uses up some length."""
    left, out = left.copy(), []
    while len(there := np.flatnonzero(left)):
        lengths = choose(left, there, capacity)
        times = min(int(left[n]) // lengths.count(n) for n in {*lengths})
        np.subtract.at(left, lengths, times)
        out.append((lengths, times))
    return out


def plan_runs(hist: np.ndarray, capacity: int = CAPACITY, max_triples: int = MAX_TRIPLES) -> Runs:
    """Runs that place hist[L] pieces of each length L from 1 to capacity, numbered from 0 within their length."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in lengths:
            runs.append((n, int(used[n]), sequences, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequences += times

    if left[capacity]:
        place([capacity], int(left[capacity]))
    patterns = enumerate_patterns(capacity, left, max_triples)
    counts = fit_counts(patterns, left)
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < 1:
            break
        lengths = [int(n) for n in patterns[k] if n]
        times = min(int(counts[k]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if times > 0:
            place(lengths, times)
    rest = min((pack_rest(left, capacity, choose) for choose in (longest_that_fit, fullest_subset)), key=lambda x: sum(times for _, times in x))
    for lengths, times in rest:
        place(lengths, times)
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Runs(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy(), sequences)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length): a document of n <= capacity ids whole; else full pieces after one with the remainder."""
    head = n % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, added_as_text: bool = False, memo: tuple[int, int] = (NEAR_PIECES, FAR_PIECES)) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; null text is empty: the end id alone. memo: the
    encoder's, which changes its speed and memory only."""
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        import pyarrow as pa

        enc, end = encoder(path, added_as_text, memo), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in groups(batch.column(1), run_chars(memo)):
                out: list[tuple] = []
                for k, raw in enumerate(enc.ids(texts)):
                    raw += end
                    out += [(ids[first + k], j, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for j, (s, n) in enumerate(cut_pieces(len(raw) // 4, capacity))]
                cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, added_as_text: bool = False, memo: tuple[int, int] = (NEAR_PIECES, FAR_PIECES)) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each for themselves; rows with equal ids are told apart by start, length and content, and
    are interchangeable where all of these agree. Null ids are packed like others. An empty table gives no rows. Other
    columns are not read. Only numbers are shuffled. Pieces of a length are numbered in as many shards as their count
    asks, so no task sorts more than about shard_pieces of them (in small tables, one LEAST_SHARDS-th of all); the shards'
    bases are prefix sums of counts. Equal
    pieces of repeated rows are dealt out by the input's partition.
    """
    spark = df.sparkSession
    found = checkpointed(pieces(df, id_col, text_col, tokenizer, capacity, end_id, added_as_text, memo).withColumn("at", F.spark_partition_id()))
    total = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # `capacity` numbers at most
        total[r["length"]] = r["n"]
    each = max(1, min(shard_pieces, int(total.sum()) // LEAST_SHARDS))
    shards = np.maximum(1, -(-total // each))
    of = F.broadcast(spark.createDataFrame([(int(n), int(shards[n])) for n in np.flatnonzero(total)], "shard_length long, shards long"))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "at"), F.col("shards")).cast("int")
    found = found.join(of, F.col("length") == F.col("shard_length")).withColumn("shard", shard).drop("shard_length", "shards")
    counts = found.groupBy("length", "shard").agg(F.count("*").alias("n")).collect()  # total / shard_pieces + capacity numbers
    first_of = np.cumsum(shards) - shards  # the first shard's number of each length
    per = np.zeros(int(shards.sum()), np.int64)
    for r in counts:
        per[first_of[r["length"]] + r["shard"]] = r["n"]
    runs = plan_runs(total, capacity)
    bases = np.cumsum(per) - per
    bases -= np.repeat(bases[first_of], shards)  # within the length
    shared = spark.sparkContext.broadcast((runs.length * (1 << 40) + runs.first, runs.first, runs.sequence, runs.offset, first_of, bases))
    rank = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    numbered = found.withColumn("rank", rank.cast("long"))

    def run(batches):
        import pyarrow as pa

        keys, first, sequence, offset, first_of, base = shared.value
        for batch in batches:
            length, shard, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "shard", "rank"))
            number = base[first_of[length] + shard] + rank
            at = np.searchsorted(keys, length * (1 << 40) + number, "right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[at] + number - first[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
