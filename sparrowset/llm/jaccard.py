"""Near copies by the Jaccard similarity of their word shingles: SimHash first, then an exact search for the rest.

Fingerprints of the same shingles link at DISTANCE bits or fewer (simhash.py, by the pigeonhole principle); these links are
checked on the shingles. No number of bits short of all 64 reaches every similar pair, so those that SimHash hasn't given
are searched by prefix filtering, and nothing is lost.


Put the shingles of all texts in one order. Two sets of a and b shingles with similarity 4/5 or more have at least
4/9 (a + b) in common, so they share a shingle among the first a - ceil(4/5 a) + 1 and b - ceil(4/5 b) + 1: each set is
entered under those, and only sets that meet are compared. At their first common shingle no more can be common than
either set has from there on, which rules most of them out. Any order is right; here, shingles that a sample of the
texts repeats come last, so that few sets meet under common ones.

A bucket of many sets first gives only pairs of neighbours, by size and, among sets of about one size, in an order of the
bucket's own: so near copies that meet in many buckets have other neighbours in each. What those pairs connect needs no
more of them; the others that pass the filters and lie in different components follow in a second step.

Sets are of 64-bit hashes of shingles, and a text is known by its 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.llm import simhash
from sparrowset.llm.common import checkpointed, fresh, small_or_shuffled, text_of
from sparrowset.llm.components import components, few_roots, thinned
from sparrowset.llm.tokenizing import groups

SHINGLE = 5
#: The least similarity, NUM / DEN.
NUM, DEN = 4, 5
SEED = 42
#: Bits in which the fingerprints of a pair may differ, and the cost of comparing two of them, in entries.
DISTANCE = 8
PAIR_COST = 0.01
#: Texts in the sample that orders the shingles, and shingles that are put last at most.
SAMPLE, COMMON = 4000, 50_000
#: A bucket of up to so many sets gives all its pairs at once, a larger one those of NEXT neighbours.
FEW, NEXT = 16, 2
#: A set's parity maps have at least so many bits for each of its shingles, a power of two within BITS. A map differs from
#: another in no more bits than the sets differ in shingles, also when the larger one is folded by XOR. The coarse map
#: rules out sets that have little in common, the fine one those with a similarity of 0.79 or so.
COARSE, FINE = 2, 8
BITS = (256, 1 << 22)
#: Up to so many hashes of texts are broadcast, to pick those texts.
LISTED = 200_000
#: Up to so many links are joined on the driver, in arrays of some 10 MB.
FEW_LINKS = 200_000
#: Sets of a bucket that are compared as one block.
BLOCK = 256
#: A task holds so many rows of a bucket at most.
HELD = 100_000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the runs of `shingle` words, A-Z lower-cased; fewer words, or none, are one run."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    runs = (b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1)))
    return np.unique(np.frombuffer(b"".join([xxh64_digest(r, SEED) for r in runs]), np.int64))


def prefix(n):
    return n - -(-NUM * n // DEN) + 1


def similar(common, a, b):
    return (NUM + DEN) * common >= NUM * (a + b)


def may_be(n_a, at_a, n_b, at_b):
    """Whether sets of these sizes, whose first common shingle is at these places, can be similar."""
    return (DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b)) & similar(np.minimum(n_a - at_a, n_b - at_b), n_a, n_b)


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(text_of(text_col))


def common_shingles(texts: DataFrame, n: int, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and in how many."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle))], ["h"])

    sample = texts.filter(F.pmod(F.xxhash64("s"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    found = sample.mapInArrow(run, "h long").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    found = np.array(sorted((r["h"], r["count"]) for r in found), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def entries(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int = SHINGLE) -> DataFrame:
    """key, s, n, at: the shingles of each text's prefix, the size of its set, and their place in its order."""
    often, times = common

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, some in groups(batch.column(1)):
                keys, sizes, counts = [], [], []
                for t in some:
                    own = shingle_set(t, shingle)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                        own = own[np.lexsort((own, np.where(often[at] == own, times[at], 0)))]
                    sizes.append(len(own))
                    keys.append(own[: prefix(len(own))])
                    counts.append(len(keys[-1]))
                s = batch.column(0).slice(first, len(some)).to_numpy()
                at = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(s, counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(at)], ["key", "s", "n", "at"])

    return texts.select("s", "text").mapInArrow(run, "key long, s long, n int, at int")


def whole_buckets(batches) -> Iterator[tuple[list, int]]:
    """(columns, skip) of the batches, sorted by the first column, cut only where that changes. Runs of more than HELD rows
    come in parts; a later part begins with the last NEXT rows of the one before, and skip is their number."""
    import pyarrow as pa

    rest, skip = None, 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = rest.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield rest.slice(0, cut).combine_chunks().columns, skip
            rest, skip = rest.slice(cut), 0
        elif len(rest) > HELD:
            yield rest.combine_chunks().columns, skip
            rest, skip = rest.slice(len(rest) - NEXT), NEXT
    if rest is not None and len(rest):
        yield rest.combine_chunks().columns, skip


def first_pairs(rows: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: pairs to compare and the sizes of their sets; and, with null a, the entries of large buckets."""

    def run(batches):
        import pyarrow as pa

        names = ["a", "b", "n_a", "n_b", "key", "s", "n", "at"]
        for columns, skip in whole_buckets(batches):
            key, n, s, at = (c.to_numpy() for c in columns)
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.repeat(np.diff(edge), np.diff(edge))
            if skip:  # the first run goes on from a large part
                size[: edge[1]] = np.maximum(size[: edge[1]], FEW + 1)
            for d in range(1, min(FEW, int(size.max()))):
                k = np.flatnonzero((key[d:] == key[:-d]) & ((size[d:] <= FEW) | (d <= NEXT)))
                k = k[may_be(n[k].astype(np.int64), at[k], n[k + d].astype(np.int64), at[k + d])]
                a, b = np.where(s[k] < s[k + d], (k, k + d), (k + d, k))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[a], s[b], n[a], n[b])] + [*[pa.nulls(len(k), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]], names)
            many = np.flatnonzero(size > FEW)
            many = many[many >= skip]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(many), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())] + [pa.array(c[many]) for c in (key, s, n, at)], names)

    about = F.floor(F.log("n") * 8).cast("int")  # sizes within an eighth of each other or so
    dealt = rows.repartition("key").sortWithinPartitions("key", about, F.xxhash64("key", "s")).select("key", "n", "s", "at")
    return checkpointed(dealt.mapInArrow(run, "a long, b long, n_a int, n_b int, key long, s long, n int, at int"))


def parity_map(own: np.ndarray, per: int) -> bytes:
    """In which classes the set has an odd number of shingles, one bit for each class."""
    bits = min(max(BITS[0], 1 << (per * len(own) - 1).bit_length()), BITS[1])
    return np.packbits(np.bincount(own & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """The maps as rows of `size` bytes, no larger than any of them."""
    out = np.empty((len(maps), size // 8), np.uint64)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, size // 8), 0)
    return out


def parity_maps(texts: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """s, coarse, fine: the parity maps of at least the texts that are wanted (s, distinct)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, some in groups(batch.column(1)):
                own = [shingle_set(t, shingle) for t in some]
                maps = [pa.array([parity_map(x, per) for x in own], pa.binary()) for per in (COARSE, FINE)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), *maps], ["s", "coarse", "fine"])

    texts = texts.select("s", "text")
    if wanted.limit(LISTED + 1).count() <= LISTED:  # else all maps cost less than a shuffle of the texts
        texts = texts.join(F.broadcast(wanted.withColumnRenamed("s", "wanted")), F.col("s") == F.col("wanted"), "left_semi")
    return checkpointed(texts.mapInArrow(run, "s long, coarse binary, fine binary"))


def sets_of(texts: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """s, hashes of the texts in the pairs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, some in groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.array([shingle_set(t, shingle).tobytes() for t in some], pa.binary())], ["s", "hashes"])

    wanted = small_or_shuffled(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), LISTED)
    return texts.join(wanted, F.col("s") == F.col("wanted"), "left_semi").select("s", "text").mapInArrow(run, "s long, hashes binary")


def with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """a, b and the column of each."""
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("s").alias(f"s_{end}"), F.col(column).alias(f"{column}_{end}")), F.col(end) == F.col(f"s_{end}")).drop(f"s_{end}")
    return pairs.select("a", "b", f"{column}_a", f"{column}_b", *[c for c in pairs.columns if c in ("n_a", "n_b")])


def true_links(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """u, v: those of the pairs whose sets are similar."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                yes.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(yes, pa.bool_()))

    sets = checkpointed(sets_of(texts, pairs, shingle))
    return checkpointed(with_both(pairs.select("a", "b"), sets, "hashes").mapInArrow(run, "u long, v long"))


def parity_allows(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """x, y: rows of parity maps. Similar sets differ in 1/9 of their sizes' sum at most."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) * (NUM + DEN) <= (n_x.astype(np.int64) + n_y) * (DEN - NUM)


def by_parity(pairs: DataFrame, maps: DataFrame, column: str) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) that their parity maps allow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yes = []
            for x, y, n_x, n_y in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                x, y = folded([x, y], min(x.size, y.size))
                yes.append(bool(parity_allows(x, y, np.int64(n_x), np.int64(n_y))))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1, 4, 5)], ["a", "b", "n_a", "n_b"]).filter(pa.array(yes, pa.bool_()))

    return checkpointed(with_both(pairs, maps, column).mapInArrow(run, "a long, b long, n_a long, n_b long"))


def compare(x: tuple, y: tuple, same: bool) -> tuple[np.ndarray, ...]:
    """(a, b, n_a, n_b) of the pairs of two blocks' entries that may be similar and lie in different components.

    x, y: (n, at, s, c, maps) of a block's entries, maps as rows of one width; same: one and the same block."""
    (n_x, at_x, s_x, c_x, p), (n_y, at_y, s_y, c_y, q) = x, y
    width = min(p.shape[1], q.shape[1])
    p, q = (np.bitwise_xor.reduce(m.reshape(len(m), -1, width), 1) for m in (p, q))
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(n_x)), np.arange(len(n_y)), indexing="ij"))
    k = np.flatnonzero((c_x[i] != c_y[j]) & may_be(n_x[i], at_x[i], n_y[j], at_y[j]) & ((i < j) | (not same)))
    i, j = i[k], j[k]
    yes = [parity_allows(p[i[m : m + 4096]], q[j[m : m + 4096]], n_x[i[m : m + 4096]], n_y[j[m : m + 4096]]) for m in range(0, len(i), 4096)]
    k = np.flatnonzero(np.concatenate(yes)) if yes else np.empty(0, np.int64)
    i, j = i[k], j[k]
    turn = s_x[i] > s_y[j]
    pick = lambda v, w: (np.where(turn, w[j], v[i]), np.where(turn, v[i], w[j]))
    return (*pick(s_x, s_y), *pick(n_x, n_y))


def other_pairs(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: all pairs of a bucket's entries that may be similar and lie in different components.

    rows: key, n, s, at, c (component), and of the bucket: size (its number of entries), rep (its least s). Entries of a
    bucket, by size, are dealt out in blocks. Blocks are compared with themselves where they are gathered, and each two
    blocks of a bucket whose sizes come near each other are a row of work of their own. A family of texts meets in many
    buckets; those with one least text are brought to one task, which gives each pair once.
    """
    fields = ("n", "at", "s", "c")
    pair, block_names = ["a", "b", "n_a", "n_b"], ["key", "block", "n_min", "n_max", *fields, "maps"]

    def once(found, seen: set):
        """The pairs that this task hasn't given yet."""
        import pyarrow as pa

        new = [r for r in zip(*(v.tolist() for v in found), strict=True) if r[:2] not in seen]
        seen.update(r[:2] for r in new)
        if len(seen) > 1_000_000:
            seen.clear()
        return [pa.array([r[k] for r in new], pa.int64()) for k in range(4)]

    def gather(batches):
        import pyarrow as pa

        seen: set = set()

        def done(key, block, size, entries):
            n, at, s, c, coarse = zip(*entries, strict=True)
            own = (*(np.array(v, np.int64) for v in (n, at, s, c)), folded(coarse, min(map(len, coarse))))
            found = once(compare(own, own, True), seen)
            yield pa.RecordBatch.from_arrays([*found, *[pa.nulls(len(found[0]), pa.int64())] * 4, *[pa.nulls(len(found[0]), pa.binary())] * 5], [*pair, *block_names])
            if size > BLOCK:
                cells = [pa.array([v], pa.int64()) for v in (None, None, None, None, key, block, min(n), max(n))]
                yield pa.RecordBatch.from_arrays([*cells, *[pa.array([v.tobytes()], pa.binary()) for v in own]], [*pair, *block_names])

        now, held = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != r[:3]:
                    if held:
                        yield from done(*now, held)
                    now, held = r[:3], []
                held.append(r[3:])
        if held:
            yield from done(*now, held)

    def across(batches):
        import pyarrow as pa

        seen: set = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = ([np.frombuffer(v, np.int64) for v in z[:4]] + [np.frombuffer(z[4], np.uint64).reshape(len(z[0]) // 8, -1)] for z in (row[:5], row[5:]))
                yield pa.RecordBatch.from_arrays(once(compare(x, y, False), seen), pair)

    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "s")) - 1
    dealt = rows.withColumn("block", F.floor(place / BLOCK)).join(maps.select(F.col("s").alias("of"), "coarse"), F.col("s") == F.col("of"))
    dealt = dealt.repartition("rep", "block").sortWithinPartitions("rep", "key", "block")
    schema = "a long, b long, n_a long, n_b long, key long, block long, n_min long, n_max long, n binary, at binary, s binary, c binary, maps binary"
    done = checkpointed(dealt.select("key", "block", "size", "n", "at", "s", "c", "coarse").mapInArrow(gather, schema))
    near, blocks = done.filter("a is not null").select(*pair), done.filter("a is null").select(*block_names)
    if not blocks.isEmpty():
        last = blocks.groupBy("key").agg(F.max("block").alias("last"))
        cells = [*fields, "maps"]
        left = blocks.join(last, "key").filter("block < last").select("key", F.col("n_max").alias("x_n"), *[F.col(c).alias(f"x_{c}_") for c in cells], F.explode(F.expr("sequence(block + 1, last)")).alias("block"))
        work = left.join(blocks, ["key", "block"]).filter(f"{NUM} * n_min <= {DEN} * x_n")
        near = near.unionByName(work.select(*[f"x_{c}_" for c in cells], *cells).mapInArrow(across, "a long, b long, n_a long, n_b long"))
    return near.distinct()


def partial_roots(links: DataFrame, rounds: int = 3) -> DataFrame:
    """s, root: for each linked node, one it is connected to: the least it hears of in some rounds in which it asks its
    neighbours and then the node that it has found. Nodes with one root are connected, which is all that is asked. Of up
    to FEW_LINKS links it is the least node of all. links should be checkpointed."""
    if (roots := few_roots(links, FEW_LINKS)) is not None:
        return roots
    both = checkpointed(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = both.select(F.col("u").alias("s"), F.col("u").alias("root")).distinct()
    for _ in range(rounds):
        heard = both.join(roots, F.col("v") == F.col("s")).groupBy(F.col("u").alias("s")).agg(F.min(F.least("root", "u")).alias("root"))
        heard = checkpointed(heard)
        further = small_or_shuffled(heard.select(F.col("s").alias("of"), F.col("root").alias("next")), LISTED)
        roots = checkpointed(heard.join(further, F.col("root") == F.col("of")).select("s", F.col("next").alias("root")))
    return roots


def links(texts: DataFrame, n: int, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """u, v: pairs of similar texts that connect whatever all of them connect, without what connects nothing new in a task.

    texts: s, text, with s distinct; n: about how many.

    The pairs that SimHash links are compared in full, as are those others that meet in the prefix search and that their maps
    allow. What those that are similar connect leaves few others to compare: pairs in large buckets that weren't paired at
    first and aren't connected so.
    """
    tried = simhash.near_texts(texts, shingle, distance, PAIR_COST, FEW_LINKS)
    first = first_pairs(entries(texts, common_shingles(texts, n, shingle), shingle))
    some, many = first.filter("a is not null").select("a", "b", F.col("n_a").cast("long"), F.col("n_b").cast("long")).distinct(), first.filter("a is null").select("key", "s", "n", "at")
    some = some.join(tried.hint("merge"), ["a", "b"], "left_anti")
    wanted = checkpointed(some.select(F.explode(F.array("a", "b")).alias("s")).unionByName(many.select("s")).distinct())
    maps = parity_maps(texts, wanted, shingle)
    pairs = tried.unionByName(by_parity(by_parity(some, maps, "coarse"), maps, "fine").select("a", "b"))
    found = true_links(pairs, texts, shingle)
    thin = lambda links: links.select("u", "v").mapInArrow(thinned, "u long, v long")
    if many.isEmpty():
        return thin(found)
    many = checkpointed(many.join(partial_roots(found), "s", "left").withColumn("c", F.coalesce("root", "s")).drop("root"))
    apart = many.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"), F.min("s").alias("rep")).filter("low < high").select(F.col("key").alias("open"), "size", "rep")
    rows = many.join(small_or_shuffled(checkpointed(apart), LISTED), F.col("key") == F.col("open")).drop("open")
    others = by_parity(other_pairs(rows, maps), maps, "fine").select("a", "b")
    return thin(found.unionByName(true_links(checkpointed(others.join(pairs, ["a", "b"], "left_anti")), texts, shingle)))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of rows that links of similar texts connect, with df's columns (of any other names).

    The row with the smallest id stays, null ids last; of equal ids the one with the smallest hash of its text, and of
    equal texts then of its other columns. Null text equals empty text; all texts without words are alike. An empty table stays empty.
    Texts are shuffled only where some are equal, or more than LISTED of them go.
    """
    names = df.columns
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    ident = F.col(f"`{id_col}`")
    known = df.select(text_key(text_col).alias("s"), ident.cast("long").alias("id"))
    nodes = checkpointed(known.groupBy("s").agg(F.min("id").alias("least")))
    node = nodes.select("s", F.struct(F.col("least").isNull().alias("none"), "least", "s").alias("node"))
    texts = df.select(text_key(text_col).alias("s"), text_of(text_col).alias("text"))
    n = nodes.count()
    repeated = n < df.count()
    if repeated:  # of equal texts one is enough
        texts = texts.groupBy("s").agg(F.min("text").alias("text"))
    roots = components(links(texts, n, shingle, distance), few=FEW_LINKS)
    members = checkpointed(roots.select(F.col("u").alias("s"), "root").unionByName(roots.select(F.col("root").alias("s"), "root").distinct()))
    # the first of a component is found by partial minima, and the others by unique keys, so a large one isn't gathered
    first = members.join(node, "s").groupBy("root").agg(F.min("node").alias("node")).select(F.col("node.s").alias("first"))
    gone = members.select(F.col("s").alias("gone")).join(first, F.col("gone") == F.col("first"), "left_anti")
    gone = small_or_shuffled(checkpointed(gone), LISTED)

    s = fresh("s", names)
    left = df.withColumn(s, text_key(text_col)).join(gone, F.col(s) == F.col("gone"), "left_anti")
    if not repeated:
        return left.drop(s)
    order = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("h"))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col], F.col(f"`{text_col}`").isNull().alias("no_text"))
    kept = left.select(F.col(s).alias("s"), text_of(text_col).alias("t"), order.alias("o"), row.alias("r")).groupBy("s", "t").agg(F.min_by("r", "o").alias("r"))
    return kept.select(*[F.when(F.col("r.no_text"), F.lit(None)).otherwise(F.col("t")).cast(df.schema[c].dataType).alias(c) if c == text_col else F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])
