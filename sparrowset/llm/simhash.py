"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal texts and texts with one fingerprint meet first; all that follows is about distinct fingerprints.

Split the 64 bits into m groups with thresholds t_1 .. t_m (-1: never) whose sum is d - m + 1. Two fingerprints that
differ in d bits or fewer differ in at most t_i bits of some group i: else they differed in at least
sum(t_i + 1) = d + 1. So every fingerprint is entered under its bits of group i, and under those with up to t_i of them
flipped, and all pairs that meet are verified on all 64 bits.

Groups: bits that go together are put into one group, so that the groups differ in how well they tell fingerprints
apart. Thresholds: dynamic programming picks those with the least estimated cost, entries plus candidate pairs. The
number of groups is picked by the same cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed, small_or_shuffled
from sparrowset.llm.components import UnionFind, components, thinned
from sparrowset.llm.tokenizing import groups

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
#: Shingles whose bits are counted at once, and rows of a bucket that are compared as one block.
CHUNK = 1 << 15
BLOCK = 1024
#: Rows of one fingerprint find its component in so many shares.
SALTS = 64
#: Cost of a candidate pair, in entries.
PAIR_COST = 0.1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the words of the whole text, A-Z lower-cased: bit b is 1 if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # of bytes: ASCII only, in both
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(b" ".join(words), SEED), "big")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    ends = ends[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint as a signed number) of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in groups(batch.column(1)):
                fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(fps)], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


# --- planning, on sums over all fingerprints ---


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Their number, and how often bits i and j are both 1 (64 x 64), summed over all of them."""

    def run(batches):
        import pyarrow as pa

        both = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in cells:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    """n x 64, bit 0 the lowest."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size: each starts with the free bit that goes most with others, then takes the bit that
    goes most with those it has (by the size of the correlation)."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            nxt = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def near_share(p: np.ndarray, t: int) -> float:
    """The share of pairs that differ in at most t of the bits with these frequencies, taken as independent."""
    differ = 2 * p * (1 - p)
    dist = np.zeros(t + 2)
    dist[0] = 1
    for d in differ:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return float(dist[: t + 1].sum())


def plan(n: int, both: np.ndarray, distance: int = MAX_DISTANCE, pair_cost: float = PAIR_COST) -> list[tuple[int, int]]:
    """(mask of a group's bits, threshold) for each group that is probed."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(1, distance + 3):
        parts = group_bits(n, both, m)
        cost = [[0.0] + [n * (1 + sum(comb(len(g), k) for k in range(1, t + 1)) / 2) + pair_cost * n * n / 2 * near_share(p[g], t) for t in range(min(distance, 2) + 1)] for g in parts]
        # least[s]: the cheapest thresholds so far with t + 1 summing to s; d + 1 is wanted
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (so_far, ts) in least.items():
                for t in range(-1, len(c) - 1):
                    if s + t + 1 <= distance + 1 and (s + t + 1 not in nxt or so_far + c[t + 1] < nxt[s + t + 1][0]):
                        nxt[s + t + 1] = (so_far + c[t + 1], [*ts, t])
            least = nxt
        if distance + 1 in least and (best is None or least[distance + 1][0] < best[0]):
            best = (least[distance + 1][0], [(sum(1 << b for b in g), t) for g, t in zip(parts, least[distance + 1][1], strict=True) if t >= 0])
    return best[1]


# --- probing and verifying ---


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def entries(fps: DataFrame, groups_: list[tuple[int, int]]) -> DataFrame:
    """part, key, fp: each fingerprint under its bits of each group, and under every key with up to t of them flipped
    that is larger than its own (of two near keys the smaller one probes)."""
    flips = []
    for k, (mask, t) in enumerate(groups_):
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips += [(k, _signed(mask), _signed(sum(1 << b for b in chosen))) for size in range(t + 1) for chosen in combinations(bits, size)]
    schema = "array<struct<part:int,mask:bigint,flip:bigint>>"
    rows = F.from_json(F.lit("[" + ",".join(f'{{"part":{a},"mask":{b},"flip":{c}}}' for a, b, c in flips) + "]"), schema)
    own = F.col("fp").bitwiseAND(F.col("e.mask"))
    return fps.select("fp", F.explode(rows).alias("e")).select(F.col("e.part").alias("part"), own.bitwiseXOR(F.col("e.flip")).alias("key"), "fp", own.alias("own")).filter("key >= own").drop("own")


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the absolute value's


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return bits_between(a[:, None], b[None, :]) <= distance


def forest(a: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Positions of links that connect whatever the links among a connect: at most len(a) - 1."""
    linked = near(a, a, distance)
    todo, out = linked.sum(1) > 1, []  # each is linked to itself
    while todo.any():
        front = np.array([int(todo.argmax())])
        todo[front] = False
        while len(front):
            new = np.flatnonzero(linked[front].any(0) & todo)
            out += zip(front[linked[np.ix_(front, new)].argmax(0)].tolist(), new.tolist(), strict=True)
            todo[new] = False
            front = new
    return out


def component_forest(a: np.ndarray, b: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray, distance: int, tie: UnionFind) -> list[tuple[int, int]]:
    """Positions of links between a and b that connect their components, as tie has them, as all links between them do."""
    out = []
    for s in range(0, len(a), 256):  # a row of the comparison at a time would do; 256 keep the matrices small
        x, y = np.nonzero(near(a[s : s + 256], b, distance))
        pairs = np.unique(np.stack([comp_a[s + x], comp_b[y]], 1), axis=0, return_index=True)[1]
        out += [(s + int(x[k]), int(y[k])) for k in pairs.tolist() if tie.join(int(comp_a[s + x[k]]), int(comp_b[y[k]]))]
    return out


#: A bucket of up to so many rows gives all its links, a larger one a forest of them.
FEW = 8
def bucket_links(edge: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of fps that begin at edge[:-1]."""
    sizes = np.diff(edge)
    run = np.repeat(np.arange(len(sizes)), sizes)
    few = np.repeat(sizes <= FEW, sizes)
    us, vs = [], []
    for d in range(1, min(FEW, int(sizes.max(initial=0)))):
        at = np.flatnonzero((run[d:] == run[:-d]) & few[d:])
        at = at[bits_between(fps[at], fps[at + d]) <= distance]
        us.append(fps[at])
        vs.append(fps[at + d])
    for k in np.flatnonzero(sizes > FEW):
        own = fps[edge[k] : edge[k + 1]]
        links = np.array(forest(own, distance), np.int64).reshape(-1, 2)
        us.append(own[links[:, 0]])
        vs.append(own[links[:, 1]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def whole_blocks(batches, keys: int) -> Iterator[list[np.ndarray]]:
    """The long columns of the batches, sorted by the first `keys` of them, cut only where those change."""
    rest = None
    for batch in batches:
        new = [c.to_numpy().astype(np.int64) for c in batch.columns]
        rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if not len(rest[0]):
            continue
        other = np.flatnonzero(np.any([c != c[-1] for c in rest[:keys]], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last block may go on in the next batch
        if cut:
            yield [c[:cut] for c in rest]
            rest = [c[cut:] for c in rest]
    if rest is not None and len(rest[0]):
        yield rest


def edges(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0), [True]]))


def links_within(blocked: DataFrame, distance: int) -> DataFrame:
    """u, v: links within each block, thinned in each task to those that still connect something there."""

    def found(batches):
        import pyarrow as pa

        for part, key, block, fp in whole_blocks(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in bucket_links(edges([part, key, block]), fp, distance)], ["u", "v"])

    return blocked.select("part", "key", "block", "fp").mapInArrow(lambda batches: thinned(found(batches)), "u long, v long")


def links_across(rows: DataFrame, distance: int) -> DataFrame:
    """u, v: links between the blocks of a bucket that connect their components as all links between them do.

    rows: part, key, block, fp, comp. Two blocks of one and the same component aren't compared."""

    def pack(batches):
        import pyarrow as pa

        names = ["part", "key", "block", "low", "high", "fps", "comps"]
        for columns in whole_blocks(batches, 3):
            edge = edges(columns[:3])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                (part, key, block), fp, comp = (c[a] for c in columns[:3]), columns[3][a:b], columns[4][a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (part, key, block, comp.min(), comp.max())] + [pa.array([x.tobytes()], pa.binary()) for x in (fp, comp)], names)

    def across(batches):
        import pyarrow as pa

        for batch in batches:
            for a, ca, b, cb in zip(*batch.columns, strict=True):
                a, ca, b, cb = (np.frombuffer(x.as_py(), np.int64) for x in (a, ca, b, cb))
                at = np.array(component_forest(a, b, ca, cb, distance, UnionFind()), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(a[at[:, 0]]), pa.array(b[at[:, 1]])], ["u", "v"])

    dealt = rows.repartition("part", "key", "block").sortWithinPartitions("part", "key", "block").select("part", "key", "block", "fp", "comp")
    blocks = checkpointed(dealt.mapInArrow(pack, "part long, key long, block long, low long, high long, fps binary, comps binary"))
    last = blocks.groupBy("part", "key").agg(F.max("block").alias("last"))
    left = blocks.join(last, ["part", "key"]).filter("block < last").select("part", "key", F.col("low").alias("l"), F.col("high").alias("h"), F.col("fps").alias("a"), F.col("comps").alias("ca"), F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("block"))
    both = left.join(blocks, ["part", "key", "block"]).filter("l < h or low < high or l <> low")
    return both.select("a", "ca", F.col("fps").alias("b"), F.col("comps").alias("cb")).mapInArrow(across, "u long, v long")


def near_links(fps: DataFrame, distance: int = MAX_DISTANCE, block_rows: int = BLOCK, pair_cost: float = PAIR_COST, stars_too: bool = True, few: int = 0) -> DataFrame:
    """u, v: pairs that connect exactly the fingerprints connected by links of at most `distance` bits: such links
    themselves, or, unless stars_too is false, the stars of the components they form.

    fps: fp, distinct. Entries are sorted by bucket and stream through each task in blocks of at most block_rows. Within
    a block all pairs are verified, but only what connects something new in the task is emitted. Buckets of several
    blocks go on to a second step, after the components that the first one's links form: a bucket that lies in one
    component is done; of the others each two blocks are verified, spread by (bucket, block), and give at most as many
    links as they have components.
    """
    n, both = bit_statistics(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    place = F.row_number().over(Window.partitionBy("part", "key").orderBy("fp")) - 1
    all_entries = entries(fps, plan(n, both, distance, pair_cost))
    blocked = all_entries.withColumn("block", F.floor(place / block_rows).cast("long"))
    links = checkpointed(links_within(blocked, distance))
    large = checkpointed(all_entries.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("part", "key"))
    if large.isEmpty():
        return links
    stars = components(links, few=few)
    comp = stars.select(F.col("u").alias("fp"), F.col("root").alias("comp"))
    rows = checkpointed(blocked.join(small_or_shuffled(large), ["part", "key"], "left_semi").join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")))
    open_ = rows.groupBy("part", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("part", "key")
    rows = rows.join(small_or_shuffled(checkpointed(open_)), ["part", "key"], "left_semi")
    within = stars.select("u", F.col("root").alias("v")) if stars_too else links
    return checkpointed(within.unionByName(links_across(rows, distance)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """id, fp, component_id of each row; other columns aren't read. component_id: the smallest id reachable by links of at most `distance` bits, its own included.

    Null text and text without words have fingerprint 0 and link like others. Null ids take their component's smallest
    id, which is null only where all ids are. Repeated rows stay. An empty table gives no rows.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = checkpointed(fingerprints(df, id_col, text_col, shingle).withColumn("salt", salt))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    # nodes order by their smallest id, so a component's least node has its smallest id and nothing is gathered by component
    nodes = distinct.select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("node"))
    links = near_links(distinct.select("fp"), distance)
    for end in ("u", "v"):
        links = links.join(nodes.withColumnsRenamed({"fp": f"{end}_fp", "node": f"{end}_node"}), F.col(end) == F.col(f"{end}_fp"))
    roots = components(links.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))
    linked = roots.select(F.col("u.fp").alias("linked_fp"), F.col("root.least").alias("component_id"))
    answer = distinct.join(linked, F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # the answer of a fingerprint, copied to its salts: a row then needs (fp, salt), whose share of a hot one is 1 / SALTS
    used = rows.groupBy("fp", "salt").agg(F.lit(1).alias("_")).drop("_")
    return rows.join(used.join(answer, "fp"), ["fp", "salt"]).select("id", "fp", "component_id")


def near_texts(texts: DataFrame, shingle: int = SHINGLE, distance: int = MAX_DISTANCE, pair_cost: float = PAIR_COST, few: int = 0) -> DataFrame:
    """a, b (a < b): pairs of texts with at most `distance` differing bits, which connect all that such pairs connect.

    texts: s, text, with s distinct and not null. Texts with one fingerprint are paired with the one of the least s. An
    empty table gives no rows. few: as of components().
    """
    rows = checkpointed(fingerprints(texts, "s", "text", shingle))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("s"), F.count("*").alias("n")))
    pairs = near_links(distinct.select("fp"), distance, pair_cost=pair_cost, stars_too=False, few=few)
    for end in ("u", "v"):
        pairs = pairs.join(distinct.hint("merge").select(F.col("fp").alias(f"fp_{end}"), F.col("s").alias(f"s_{end}")), F.col(end) == F.col(f"fp_{end}"))
    same = rows.join(small_or_shuffled(distinct.filter("n > 1").select("fp", "s")), "fp").select(F.col("s").alias("s_u"), F.col("id").alias("s_v"))
    pairs = pairs.select("s_u", "s_v").unionByName(same).filter("s_u <> s_v")
    return checkpointed(pairs.select(F.least("s_u", "s_v").alias("a"), F.greatest("s_u", "s_v").alias("b")).distinct())


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
