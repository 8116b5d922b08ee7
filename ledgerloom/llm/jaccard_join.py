"""Similarity join of documents on word shingles, by vertical partitioning.

All shingles have one global order, rarer ones first as a count sketch of fixed
size sees them. The order is cut into fragments, and each set into a row for
each fragment that it has shingles in. Candidate pairs share a shingle of their
prefixes in the order. Partial overlaps are counted for each pair and fragment,
where the rows of both sets meet, and summed for each pair. Only links that can
still join two classes are asked for: first each group of candidates against
hubs, round by round, then members of like sizes whose classes differ. So a
group of thousands of near copies needs about as many pairs as it has members,
and no link between classes is missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import NO_ID, NON_SPACE, Words, bloom_has, chunks, grams, id_text, mix64, named, owner, pack, pack_planes, pack_sorted, stage, stage_only, unnamed, unpack, unpack_planes, unpack_sorted

SHINGLE = 5
THRESHOLD = 75  # per cent
FRAGMENTS = 4
#: Hubs that each group of candidates is compared with, round by round, before its members are compared with each other. Where they are one, a set that is in several groups is compared with the first hub of all.
HUBS = (1, 1, 8, 64)
#: A shingle that the sketch counts so often is not gathered in one task; its level is a logarithm of this.
HOT_COUNT = 50_000
#: Pairs that are sent to all tasks, about 50 bytes each; more of them are shuffled.
BROADCAST_PAIRS = 250_000
#: Cells of the sketch at most (64 MiB), cells of it that are added together, and tasks that are added at a time.
MOST_CELLS, PIECE, TREE = 1 << 24, 1 << 14, 64
#: Entries of a bucket of shingles, about.
BUCKET_ROWS = 500_000
#: Entries (33 bytes each) that a task gathers before it deals them to buckets, about: there are more buckets on larger tables, and rows of a few entries each would take more room than these.
DEALT_ROWS = 250_000

SET_SCHEMA = "doc_id long, n long, node binary, kind int, piece int, part int, body binary"
PIECE_SCHEMA = "piece int, part int, body binary"
TOKEN_SCHEMA = "bucket int, tokens binary, nodes binary, names binary, sizes binary, rests binary"


def buckets_for(words: int, rows: int = BUCKET_ROWS) -> int:
    """A power of two of buckets for so many words, 64 at least."""
    n = 64
    while n * rows < words // 4:
        n *= 2
    return n


def shingle_sets(texts: list, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the first of each text (one entry more). A text of fewer than k words has its whole sequence as one; a text without words has none."""
    w = Words(texts, NON_SPACE, lower=True)
    h, first = grams(w, k)
    of, counts = owner(first), w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            whole[has] = mix64(whole[has], 31 + j) + w.hashes[w.first[short[has]] + j]
        h, of = np.concatenate([h, mix64(whole ^ counts[short].astype(np.uint64), 77)]), np.concatenate([of, short])
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16) if len(texts) < 1 << 16 else of[order], kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def node_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name of 128 bits for each set, in two halves, the same for equal sets."""
    one, two = _sums(mix64(h, 51), first), _sums(mix64(h, 52), first)
    return mix64(one ^ mix64(two, 53)), mix64(_sums(mix64(h, 54), first) ^ mix64(two, 55))


def _names(node: np.ndarray, alt: np.ndarray) -> list[bytes]:
    both = np.column_stack((node, alt)).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def _halves(names) -> np.ndarray:
    return np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)


def measure(docs: DataFrame, cells: int, k: int) -> DataFrame:
    """One pass: kind 0 has each document's set size and name; kind 1 has pieces of each task's count sketch over all shingles."""

    def emit(it):
        sketch = np.zeros(cells, np.uint32)
        shift = np.uint64(64 - cells.bit_length() + 1)
        for pdf in it:
            ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["text"].to_list()
            for lo, hi in chunks(texts):
                h, first = shingle_sets(texts[lo:hi], k)
                np.add.at(sketch, (h >> shift).astype(np.int64), 1)
                yield pd.DataFrame({"doc_id": ids[lo:hi], "n": np.diff(first), "node": _names(*node_of(h, first)), "kind": 0, "piece": 0, "part": 0, "body": None})
        part = TaskContext.get().partitionId()
        for i in range(0, cells, PIECE):
            if sketch[i : i + PIECE].any():
                yield pd.DataFrame({"doc_id": [NO_ID], "n": [0], "node": [None], "kind": [1], "piece": [i // PIECE], "part": [part], "body": [pack_planes(sketch[i : i + PIECE])]})

    return docs.mapInPandas(emit, SET_SCHEMA)


def _add_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1, np.uint64)
    for b in pdf["body"]:
        total = total + unpack_planes(b, np.uint32)
    return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "part": [pdf["part"].iloc[0]], "body": [pack_planes(np.minimum(total, 2**32 - 1).astype(np.uint32))]})


def whole_sketch(pieces: DataFrame, cells: int) -> np.ndarray:
    """The sum of all tasks' sketches, added as a tree: no step holds more than TREE tasks' copies of a piece."""
    pieces = pieces.select("piece", "part", "body")
    tasks = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > 1:
        pieces = pieces.withColumn("part", F.floor(F.col("part") / TREE).cast("int")).groupBy("piece", "part").applyInPandas(_add_pieces, PIECE_SCHEMA)
        tasks = -(-tasks // TREE)
    out = np.zeros(cells, np.uint32)
    for r in pieces.toLocalIterator():
        body = unpack_planes(bytes(r["body"]), np.uint32)
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(body)] = body
    return out


class Order:
    """The global order of shingles: by level (a logarithm of the sketch's count), then by hash; and its cuts into fragments of about equal counts."""

    def __init__(self, sketch: np.ndarray, fragments: int):
        self.bits = len(sketch).bit_length() - 1
        self.levels = np.minimum(8 * np.log2(1.0 + sketch), 255).astype(np.uint8)
        cells = np.argsort(self.levels, kind="stable")
        mass = np.cumsum(sketch[cells], dtype=np.float64)
        at = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments)
        cell = cells[np.minimum(at, len(cells) - 1)]
        self.cuts = (self.levels[cell].astype(np.uint64) << np.uint64(56)) | (cell.astype(np.uint64) << np.uint64(56 - self.bits))

    def level(self, h: np.ndarray) -> np.ndarray:
        return self.levels[(h >> np.uint64(64 - self.bits)).astype(np.int64)]

    def fragment(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, (self.level(h).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)), "right")


def _by_bucket(keys: np.ndarray, buckets: int):
    """Bounds of each bucket that has some of the sorted keys."""
    b = (keys >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)
    cut = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
    return zip(b[cut[:-1]].tolist(), cut, cut[1:], strict=False)


def prefix_rows(docs: DataFrame, order, buckets: int, k: int, threshold: int, hot_count: int = HOT_COUNT) -> DataFrame:
    """Shingles of sets' prefixes as sorted arrays by bucket of the hash range, those of some chunks of texts together and equal sets of a chunk once. Shingles that the sketch takes for very frequent get buckets of these chunks' own."""
    hot_level = int(8 * np.log2(1 + hot_count))

    def deal(held: list, number: int) -> pd.DataFrame:
        rows, (tok, node, alt, size, rest, hot) = [], (np.concatenate(x) for x in zip(*held, strict=True))
        for is_hot, some in ((False, np.flatnonzero(~hot)), (True, np.flatnonzero(hot))):
            at = some[np.argsort(tok[some], kind="stable")]
            t = tok[at]
            # Frequent ones get a bucket of their own: its number only spreads them.
            cuts = _by_bucket(t, buckets) if not is_hot else [(-1 - (number & 0x3FFFFFFF), 0, len(t))] if len(t) else []
            rows += [(b, pack_sorted(t[i:j]), pack(node[at[i:j]]), pack(alt[at[i:j]]), pack_planes(size[at[i:j]]), pack_planes(rest[at[i:j]])) for b, i, j in cuts]
        return pd.DataFrame(rows, columns=["bucket", "tokens", "nodes", "names", "sizes", "rests"])

    def emit(it):
        number = TaskContext.get().partitionId() << 10
        held, n = [], 0
        for pdf in it:
            texts = pdf["text"].to_list()
            for lo, hi in chunks(texts):
                h, first = shingle_sets(texts[lo:hi], k)
                (node, alt), size = node_of(h, first), np.diff(first)
                alone = np.zeros(len(size), bool)
                by = np.lexsort((alt, node))
                alone[by] = np.concatenate([[True], (node[by][1:] != node[by][:-1]) | (alt[by][1:] != alt[by][:-1])])
                of, level = owner(first), order.value.level(h)
                by = np.argsort(level, kind="stable")
                by = by[np.argsort(of[by].astype(np.uint16) if hi - lo < 1 << 16 else of[by], kind="stable")]
                rest = (size + first[:-1])[of] - np.arange(len(h))
                keep = (rest * 100 >= threshold * size[of]) & alone[of]
                by, of, rest = by[keep], of[keep], rest[keep]
                held.append((h[by], node[of], alt[of], size[of].astype(np.uint32), rest.astype(np.uint32), level[by] >= hot_level))
                n += len(by)
                if n >= DEALT_ROWS:
                    yield deal(held, number := number + 1)
                    held, n = [], 0
        if n:
            yield deal(held, number + 1)

    return docs.mapInPandas(emit, TOKEN_SCHEMA)


def prefix_groups(docs: DataFrame, order, buckets: int, k: int, threshold: int, hot_count: int = HOT_COUNT) -> DataFrame:
    """(token, node, size, rest): groups of sets that share a shingle of their prefixes; rest counts a set's shingles from that one on.

    Shingles meet by bucket. Those that the sketch takes for very frequent leave
    as rows at once, for later aggregates and joins that split large keys; so a
    bucket holds at most ``hot_count`` entries of a shingle.
    Groups with the same members become one, named by a hash of these, with each
    member's largest rest; members that no other one of the group can link to go.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {"nodes": np.uint64, "names": np.uint64, "sizes": np.uint32, "rests": np.uint32}
        tok, sets = np.concatenate([unpack_sorted(b) for b in pdf["tokens"]]), [np.concatenate([unpack_planes(b, kind) if kind is np.uint32 else unpack(b, kind) for b in pdf[c]]) for c, kind in kinds.items()]
        if pdf["bucket"].iloc[0] >= 0:
            tok, *sets = _one_each(tok, *sets)
            bounds = np.append(np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])), len(tok)) if len(tok) else np.zeros(1, np.int64)
            name = np.repeat(node_of(sets[0] ^ mix64(sets[1], 5), bounds)[0], np.diff(bounds))
            tok, *sets = _able(*_one_each(*_able(name, *sets, threshold)), threshold)
        node, alt, size, rest = sets
        return pd.DataFrame({"token": tok.view(np.int64), "node": _names(node, alt), "size": size.astype(np.int64), "rest": rest.astype(np.int64)})

    return prefix_rows(docs, order, buckets, k, threshold, hot_count).groupBy("bucket").applyInPandas(group, "token long, node binary, size long, rest long")


def _one_each(tok, node, alt, size, rest):
    """Each member of a group once, with its largest rest, by group and node."""
    by = np.lexsort((rest, alt, node, tok))
    tok, node, alt = tok[by], node[by], alt[by]
    last = np.ones(len(tok), bool)
    last[:-1] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1]) | (alt[1:] != alt[:-1])
    return tok[last], node[last], alt[last], size[by[last]], rest[by[last]]


def _able(tok, node, alt, size, rest, threshold: int):
    """Without members that can't link to any other one of their group by sizes and rests, and without groups of one. Rows are grouped by tok before and after."""
    if not len(tok):
        return tok, node, alt, size, rest
    t, s, r = threshold, size.astype(np.int64), rest.astype(np.int64)
    gain = (100 + t) * r - t * s  # at least t times the other's size
    new = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    count = np.diff(np.append(new, len(tok)))
    of = np.repeat(np.arange(len(new)), count)

    def best_other(v):
        """For each row the largest v among the others of its group."""
        by = np.lexsort((v, of))
        top, second = by[new + count - 1], by[new + np.maximum(count - 2, 0)]
        out = v[top][of]
        out[top] = v[second]
        return out

    keep = (best_other(gain) >= t * s) & (-t * best_other(-s) <= gain) & (count > 1)[of]
    tok, *sets = (x[keep] for x in (tok, node, alt, size, rest))
    if not len(tok):
        return tok, *sets
    edge = np.concatenate([[True], tok[1:] != tok[:-1], [True]])
    several = ~(edge[:-1] & edge[1:])
    return tok[several], *(x[several] for x in sets)


def fragment_rows(docs: DataFrame, wanted, order, fragments: int, k: int) -> DataFrame:
    """(node, fragment, counts, shingles): each set cut by fragments of the order, a row for each that it has shingles in; counts has the sizes of all. Only sets whose (node, doc_id) the filter ``wanted`` has (None: all, each once); others that pass it do no harm."""

    def emit(it):
        for pdf in it:
            ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["text"].to_list()
            for lo, hi in chunks(texts):
                h, first = shingle_sets(texts[lo:hi], k)
                node, alt = node_of(h, first)
                take = np.arange(hi - lo) if wanted is None else np.flatnonzero(bloom_has(wanted.value, mix64(node ^ mix64(ids[lo:hi].view(np.uint64), 61))))
                out, names = [], _names(node, alt)
                for d in take:
                    own = h[first[d] : first[d + 1]]
                    f = order.value.fragment(own)
                    counts = np.bincount(f, minlength=fragments)
                    parts = np.split(own[np.argsort(f, kind="stable")].view(np.int64), np.cumsum(counts)[:-1])
                    out += [(names[d], i, counts, x) for i, x in enumerate(parts) if len(x)]
                yield pd.DataFrame(out, columns=["node", "fragment", "counts", "shingles"])

    cut = docs.mapInPandas(emit, "node binary, fragment int, counts array<int>, shingles array<long>")
    return cut if wanted is not None else cut.dropDuplicates(["node", "fragment"])


def partial_overlaps(pairs: DataFrame, rows: DataFrame, threshold: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(a, b, a_size, b_size, fragment, overlap, room): the shingles that both sets of a pair have in a fragment, and how many they could have in the others. Pairs whose fragments' sizes allow no link are left out. Sets that no pair names stay where they are as long as the pairs are few enough to be sent to them."""
    few = F.broadcast if pairs.count() <= broadcast_pairs else lambda d: d
    pairs = pairs.select("a", "b", "a_size", "b_size")
    left = rows.select(F.col("node").alias("a"), "fragment", F.col("counts").alias("a_counts"), F.col("shingles").alias("left")).join(few(pairs), "a")
    right = rows.select(F.col("node").alias("b"), "fragment", F.col("counts").alias("b_counts"), F.col("shingles").alias("right")).join(few(pairs.select("b").distinct()), "b", "left_semi")
    least = F.zip_with("a_counts", "b_counts", lambda x, y: F.least(x, y))
    most = F.aggregate(least, F.lit(0), lambda n, x: n + x)
    met = left.join(right, ["b", "fragment"]).where(_reaches(most, threshold))
    return met.select("a", "b", "a_size", "b_size", "fragment", F.size(F.array_intersect("left", "right")).alias("overlap"), (most - F.get(least, F.col("fragment"))).alias("room"))


def _reaches(overlap, threshold: int):
    """Whether such an overlap links a pair."""
    return (100 + threshold) * overlap >= threshold * (F.col("a_size") + F.col("b_size"))


def linked(pairs: DataFrame, rows: DataFrame, threshold: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over fragments, reaches the threshold. The rarest fragment is counted first: pairs that all the others could not make up for end there."""

    def once(parts: DataFrame) -> DataFrame:
        # A fragment may be there twice (rows that repeat a doc_id), with the same count.
        return parts.repartition("a", "b").groupBy("a", "b", "fragment").agg(F.max("overlap").alias("overlap"), F.max("room").alias("room"))

    rarest = once(partial_overlaps(pairs, rows.where("fragment = 0"), threshold, broadcast_pairs)).select("a", "b", "overlap", "room")
    # Without a row, one of the sets has nothing in that fragment, or no link is possible.
    left = pairs.join(rarest, ["a", "b"], "left").where(F.col("room").isNull() | _reaches(F.col("overlap") + F.col("room"), threshold))
    left = stage(left.select("a", "b", "a_size", "b_size", F.coalesce("overlap", F.lit(0)).alias("so_far")), "open-pairs")
    others = once(partial_overlaps(left, rows.where("fragment > 0"), threshold, broadcast_pairs)).groupBy("a", "b").agg(F.sum("overlap").alias("more"))
    return left.join(others, ["a", "b"], "left").where(_reaches(F.col("so_far") + F.coalesce("more", F.lit(0)), threshold)).select("a", "b")


def merge_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) after joining the classes at both ends of links: every class points to its smallest neighbour, edges are contracted, until none is left."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if labels is not None:
        for c in "uv":
            edges = edges.join(labels.select(F.col("node").alias(c), F.col("label").alias("_l")), c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
    own = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct().select("node", F.col("node").alias("label"))
    base = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = own if labels is None else labels.unionByName(own.join(labels.select("node"), "node", "left_anti"))
    if labels is not None:
        known = known.unionByName(base.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))
    known, edges = stage(known, "labels"), stage(edges.where("u != v").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        known = stage(known.join(parent, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        for c in "uv":
            edges = edges.join(parent.select(F.col("u").alias(c), F.col("p").alias("_p")), c, "left").withColumn(c, F.coalesce("_p", c)).drop("_p")
        edges = stage(edges.where("u != v").distinct(), "edges")
    return known


def _with_labels(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return groups.withColumn("label", F.col("node"))
    return groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _able_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows of a node and a hub that sizes and rests allow to link."""
    return rows.where(((100 + threshold) * F.least("rest", "hub_rest") >= threshold * (F.col("size") + F.col("hub_size"))) & (F.col("node") != F.col("hub")))


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a node and a hub, each once and in order."""
    first = F.col("node") < F.col("hub")
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select(side("node", "hub").alias("a"), side("hub", "node").alias("b"), side("size", "hub_size").alias("a_size"), side("hub_size", "size").alias("b_size")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD, fragments: int = FRAGMENTS, hubs_per_round: tuple[int, ...] = HUBS, most_cells: int = MOST_CELLS, most_bits: int = shared.MOST_BITS, hot_count: int = HOT_COUNT, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    A set is a text's distinct k-word shingles, A-Z lower-cased; sets link when
    100 * intersection >= threshold * union. component_id is the smallest doc_id
    that links reach.

    Null or empty texts, or texts of white space, have no shingles and are their
    own component. Null doc_ids can link but never name a component that has
    another. Rows that repeat a doc_id are looked at one by one. An empty table
    gives an empty result; other columns are not looked at. Equal sets are one
    node of the join, named by 128 bits. ``most_cells``, ``most_bits``,
    ``hot_count`` and ``broadcast_pairs`` bound what a task holds or is sent;
    results are the same for all values.
    """
    thin, spark = named(id_text(docs, id_col, text_col)), docs.sparkSession
    words = (thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    cells = PIECE
    while cells < min(words // 32, most_cells):
        cells *= 2
    measured = stage(measure(thin, cells, k), "sets")
    order = spark.sparkContext.broadcast(Order(whole_sketch(measured.where("kind = 1"), cells), fragments))
    sets = measured.where("kind = 0").select("doc_id", "n", "node")

    # Groups with the same members come from several buckets: once is enough. A set's own groups are counted, for what is in many of them is a good hub.
    def counted() -> DataFrame:
        found = stage(prefix_groups(thin, order, buckets_for(words), k, threshold, hot_count), "prefixes")
        own = stage(found.groupBy("token", "node", "size").agg(F.max("rest").alias("rest")), "groups")
        return own.join(stage(own.groupBy("node").agg(F.count(F.lit(1)).alias("n_groups")), "counts"), "node")

    groups = stage_only(spark, "counted-groups", counted)

    nodes = stage(groups.select("node").distinct().join(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")), "node").mapInPandas(_marks, "h long"), "nodes")
    n = shared.bloom_segments(nodes.count(), most_bits=most_bits)
    wanted = spark.sparkContext.broadcast(shared.build_bloom(nodes, "h", n)) if n else None
    rows = stage(fragment_rows(thin, wanted, order, fragments, k), "fragments")

    labels, tested = None, []

    def join(pairs: DataFrame) -> bool:
        nonlocal labels
        if tested:
            pairs = pairs.join(spark.read.schema("a binary, b binary").parquet(*tested), ["a", "b"], "left_anti")
        path = shared.new_path(spark, "pairs")
        pairs.write.parquet(path)
        pairs = spark.read.schema(pairs.schema).parquet(path)
        if pairs.isEmpty():
            return False
        tested.append(path)
        labels = merge_labels(labels, stage(linked(pairs, rows, threshold, broadcast_pairs), "links"))
        return True

    for r, hubs_each in enumerate(hubs_per_round):
        seen = _with_labels(groups, labels)
        # The member of most groups first, then some members by chance; dealt out, so that no group is gathered whole.
        by = -F.col("n_groups") if r == 0 else F.xxhash64("node", F.lit(r))
        rank = F.struct(by.alias("by"), "size", "node")
        dealt = F.pmod(F.xxhash64("node", F.lit(-r)), F.lit(hubs_each))
        part = seen.groupBy("token", dealt.alias("part")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("node", "size", "rest", "label", by.alias("by")), rank).alias("h"))
        part = stage(part, "hubs")
        mixed = part.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("token")
        hubs = part.join(mixed, "token", "left_semi").select("token", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.rest").alias("hub_rest"), F.col("h.label").alias("hub_label"), F.col("h.by").alias("hub_by"))
        # Written first, hubs don't share the members' partitioning, and the join can split a large group's members.
        asked = _able_pairs(seen.join(stage(hubs, "hubs"), "token").where("label != hub_label"), threshold)
        if hubs_each == 1:
            first = F.min_by(F.struct("size", "hub", "hub_size"), F.struct("hub_by", "hub_size", "hub")).alias("h")
            asked = asked.groupBy("node").agg(first).select("node", "h.*")
        if not join(_pairs(asked)):
            break
    # What is left: members of a group that are still in different classes, against those of their own and the neighbouring bands of sizes.
    seen = _with_labels(groups, labels)
    mixed = stage(seen.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token"), "mixed")
    # A band's sizes differ by the threshold's ratio (and a little, for rounding), so that links reach one band further at most.
    band = F.floor(F.log("size") / F.lit(1.000001 * float(np.log(100 / threshold)) if threshold < 100 else 1.0))
    left = stage(seen.join(mixed, "token", "left_semi").withColumn("band", band), "apart")
    other = left.select("token", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("rest").alias("hub_rest"), F.col("label").alias("hub_label"))
    join(_pairs(_able_pairs(left.join(other, ["token", "band"]).where(F.col("label") < F.col("hub_label")), threshold)))

    out = sets.withColumn("label", F.col("node")) if labels is None else sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    out = stage(unnamed(out.select("doc_id", "n", "label")), "classes")
    least = out.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("label", "least", F.lit(True).alias("joined"))
    # Written first, the classes don't share the rows' partitioning, and the join can split a large class's rows.
    return out.join(stage(least, "least"), "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("joined"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _marks(it):
    for pdf in it:
        least = pdf["least"].to_numpy(np.int64).view(np.uint64)
        yield pd.DataFrame({"h": mix64(_halves(pdf["node"])[:, 0] ^ mix64(least, 61)).view(np.int64)})
