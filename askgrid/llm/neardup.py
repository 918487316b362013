"""Near-duplicate documents by a chosen-path set similarity join.

Every distinct shingle set becomes one vertex (exact copies collapse first). In each of
``TREES`` independent trees a document walks down by its minwise tokens: the node at depth d
is named by the first d tokens it chose. A node with at most ``LEAF`` documents is a leaf and
its documents are compared with each other; larger nodes branch on, at most ``DEPTH`` times.
A pair of similarity s shares a leaf of depth d in one tree with probability s^d, so all 16
trees miss a pair of 0.85 with probability 1e-13 at depth 1 and 3e-7 at depth 3.

Comparing is in two rounds: first every leaf member against the leaf's hub (the member closest
to the leaf's majority sketch), then only pairs that the first round left in different
components. Both rounds are pre-filtered by size and by a 256-bit sketch, and confirmed on full
sets. No candidate is capped: the second round takes all that remain, small leaves pair by
pair, large leaves in blocks of ``BLOCK`` x ``BLOCK`` whose common tokens one matrix product
counts, so a family of m near copies emits about m links and never its m^2 pairs.

Defined results: null or blank text has an empty set, is linked with nothing and is its own
component; rows repeated whole get equal results; a null doc_id takes no part (component
null, kept). Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm import textcore
from askgrid.llm.workspace import forget, lean_batches, written

TREES, DEPTH, LEAF, HASHES, BLOCK = 16, 3, 16, 128, 512
SKETCH = ("s0", "s1", "s2", "s3")  # two bits of each minwise value
#: Rows of 8 bytes that a broadcast may hold; beyond it the same join shuffles.
BROADCAST_IDS = 2_000_000

_MULTIPLY = textcore.stream(11, HASHES)[:, None] | np.uint64(1)
_ADD = textcore.stream(12, HASHES)[:, None]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """HASHES minwise values of a set of 64-bit tokens."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 1024):
        best = np.minimum(best, (tokens[None, at : at + 1024] * _MULTIPLY + _ADD).min(axis=1))
    return best


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, bits, paths = [], [], [], [], []
            for body in textcore.as_bytes(batch.column(1)):
                tokens = textcore.shingle_set(body, words) if body is not None else np.zeros(0, np.uint64)
                least = textcore.mix(sketch(tokens))
                n.append(len(tokens))
                one.append(int(tokens.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(textcore.mix(tokens + np.uint64(7))).view(np.int64)) if len(tokens) else 0)
                pair = np.concatenate([least & np.uint64(1), (least >> np.uint64(1)) & np.uint64(1)])
                bits.append(np.packbits(pair.astype(bool)).view(">i8").astype(np.int64))
                paths.append(least[: TREES * DEPTH].view(np.int64))
            flat = pa.array(np.concatenate(paths) if paths else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(paths) + 1, dtype=np.int32) * TREES * DEPTH)
            bits = np.array(bits, np.int64).reshape(-1, len(SKETCH))
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, one, two)], *[pa.array(bits[:, k]) for k in range(len(SKETCH))], pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "one", "two", *SKETCH, "paths"])
        textcore.release()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [textcore.shingle_set(b, words).view(np.int64) if b is not None else np.zeros(0, np.int64) for b in textcore.as_bytes(part.column(1))]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["id", "tokens"])

    return run


def _far(percent: int) -> int:
    """Sketch bits that may differ: 5.5 standard deviations beyond a pair at the threshold.

    Each of HASHES values gives two bits: both agree if the minwise tokens do (chance p), else each with chance 1/2.
    """
    p = percent / 100
    deviation = (HASHES * p * (1 - p) + HASHES * (1 - p) / 2) ** 0.5
    return int(HASHES * (1 - p) + 5.5 * deviation)


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether two sketched sets may be similar enough: sizes and sketches, of columns x_n, x_s0 ... and y_n, y_s0 ..."""
    off = sum((F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{x}{SKETCH[0]}").bitwiseXOR(F.col(f"{y}{SKETCH[0]}"))))
    return (F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * percent) & (off <= _far(percent))


def _named(prefix: str, *columns: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in columns]


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches, from links (a, b).

    Alternating large-star and small-star rounds; each round is written, so lineage stays short
    and a lost executor repeats one round at most. An id with very many links is one key of a
    shuffled join only, which adaptive execution splits.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        forget(edges)
        forget(large)
        edges = after


def _token_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, tokens) of the documents in ``ids``."""
    ids = written(ids.distinct(), "candidates")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return written(texts.mapInArrow(_sets(words), "id long, tokens array<long>"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = _token_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, words)
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    links = written(both.where(F.col("common") * 100 >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b").distinct(), "links")
    forget(sets)
    return links


def _block_links(percent: int):
    """Links between the left and right members of a block whose roots differ, one for each pair of roots they join."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["left"]].reset_index(drop=True), frame[~frame["left"]].reset_index(drop=True)]
        found: list[tuple[int, int]] = []
        if len(sides[0]) and len(sides[1]):
            sizes = [np.array([len(t) for t in f["tokens"]], np.int64) for f in sides]
            tokens, which = np.unique(np.concatenate([np.asarray(t) for f in sides for t in f["tokens"]]), return_inverse=True)
            owner = np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes))
            shared = np.bincount(which)[which] > 1
            which, owner = which[shared], owner[shared]
            order = np.argsort(which, kind="stable")
            which, owner = which[order], owner[order]
            common = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
            for at in range(0, int(which[-1]) + 1 if len(which) else 0, 8192):  # tokens in slices, so the matrices stay small
                lo, hi = np.searchsorted(which, (at, at + 8192))
                grid = np.zeros((len(common) + common.shape[1], 8192), np.float32)
                grid[owner[lo:hi], which[lo:hi] - at] = 1
                common += grid[: len(common)] @ grid[len(common) :].T
            either = sizes[0][:, None] + sizes[1][None, :] - common
            near = (common * 100 >= percent * either) & (sides[0]["root"].to_numpy()[:, None] != sides[1]["root"].to_numpy()[None, :])
            joined: dict[int, int] = {}

            def top(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            for i, j in zip(*np.nonzero(near)):
                a, b = top(int(sides[0]["root"][i])), top(int(sides[1]["root"][j]))
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    found.append((int(sides[0]["id"][i]), int(sides[1]["id"][j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _leaves(reps: DataFrame) -> DataFrame:
    """(leaf, size, id, n and sketch): the chosen-path leaves with at least two documents."""
    here = reps.where("n > 0")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")
    walk = here.select("id", "n", *SKETCH, tree, "paths")
    name = F.xxhash64("t", F.col("paths")[F.col("t") * DEPTH])
    walk = walk.select("id", "n", *SKETCH, name.alias("p1"), *[F.col("paths")[F.col("t") * DEPTH + d].alias(f"m{d + 1}") for d in range(1, DEPTH)])
    found = []
    for depth in range(1, DEPTH + 1):
        node = f"p{depth}"
        sizes = walk.groupBy(node).agg(F.count("*").alias("size")).where("size > 1")
        rest = [f"m{d}" for d in range(depth + 1, DEPTH + 1)]
        level = written(walk.join(written(sizes, "nodes"), node).select("id", "n", *SKETCH, node, "size", *rest), f"level-{depth}")
        last = depth == DEPTH
        found.append(level.where(F.lit(True) if last else F.col("size") <= LEAF).select(F.col(node).alias("leaf"), "size", "id", "n", *SKETCH))
        if not last:
            walk = level.where(F.col("size") > LEAF).select("id", "n", *SKETCH, F.xxhash64(node, f"m{depth + 1}").alias(f"p{depth + 1}"), *rest[1:])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _hubs(leaves: DataFrame) -> DataFrame:
    """(leaf, h_id, h_n, h_s0 ...): of each leaf the member closest to its majority sketch; in small leaves the smallest id."""
    long = lambda x: F.lit(x).cast("long")
    big = leaves.where(F.col("size") > LEAF)
    # A quarter of the sketch places the hub well enough; the choice decides the work left over, not the result.
    s = SKETCH[0]
    votes = big.groupBy("leaf").agg(F.count("*").alias("votes"), *[F.sum(F.shiftright(s, j).bitwiseAND(long(1))).alias(f"b{j}") for j in range(64)])
    major = long(0)
    for j in range(64):
        major = major.bitwiseOR(F.when(F.col(f"b{j}") * 2 > F.col("votes"), F.shiftleft(long(1), j)).otherwise(long(0)))
    majority = written(votes.select("leaf", major.alias("major")), "majority")
    off = F.bit_count(F.col(s).bitwiseXOR(F.col("major")))
    member = ("id", "n", *SKETCH)
    near = big.join(majority, "leaf").select("leaf", F.struct(off.alias("off"), *member).alias("h"))
    small = leaves.where(F.col("size") <= LEAF).select("leaf", F.struct(F.lit(0).alias("off"), *member).alias("h"))
    return near.unionByName(small).groupBy("leaf").agg(F.min("h").alias("h")).select("leaf", *[F.col(f"h.{c}").alias(f"h_{c}") for c in member])


def _across(placed: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Links inside large leaves between members of different components, ``placed`` having each member's root and its hub's."""
    member = ("id", "n", *SKETCH, "root")
    apart = placed.where("root <> hub_root").select("leaf", *_named("a_", *member))
    other = placed.select("leaf", *_named("", *member))
    may = _alike("", "a_", percent) & (F.col("root") != F.col("a_root"))
    # Semi joins: at most a row for each member, however many partners it may have.
    left = written(apart.join(other, (apart["leaf"] == other["leaf"]) & may, "left_semi"), "apart")
    right = other.join(left.select(F.col("leaf").alias("a_leaf"), *[c for c in left.columns if c != "leaf"]), (F.col("leaf") == F.col("a_leaf")) & may, "left_semi")
    right = written(right.select("leaf", "id", "root"), "partners")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("live") / BLOCK)).cast("int")
    live = right.groupBy("leaf").agg(F.count("*").alias("live")).select("leaf", blocks.alias("blocks"))
    own, every = F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = left.select("leaf", F.col("a_id").alias("id"), F.col("a_root").alias("root")).join(live, "leaf").select("leaf", "id", "root", F.lit(True).alias("left"), own.alias("i"), every.alias("j"))
    rows = rows.unionByName(right.join(live, "leaf").select("leaf", "id", "root", F.lit(False).alias("left"), every.alias("i"), own.alias("j")))
    sets = _token_sets(right.select("id").union(left.select("a_id")), docs, words)
    links = rows.join(sets, "id").groupBy("leaf", "i", "j").applyInPandas(_block_links(percent), "a long, b long")
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "block-links")
    forget(sets)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked where 100 * |A and B| >= percent * |A or B| over their distinct
    ``words``-word shingles; a component is what links reach and its id the smallest doc_id in it.
    """
    lean_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id long, n long, one long, two long, {', '.join(f'{s} long' for s in SKETCH)}, paths array<long>"
    features = written(docs.mapInArrow(_features(words), schema), "features")
    known = features.where("id is not null")
    # A class is one distinct set; the join back carries a few bytes a document.
    classes = written(known.where("n > 0").groupBy("n", "one", "two").agg(F.min("id").alias("class"), F.count("*").alias("copies")), "classes")
    reps = known.join(classes.select("n", "one", "two", F.col("class").alias("id")), ["n", "one", "two", "id"]).select("id", "n", *SKETCH, "paths")
    reps = written(reps.dropDuplicates(["id", "n", *SKETCH]), "reps")
    leaves = written(_leaves(reps), "leaves")
    hubs = written(_hubs(leaves), "hubs")

    stars = leaves.join(hubs, "leaf").where((F.col("id") != F.col("h_id")) & _alike("", "h_", percent))
    stars = written(stars.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct(), "stars")
    links = _confirmed(stars, docs, percent, words)
    roots = components(links)

    # What the hubs left apart: members outside their hub's component, against all others of the leaf.
    placed = leaves.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    hub_roots = hubs.select("leaf", F.col("h_id").alias("id")).join(roots, "id", "left").select("leaf", F.coalesce("root", "id").alias("hub_root"))
    placed = written(placed.join(hub_roots, "leaf"), "placed")
    small = placed.where(F.col("size") <= LEAF)
    member = ("id", "n", *SKETCH, "root")
    apart = small.where("root <> hub_root").select("leaf", *_named("a_", *member))
    pairs = small.join(apart, "leaf").where((F.col("root") != F.col("a_root")) & _alike("", "a_", percent))
    pairs = written(pairs.select(F.least("id", "a_id").alias("a"), F.greatest("id", "a_id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    known_links = more = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))  # components so far, as stars
    if not pairs.isEmpty():
        more = more.unionByName(_confirmed(pairs, docs, percent, words))
    large = placed.where(F.col("size") > LEAF)
    if not large.where("root <> hub_root").isEmpty():
        more = more.unionByName(_across(large, docs, percent, words))
    if more is not known_links:
        roots = components(more)
    for gone in (reps, leaves, hubs, stars, placed, pairs):
        forget(gone)

    # Only classes with copies and linked vertices move; all others keep their own id.
    members = features.select("id", "n", "one", "two")
    shared = classes.where("copies > 1").drop("copies")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_IDS // 4 else shared
    members = members.join(shared, ["n", "one", "two"], "left").withColumn("class", F.coalesce("class", "id"))
    roots = roots.select(F.col("id").alias("class"), "root")
    out = members.join(roots, "class", "left").withColumn("component_id", F.coalesce("root", "class"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
