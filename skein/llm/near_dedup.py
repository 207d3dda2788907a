"""MinHash near-dedup with tensored banding.

A document's set is its distinct 5-word shingles.  Documents with the same set are one node.  Two small collections of
SIDE half keys each (a half key is a tuple of HALF minhashes) make SIDE x SIDE tables: table (i, j) has the key
(left i, right j).  So 2 x SIDE x HALF minhashes serve SIDE**2 tables of 2 x HALF hashes: the square root of what separate
tables would take.  At a similarity of 0.75 two nodes share no table with a chance of 2 * (1 - 0.75**HALF)**SIDE.

Tables are looked at in two steps.  First each left key links its nodes to its first node, where the two share a right key
too, that is a table; bytes of the half keys tell that, and how many are equal, so that few pairs at all unlike each other
are compared.  Links are confirmed on the full sets, which joins nearly all that belongs together.  Then left keys whose
nodes are still in several components are opened: their nodes are dealt to the tables, and nodes of a table that spans
components meet by left key.  Such a group is settled inside its task: nodes of different components are compared by
signatures of SIGNATURE minhashes, the likeliest first, confirmed on the full sets and merged, and only the links that merged
components leave the task.  A large group is cut into blocks, and pairs of blocks are tasks.  Where many texts share a left
key and a table without being similar, the pairs compared grow with the square of their number n, and the rows dealt to
tasks, each with its text, with n * n / BLOCK; the links stay below n.

Edge cases: null text, or one without words, has an empty set, is linked with nothing and kept.  Fewer words than a
shingle: the whole sequence is one shingle.  Rows that repeat a doc_id are judged each by its own text, and stand in their
components under that doc_id; equal rows stay or go together.  A null doc_id is its own component (null) and is kept.  Extra
columns are ignored by `components` and kept by `dedup`.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.llm import common

#: Words of a shingle, and the similarity (as a fraction) from which two documents are linked.
SHINGLE = 5
SIMILAR = (75, 100)
#: Half keys of each collection, and minhashes of a half key.
SIDE, HALF = 16, 2
#: Half keys that two nodes share at least to be compared: at 0.75 fewer are equal with a chance of 4e-7.
ALIKE = 5
#: Bytes of a signature, of which at least BAR agree: 0.75 x 256 is 192, less 4.9 standard deviations.
SIGNATURE, BAR = 256, 158
#: Nodes, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 2048, 2 << 20
#: Partners of a node that one task compares with it.
PARTNERS = 200

_U = np.uint64
_rng = np.random.default_rng(20240607)
_SEEDS = _rng.integers(1, 1 << 63, 2 * SIDE * HALF, dtype=np.uint64) | _U(1)
_SIGNS = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | _U(1)
_STEPS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | _U(1)


def shingle_sets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct shingle hashes of each document."""
    low, starts, stops, counts = common.words(data, ends, common.NOT_SPACE)
    hashes = common.word_hashes(low, starts, stops)
    sizes = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, sizes) + common.ragged(sizes)
    n_words = np.repeat(np.minimum(counts, SHINGLE), sizes)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    out = n_words.astype(np.uint64)
    for k in range(SHINGLE):
        out += np.where(n_words > k, common.mix(padded[first + k] ^ _STEPS[k]), _U(0)) * _STEPS[k]
    out = common.mix(out)
    doc = np.repeat(np.arange(len(counts)), sizes)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def half_keys(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of 2 x SIDE half keys for each set that isn't empty (0 for empty ones)."""
    full = np.flatnonzero(np.diff(ends))
    out = np.zeros((len(ends) - 1, 2 * SIDE), np.uint64)
    if not len(full):
        return out
    begins = ends[:-1][full]
    for k in range(2 * SIDE):
        key = np.full(len(full), k + 1, np.uint64)
        for r in range(HALF):
            x = (sets ^ _SEEDS[k * HALF + r]) * _U(0xBF58476D1CE4E5B9)
            x ^= x >> _U(32)
            x *= _SEEDS[k * HALF + r]
            key = common.mix(key ^ np.minimum.reduceat(x, begins) + _U(0x9E3779B97F4A7C15))
        out[full, k] = key
    return out


SKETCH = "doc_id long, row_hash long, n_shingles long, set_key binary, keys array<long>, brief array<tinyint>"


def _set_keys(sets: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """A digest of each set; none for empty ones."""
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, set size, a digest of the set, half keys, and a byte of each half key."""

    def run(batches):
        for block in common.blocks(batches, "text"):
            sets, ends = shingle_sets(*common.arrow_bytes(block.column("text")))
            keys = half_keys(sets, ends)
            columns = [block.column("doc_id"), block.column("row_hash"), pa.array(np.diff(ends).astype(np.int64)), pa.array(_set_keys(sets, ends), pa.binary())]
            columns += [_lists(keys.view(np.int64)), _lists((keys & _U(255)).astype(np.uint8).view(np.int8))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_hash", "n_shingles", "set_key", "keys", "brief"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text").mapInArrow(run, SKETCH)


def signatures(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A byte of each of SIGNATURE minhashes, a row for each set that isn't empty."""
    full = np.flatnonzero(np.diff(ends))
    out = np.zeros((len(ends) - 1, SIGNATURE), np.uint8)
    if len(full):
        begins = ends[:-1][full]
        for k, sign in enumerate(_SIGNS):
            least = np.minimum.reduceat(sets * sign >> _U(24), begins)
            out[full, k] = (common.mix(least) & _U(255)).astype(np.uint8)
    return out


def _similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    up, down = SIMILAR
    if len(one) > len(other):
        one, other = other, one
    if not len(one) or len(one) * down < len(other) * up:
        return False
    place = np.minimum(np.searchsorted(other, one), len(other) - 1)
    both = int((other[place] == one).sum())
    return down * both >= up * (len(one) + len(other) - both)


def _own_sets(batches, key: str = "set_key"):
    """(block, row, set) of each row whose text has the set that is wanted; other rows with its doc_id are passed over."""
    for block in common.blocks(batches, "text"):
        sets, ends = shingle_sets(*common.arrow_bytes(block.column("text")))
        found = _set_keys(sets, ends)
        for i, want in enumerate(block.column(key).to_pylist()):
            if found[i] == want:
                yield block, i, sets[ends[i] : ends[i + 1]]


LINKS = "a long, b long"


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], pa.int64()) for k in range(2)], ["a", "b"])


def _texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc, ...) with the texts of the documents of that doc_id."""
    return rows.join(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), "doc").drop("doc")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b): the pairs that are similar on their full sets.

    Pairs meet the text of `a` once per salted group of its partners, not once per pair; groups of a hot `a` are many.
    """
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / PARTNERS))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), groups).cast("int"))
    members = salted.select(F.col("doc_b").alias("doc"), F.col("key_b").alias("set_key"), "a", "salt", "b")
    heads = salted.select(F.col("doc_a").alias("doc"), F.col("key_a").alias("set_key"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct()
    dealt = _texts(heads.unionByName(members), docs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        head, at, found = None, None, []
        for block, i, own in _own_sets(batches):
            a, salt, b = (block.column(c)[i].as_py() for c in ("a", "salt", "b"))
            if b is None:
                head, at = own.copy(), (a, salt)
            elif at == (a, salt) and _similar(own, head):
                found.append((a, b))
            if len(found) >= 10_000:
                yield _link_batch(found)
                found = []
        yield _link_batch(found)

    return dealt.mapInArrow(run, LINKS)


def connected(edges: DataFrame, shelf: common.Shelf) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) reaches.

    Large and small stars in turn: each round links nodes to the smallest neighbour of theirs, with a shuffle for the edges
    and no growth of their number, until nothing changes.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Only smaller neighbours stand here, of which a node has few; a hub's many neighbours are larger.
        down = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        seen = Observation()
        counted = small.where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        now = shelf.put(counted, "edges")
        if seen.get == last:
            break
        last = seen.get
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mates(nodes: DataFrame) -> DataFrame:
    """left, node, head, n: the left keys that n > 1 nodes share, each with the first of them."""
    left = nodes.select("node", F.explode(F.slice("keys", 1, SIDE)).alias("left"))
    shared = left.groupBy("left").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    return left.join(shared, "left")


def _equal(one: Column, other: Column) -> Column:
    """How many elements of two arrays are equal, place by place."""
    return F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda x: x))


def _first_pairs(mates: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, n and the documents and sets of both: nodes and the first node of a left key, if they share a table."""
    pairs = mates.where("node <> head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
    for side in "ab":
        named = nodes.select(F.col("node").alias(side), F.col("doc").alias(f"doc_{side}"), F.col("set_key").alias(f"key_{side}"), F.col("brief").alias(f"brief_{side}"))
        pairs = pairs.join(named, side)
    a, b = F.col("brief_a"), F.col("brief_b")
    shares = _equal(F.slice(a, SIDE + 1, SIDE), F.slice(b, SIDE + 1, SIDE)) > 0
    return pairs.where(shares & (_equal(a, b) >= ALIKE)).drop("brief_a", "brief_b")


def _open_rows(mates: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """left, node, root: the nodes of tables that span components, by left key.

    A left key of two nodes is settled: they have been compared.
    """
    named = mates.where("n > 2").join(roots, "node", "left").select("left", "node", F.coalesce("root", "node").alias("root"))
    several = (F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_ = named.groupBy("left").agg(*several).where("lo <> hi").select("left")
    rights = nodes.select("node", F.slice("keys", SIDE + 1, SIDE).alias("rights"))
    dealt = named.join(open_, "left").join(rights, "node").select("left", "node", "root", F.explode("rights").alias("right"))
    tables = dealt.select(F.xxhash64("left", "right").alias("table"), "left", "node", "root")
    spanning = tables.groupBy("table").agg(*several).where("lo <> hi").select("table")
    return tables.join(spanning, "table").select("left", "node", "root").distinct()


def _settled(rows: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that merge components: what is similar among the nodes of each left key."""
    rows = rows.join(nodes.select("node", "doc", "set_key", "size"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(rows.groupBy("left").agg(blocks.alias("blocks")), "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("doc", "left", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "root", "size", "set_key")
    dealt = _texts(rows, docs).repartition("left", "p", "q").sortWithinPartitions("left", "p", "q", "size", "node")

    def run(batches):
        key, held = None, []
        for block, i, own in _own_sets(batches):
            now = tuple(block.column(c)[i].as_py() for c in ("left", "p", "q"))
            if now != key:
                yield _link_batch(_forest(key, held))
                key, held = now, []
            held.append((*(block.column(c)[i].as_py() for c in ("own", "node", "root")), own.copy()))
        yield _link_batch(_forest(key, held))

    return dealt.mapInArrow(run, LINKS)


def _forest(key: tuple[int, int, int] | None, held: list[tuple]) -> list[tuple[int, int]]:
    """Links among one group's (block, node, root, set), by rising size, that merge its components; n - 1 at most.

    A pair is compared under the first left key that both have, and only if they share a right key too.  If the group is
    one of two blocks, pairs inside a block are another group's.
    """
    if len(held) < 2:
        return []
    left, p, q = key
    own, node, root = (np.array([r[k] for r in held], np.int64) for k in range(3))
    size = np.array([len(r[3]) for r in held])
    ends = np.concatenate([[0], np.cumsum(size)])
    sets = np.concatenate([r[3] for r in held])
    keys, signs = half_keys(sets, ends), signatures(sets, ends)
    first = np.argmax(keys[:, :SIDE].view(np.int64) == left, axis=1)
    cluster = np.unique(root, return_inverse=True)[1]
    out = []
    up, down = SIMILAR
    for r in range(1, len(held)):
        near = np.arange(np.searchsorted(size, size[r] * up / down - 1e-6), r)
        near = near[cluster[near] != cluster[r]]
        if p != q:
            near = near[own[near] != own[r]]
        agree = (signs[near] == signs[r]).sum(axis=1)
        near, agree = near[agree >= BAR], agree[agree >= BAR]
        if not len(near):
            continue
        same = keys[near] == keys[r]
        may = ~same[:, : first[r]].any(axis=1) & same[:, SIDE:].any(axis=1)
        for x in near[may][np.argsort(-agree[may], kind="stable")].tolist():
            if cluster[x] != cluster[r] and _similar(held[x][3], held[r][3]):
                out.append((int(node[x]), int(node[r])))
                cluster[cluster == cluster[x]] = cluster[r]
    return out


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_hash for each row of docs (doc_id, text)."""
    shelf = common.Shelf(docs.sparkSession)
    sketch = shelf.put(sketches(docs), "sketches")
    # A node stands for all documents with its set, the smallest doc_id first; its number is its place in the written table.
    first = sketch.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "keys", "brief")).alias("f"))
    number = F.monotonically_increasing_id().alias("node")
    nodes = shelf.put(first.select(number, F.col("f.doc_id").alias("doc"), F.col("f.n_shingles").alias("size"), "set_key", "f.keys", "f.brief"), "nodes")
    mates = shelf.put(_mates(nodes), "mates")
    links = shelf.put(_confirmed(shelf.put(_first_pairs(mates, nodes), "pairs"), docs), "links")
    shelf.drop("pairs")
    roots = connected(links, shelf)
    shelf.drop("links")
    rows = shelf.put(_open_rows(mates, nodes, roots), "open")
    shelf.drop("mates")
    more = shelf.put(_settled(rows, nodes, docs), "more")
    shelf.drop("open")
    if more.take(1):
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), shelf)
    shelf.drop("more")
    named = nodes.select("set_key", "node", "doc").join(roots, "node", "left").select("set_key", "doc", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("least"))
    of = shelf.put(named.join(least, "root").select("set_key", "least"), "components")
    shelf.drop("nodes", "edges")
    out = sketch.select("doc_id", "row_hash", "n_shingles", "set_key").join(of, "set_key", "left")
    component = F.when(F.col("set_key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "row_hash")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each component, with all its columns."""
    gone = components(docs).where("not kept").select(F.col("doc_id").alias("gone"), F.col("row_hash").alias("gone_hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
