"""N-gram Jaccard join: an LSH forest of MinHash signatures proposes, exact comparison decides.

Documents with equal shingle sets are one node, so copies cost nothing further on. Every tree of the forest holds
the nodes in the order of some of their MinHash values; nodes whose first ``depth`` values agree share a place.
The depth starts at the longest prefix and shrinks until the trees together find a pair at the threshold with the
target recall. Nodes that share a place and whose signatures are alike are joined into candidate groups, and each
group is compared exactly, in blocks of bounded size, without a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, plain, slices, stage
from cadenza.llm.decontaminate import words
from cadenza.llm.substrings import KEPT_WORDS, _mix, _WordNames

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
LONGEST_PREFIX = 8
RECALL = 0.9999
#: Rows of one place in a tree, or documents of one group, that a task compares at a time.
BLOCK = 4096
GROUP_BLOCK = 1024
#: Standard errors below the threshold down to which signatures still count as alike.
SLACK = 4.5

_U = np.uint64
_names = _WordNames()


def prefix_depth(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix with which ``trees`` trees find a pair at the threshold with the target recall."""
    for depth in range(longest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct names of the ``size``-word shingles of each text; fewer words are one shingle."""
    if len(_names) > KEPT_WORDS:
        _names.clear()
    out = []
    for t in texts:
        got = words(t) if t else []
        w = np.fromiter(map(_names.__getitem__, got), _U, len(got))
        if 0 < len(w) < size:
            name = w[:1]
            for k in range(1, len(w)):
                name = _mix(name, w[k : k + 1], 500 + k)
            out.append(name)
        elif len(w):
            name = w[: len(w) - size + 1]
            for k in range(1, size):
                name = _mix(name, w[k : len(w) - size + 1 + k], k)
            out.append(np.unique(name))
        else:
            out.append(w)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


class Signer:
    """MinHash values of shingle sets: ``trees`` times ``depth`` of them."""

    def __init__(self, trees: int, depth: int) -> None:
        rng = np.random.default_rng(20)
        self.trees, self.depth = trees, depth
        self.flip = rng.integers(1, 2**63, trees * depth, dtype=np.uint64)
        self.times = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) | _U(1)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each non-empty set."""
        out = np.empty((len(sets), len(self.flip)), _U)
        first = 0
        while first < len(sets):  # pieces that stay in the processor's cache
            last, n = first, 0
            while last < len(sets) and (last == first or n + len(sets[last]) <= 65536):
                n += len(sets[last])
                last += 1
            flat = np.concatenate(sets[first:last])
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]], dtype=np.int64)])
            for k in range(len(self.flip)):
                out[first:last, k] = np.minimum.reduceat((flat ^ self.flip[k]) * self.times[k], at)
            first = last
        return out

    def prefixes(self, signatures: np.ndarray) -> np.ndarray:
        """One name for each tree: that of the first ``depth`` values in it."""
        name = signatures[:, :: self.depth]
        for k in range(1, self.depth):
            name = _mix(name, signatures[:, k :: self.depth], k)
        return name.view(np.int64)


_NODES = "node binary, size int, prefixes array<bigint>, signature binary"


def _sign(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """(id, node, size, prefixes, signature) of every document; node is null without words."""
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, {_NODES}"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(trees, depth)
        for part in slices(batches):
            sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist())
            real = [k for k, s in enumerate(sets) if len(s)]
            node, prefixes, signature = ([None] * len(sets) for _ in range(3))
            if real:
                values = sign([sets[k] for k in real])
                names = sign.prefixes(values)
                mixed = (_mix(values, values, 9) >> _U(56)).astype(np.uint8)
                for row, k in enumerate(real):
                    node[k] = _digest(sets[k])
                    prefixes[k] = names[row]
                    signature[k] = mixed[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(c, f.type) for c, f in zip((node, [len(s) for s in sets], prefixes, signature), list(schema)[1:]))],
                schema=schema,
            )
        _names.clear()

    return rows.mapInArrow(run, ddl)


def _forest_edges(rows: list[bytes], nodes: list[bytes], least: float) -> list[tuple[bytes, bytes]]:
    """Edges that join alike signatures into their groups; each node is reached once."""
    sig = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    left, edges = np.arange(len(rows)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.empty(len(left), bool)
            for s in range(0, len(left), 65536):
                near[s : s + 65536] = (sig[left[s : s + 65536]] == sig[u]).mean(axis=1) >= least
            for v in left[near].tolist():
                edges.append((nodes[u], nodes[v]))
                queue.append(v)
            left = left[~near]
    return edges


def _groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Rows that agree on ``keys``, from batches sorted by them, across batch borders."""
    held_key, held = None, {c: [] for c in columns}
    for batch in batches:
        data = {c: batch.column(c).to_pylist() for c in (*keys, *columns)}
        marks = list(zip(*(data[k] for k in keys)))
        first = 0
        for k in range(1, len(marks) + 1):
            if k == len(marks) or marks[k] != marks[first]:
                if marks[first] != held_key:
                    if held_key is not None:
                        yield held
                    held_key, held = marks[first], {c: [] for c in columns}
                for c in columns:
                    held[c] += data[c][first:k]
                first = k
    if held_key is not None:
        yield held


_EDGES = "a binary, b binary"


def _alike(least: float):
    schema = arrow_schema(_EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups_of(batches, ("tree", "prefix", "pair"), ("node", "signature")):
            if len(group["node"]) > 1:
                out += _forest_edges(group["signature"], group["node"], least)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=schema)

    return run


def _block_pairs(df: DataFrame, count: str, key: str, block: int) -> DataFrame:
    """A row for each pair of blocks of its group that it takes part in; one row where a block holds the group.

    Adds ``own``, the row's block, ``pair``, and ``cross``: whether the pair is of two blocks.
    """
    n = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64(key), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own, j) * n + F.greatest(own, j))
    out = df.withColumn("own", own).withColumn("pair", F.explode(pairs))
    return out.withColumn("cross", (F.col("pair") % n) != F.floor(F.col("pair") / n))


def candidate_edges(nodes: DataFrame, *, trees: int, depth: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect all nodes which share a place of the forest and have alike signatures."""
    least = threshold - SLACK * (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    places = nodes.select("node", "signature", F.posexplode("prefixes").alias("tree", "prefix"))
    full = nodes.select(F.posexplode("prefixes").alias("tree", "prefix")).groupBy("tree", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > block)
    split = _block_pairs(places.join(full, ["tree", "prefix"], "left").fillna(1, ["n"]), "n", "node", block)
    dealt = split.select("tree", "prefix", "pair", "node", "signature").repartition("tree", "prefix", "pair").sortWithinPartitions("tree", "prefix", "pair")
    return dealt.mapInArrow(_alike(least), _EDGES)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node of each connected component, for the nodes of the edges.

    Alternates between joining larger neighbours to the smallest neighbour and smaller ones to it, until all edges
    are stars. Every round is written to the shared folder.
    """
    now = stage(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("a").alias("b"), F.col("b").alias("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a != b").distinct()
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_low, "b")
        now = stage(
            small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small_low.select(F.col("m").alias("a"), "b")).where("a != b").distinct(),
            name,
        )
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


_LINKS = "node binary, other binary, links bigint"


def _compare(threshold: float):
    """Exact comparison of a group or of two blocks of it: links of each node, and edges that join its matches."""
    schema = arrow_schema(_LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups_of(slices(batches, limit=16 << 20), ("label", "pair"), ("node", "own", "copies", "cross", "text")):
            real: dict[bytes, tuple] = {}
            for node, own, copies, s in zip(g["node"], g["own"], g["copies"], shingle_sets([t.encode() for t in g["text"]])):
                if node not in real and _digest(s) == node:  # else a row that repeats the id with another text
                    real[node] = own, copies, s
            own, copies, sets = zip(*real.values())
            out += links([*real], own if g["cross"][0] else None, copies, sets, threshold)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        _names.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def links(nodes: list[bytes], own: list[int] | None, copies: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple]:
    """(node, node it is joined to, links): all pairs, or with blocks ``own`` those of two different blocks.

    The first row of a node has its links, further ones only edges; a node without links has no row.
    """
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    block, weight = None if own is None else np.array(own), np.array(copies, np.int64)
    count, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    joined: dict[int, list[int]] = {}
    for u in range(len(nodes) - 1):
        mine = flat[start[u] : start[u] + size[u]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[flat[start[u + 1] :]], start[u + 1 :] - start[u + 1])
        mark[mine] = 0
        match = shared >= threshold * (size[u] + size[u + 1 :] - shared) - 1e-9
        if block is not None:
            match &= block[u + 1 :] != block[u]
        near = np.flatnonzero(match) + u + 1
        count[u] += weight[near].sum()
        count[near] += weight[u]
        groups, first = np.unique(label[near], return_index=True)
        for other, v in zip(groups.tolist(), near[first].tolist()):
            if other != label[u]:
                label[label == other] = label[u]
                joined.setdefault(v, []).append(u)
    linked = np.flatnonzero(count).tolist()
    return [(nodes[k], nodes[o], int(count[k]) if i == 0 else 0) for k in linked for i, o in enumerate(joined.get(k, [k]))]


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES,
    longest_prefix: int = LONGEST_PREFIX, recall: float = RECALL, block: int = BLOCK, group_block: int = GROUP_BLOCK,
) -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles reaches ``threshold``;
    words are runs of letters and digits, A-Z lower-cased, and a text of one to four words is one shingle. n_links
    counts all other rows that a row is linked to, copies included. A class is a connected set of links, named by
    its smallest id. Rows without words (null, empty) are linked to nothing and are classes of their own. Rows that
    repeat an id each get their row; a null id names a class only if the class has no other. An empty table gives
    no rows; columns not named are ignored.
    """
    rows = plain(docs, id_col, text_col)
    depth = prefix_depth(threshold, trees, longest_prefix, recall)
    signed = stage(_sign(rows, trees, depth), "signed")
    nodes = stage(
        signed.where("node is not null").groupBy("node").agg(
            F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("prefixes").alias("prefixes"), F.first("signature").alias("signature")
        ),
        "nodes",
    )
    groups = components(candidate_edges(nodes, trees=trees, depth=depth, threshold=threshold, block=block), "groups")
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
    members = groups.join(sizes, "label").join(nodes.select("node", "first_id", "copies"), "node")
    text = rows.join(members, rows["id"].eqNullSafe(members["first_id"])).select("label", "n", "node", "copies", "text")
    dealt = _block_pairs(text, "n", "node", group_block).repartition("label", "pair").sortWithinPartitions("label", "pair")
    compared = dealt.select("label", "pair", "cross", "own", "node", "copies", "text").mapInArrow(_compare(threshold), _LINKS)
    found = stage(compared, "links")
    classes = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")), "classes")
    known = (
        nodes.select("node", "first_id", "copies")
        .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(classes, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    named = known.groupBy("label").agg(F.min("first_id").alias("class_id"))
    known = known.join(named, "label").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("id", "node").join(known, "node", "left").select(
        F.col("id").alias("doc_id"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document of smallest id of each class of ``near_duplicates``, all columns as they were.

    Of rows that repeat both id and text one stays; a class whose ids are all null keeps one row of each text.
    """
    own = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    near = near_duplicates(docs.select(own.alias("doc_id"), F.col(text_col).alias("text")), **options)
    first = near.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id.id").alias("id"), F.col("doc_id.h").alias("h"))
    keys = ["keep_one_key_a", "keep_one_key_b"]
    marked = lambda df, i, h: df.withColumns({keys[0]: F.xxhash64(i, h), keys[1]: F.xxhash64(F.lit(1), h, i)})
    kept = marked(docs, F.col(id_col), F.xxhash64(text_col)).join(marked(first, F.col("id"), F.col("h")).select(*keys), keys, "left_semi")
    return kept.dropDuplicates(keys).select(*docs.columns)
