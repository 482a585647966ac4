"""Near duplicates by a multi-index Hamming join of b-bit minhash signatures.

A document's signature has ``bands * width`` symbols of 16 bits, each cut from the smallest value of one hash
function over its word shingles. Two signatures within ``radius`` differing symbols have, by the
pigeonhole principle, a band with at most ``radius // bands`` of them; so every band is indexed once for
each way to leave that many symbols out, and all such pairs meet in a bucket. Documents with the same shingle
set are one class before any of this, and only its representative is indexed.

Inside a bucket signatures are compared in arrays, and of the pairs that come close only a star per
component leaves the task, never all pairs. The components of these are candidate clusters; their shingle sets
meet block by block, all intersections are exact (one matrix product per block pair), and again only
stars of what the true links join leave the task: a link that is left out joins what is joined already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.components import components
from seriesloom.llm.flat import flat, mix, pieces, shingles, whole_groups
from seriesloom.llm.session import body, prepare, row_key, stored

BANDS, WIDTH, RADIUS = 16, 4, 31
#: Signatures further apart than this are no candidates. At similarity 0.75 the distance is 16 in the mean, and
#: more than 36 with a chance of about 2e-8.
FAR = 36
#: Signatures compared at once, and shingle sets intersected at once.
BUCKET_BLOCK, SET_BLOCK = 2048, 512
COLUMNS = 8192

_random = np.random.default_rng(7)
MULTIPLIERS = _random.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray, symbols: int) -> np.ndarray:
    """One row of 16-bit symbols per set; sets without a value have zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, symbols), np.uint16)
    for k in range(symbols if len(full) else 0):
        out[full, k] = mix(np.minimum.reduceat(values * MULTIPLIERS[k], offsets[full])).astype(np.uint16)
    return out


def band_keys(signature: np.ndarray, bands: int, width: int, radius: int) -> np.ndarray:
    """Index keys of every signature: per band, the symbols left when the allowed errors are left out."""
    symbols = signature.astype(np.uint64)
    keys = []
    for band in range(bands):
        for n, kept in enumerate(combinations(range(width), width - radius // bands)):
            key = np.full(len(symbols), band << 16 | n, np.uint64)
            for k in kept:
                key = mix(key ^ symbols[:, band * width + k] * np.uint64(0x9E3779B97F4A7C15))
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def stars(near: np.ndarray) -> list[tuple[int, int]]:
    """Links ``(first, other)`` of every component of the graph with this symmetric matrix.

    A star from a component's first node: as many links as a spanning forest has, and since the first node is
    often the same in other buckets and blocks, repeated links fall together.
    """
    out: list[tuple[int, int]] = []
    todo = np.ones(len(near), bool)
    for first in range(len(near)):
        if not todo[first]:
            continue
        todo[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & todo)
            todo[front] = False
            out += [(first, int(y)) for y in front]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += a[:, k, None] != b[None, :, k]
    return out


def _bucket_links(signature: np.ndarray, side: np.ndarray, far: int) -> list[tuple[int, int]]:
    """Links of one bucket or block pair; with two sides only links between them."""
    if len(signature) == 2:
        return [(0, 1)] if (signature[0] != signature[1]).sum() <= far else []
    near = distances(signature, signature) <= far
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    return stars(near)


def _set_links(values: np.ndarray, offsets: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the components of the sets whose intersection is at least ``percent`` % of their union."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], column[several]
    if not len(owner):
        return []
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        common += has @ has.T
    inter = np.rint(common).astype(np.int64)
    near = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    return stars(near)


def _pairs_schema() -> str:
    return "x struct<a:bigint,b:bigint>, y struct<a:bigint,b:bigint>"


def _pair_batch(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    ends = [
        pa.StructArray.from_arrays([pa.array(a[pairs[:, k]]), pa.array(b[pairs[:, k]])], ["a", "b"]) for k in (0, 1)
    ]
    return pa.RecordBatch.from_arrays(ends, ["x", "y"])


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, symbols: int) -> DataFrame:
    """Per row: id, row key, ``n_shingles``, two hashes of the shingle set, and the signature."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(3))
            columns: list[list] = [[], [], [], []]
            for i, j in pieces(offsets):
                values, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                full = np.flatnonzero(np.diff(at))
                for out, scrambled in zip(columns[1:3], (mix(values), mix(values ^ MULTIPLIERS[0]))):
                    total = np.zeros(len(at) - 1, np.uint64)
                    if len(full):
                        total[full] = np.add.reduceat(scrambled, at[full])
                    out.append(total.view(np.int64))
                columns[0].append(np.diff(at))
                columns[3].append(signatures(values, at, symbols))
            n, a, b, signature = (np.concatenate(c) if c else np.zeros((0, symbols), np.uint16) for c in columns)
            raw = signature.astype("<u2").tobytes()
            step = 2 * symbols
            packed = pa.array([raw[k * step : (k + 1) * step] for k in range(batch.num_rows)], pa.binary())
            numbers = [pa.array(c.reshape(-1).astype(np.int64)) for c in (n, a, b)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *numbers, packed], ["id", "key_a", "key_b", "n_shingles", "a", "b", "signature"]
            )

    keyed = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), body(text_col).alias("body"))
    return keyed.mapInArrow(
        sketch, f"id {kind}, key_a long, key_b long, n_shingles long, a long, b long, signature binary"
    )


def candidate_links(classes: DataFrame, bands: int, width: int, radius: int, far: int) -> DataFrame:
    """Links between classes that share an index key and are close in signature: stars per bucket."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                if not part.num_rows:
                    continue
                packed, _ = flat(part.column(2))
                signature = packed.view("<u2").reshape(part.num_rows, -1)
                key = band_keys(signature, bands, width, radius)
                a = np.repeat(part.column(0).to_numpy(), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(a)], ["key", "a"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["key", "i", "j"]):
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            packed, _ = flat(table.column("signature").combine_chunks())
            signature = packed.view("<u2").reshape(table.num_rows, -1)
            side = (table.column("block").to_numpy() != table.column("i").to_numpy())
            out = []
            for p, q in zip(at[:-1].tolist(), at[1:].tolist()):
                if q - p > 1:
                    out += [(p + x, p + y) for x, y in _bucket_links(signature[p:q], side[p:q], far)]
            if out:
                yield _pair_batch(a, b, np.array(out))

    # One half of a class's name is enough here: should two classes share it, both are compared.
    keyed = classes.select("a", "b", "signature").mapInArrow(keys, "key long, a long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BUCKET_BLOCK)).cast("int")
    shared = stored(shared.select("key", blocks.alias("blocks")), "keys")
    members = keyed.join(shared.hint("merge"), "key").join(classes.select("a", "b", "signature"), "a")
    dealt = in_block_pairs(members)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "a", "b")
    return through_least(stored(sorted_.mapInArrow(scan, _pairs_schema()).distinct(), "close"))


def through_least(links: DataFrame) -> DataFrame:
    """The same components by fewer links: a node and its other first nodes are linked to the smallest of these.

    A member of a large group has another first node in each of its buckets, at most one per index key; the links between
    first nodes repeat from member to member and fall together.
    """
    least = F.min("x").over(Window.partitionBy("y"))
    led = links.select("x", "y", least.alias("least"))
    both = led.select(F.col("least").alias("x"), "y").union(led.select(F.col("least").alias("x"), F.col("x").alias("y")))
    return both.where("x <> y").distinct()


def in_block_pairs(members: DataFrame) -> DataFrame:
    """Deal the members of a group with several ``blocks`` to its pairs of blocks ``(i, j)``.

    Groups of one block have the pair (0, 0). A pair (i, i) compares within a block.
    """
    block = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("block", block).withColumn("other", other)
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def true_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Confirmed links inside candidate clusters, stars per block pair, on full shingle sets.

    nodes: ``a, b, key_a, key_b, cluster, blocks``; the key is that of a row that has the class's set.
    """
    keyed = docs.select(*row_key(id_col, text_col), body(text_col).alias("body"))
    # Grows with the corpus: never broadcast. Repeated rows share their key, and one of them has the set.
    texts = keyed.join(nodes.hint("merge"), ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(4))
            for i, j in pieces(offsets):
                values, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                raw, at = values.tobytes(), (at * 8).tolist()
                packed = pa.array([raw[p:q] for p, q in zip(at[:-1], at[1:])], pa.binary())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], packed], ["a", "b", "cluster", "blocks", "members"]
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["cluster", "i", "j"]):
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            packed, offsets = flat(table.column("members").combine_chunks())
            values, offsets = packed.view(np.uint64), offsets // 8
            side = table.column("block").to_numpy() != table.column("i").to_numpy()
            out = []
            for p, q in zip(at[:-1].tolist(), at[1:].tolist()):
                mine = values[offsets[p] : offsets[q]]
                found = _set_links(mine, offsets[p : q + 1] - offsets[p], side[p:q], percent)
                out += [(p + x, p + y) for x, y in found]
            if out:
                yield _pair_batch(a, b, np.array(out))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = texts.select("a", "b", "cluster", "blocks", "body").mapInArrow(
        sets, "a long, b long, cluster long, blocks int, members binary"
    )
    dealt = in_block_pairs(made).repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "a", "b")
    return dealt.mapInArrow(scan, _pairs_schema())


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 75,
    bands: int = BANDS,
    width: int = WIDTH,
    radius: int = RADIUS,
    far: int = FAR,
) -> DataFrame:
    """One row per row of ``docs``: id, row key, ``n_shingles``, ``component_id`` and ``kept``.

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its distinct
    ``size``-word shingles, or its whole word sequence if it has fewer words. Documents are linked
    when 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id that can be reached over
    links, and the row that has it is ``kept``. Null, empty and blank texts have no shingle, no link and
    stay. Rows with a null id take part; a component without any id has a null ``component_id`` and all its
    rows are ``kept``, as are repeated rows that share the smallest id. An empty table gives an empty
    table; further columns are not read. Texts of any length count whole. Shingles are compared by 64-bit
    hashes, identical sets by 128-bit hashes.

    Signatures within ``radius`` are found without exception, nearly all up to ``far`` as well.
    """
    prepare(docs.sparkSession)
    sketch = stored(sketches(docs, id_col, text_col, size, bands * width), "sketch")
    key = F.min(F.struct("key_a", "key_b")).alias("key")
    grouped = sketch.where("n_shingles > 0").groupBy("a", "b", "signature").agg(F.min("id").alias("least"), key)
    classes = stored(grouped.select("a", "b", "signature", "least", "key.key_a", "key.key_b"), "classes")
    close = components(candidate_links(classes, bands, width, radius, far))
    clusters = close.select("node.a", "node.b", F.xxhash64("root.a", "root.b").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(SET_BLOCK)).cast("int").alias("blocks"))
    nodes = clusters.join(sizes, "cluster").join(classes.drop("signature", "least"), ["a", "b"])
    links = components(true_links(docs, stored(nodes, "nodes"), id_col, text_col, size, percent))
    linked = links.select("node.a", "node.b", "root").join(classes.select("a", "b", "least"), ["a", "b"])
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    # A class outside all links is a component of its own.
    found = linked.join(smallest, "root").select("a", "b", "smallest")
    named = classes.join(found, ["a", "b"], "left").select("a", "b", "least", "smallest")
    result = sketch.join(stored(named, "named"), ["a", "b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("smallest", "least"))
    return result.select(
        F.col("id").alias(id_col),
        "key_a",
        "key_b",
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
