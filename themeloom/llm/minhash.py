"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of some words; MinHash turns it into ``HASHES``
symbols of 16 bits. Two sets of similarity ``s`` agree in a symbol with
probability ``s``, so the signature distance (symbols that differ) of a pair at
0.8 is about a fifth of the symbols.

*Multi-index join.* The signature is split into chunks of ``CHUNK`` symbols. By the
pigeonhole principle two signatures that differ in at most
``chunks * (ERRORS + 1) - 1`` symbols differ in at most ``ERRORS`` symbols of some
chunk. Every chunk is therefore indexed once for each way to leave ``ERRORS``
symbols out, and signatures that share a key meet. With the defaults all pairs up to
distance 23 of 84 meet for certain, and pairs at similarity 0.8 beyond that are
missed with probability 3e-5, falling steeply above 0.8.

*No pairs of a whole group.* Documents with equal sets are one node. Nodes sharing
a key are linked to the least of them only, within a batch before the shuffle and
between batches after it, which keeps the groups that share keys connected with a
number of links that grows with the rows. Each such group is then confirmed on full
sets: in blocks of bounded size, nearest signatures first, skipping what is already
linked. So every link between different sets counts for the components, while at
most one link per node and tile is written.

Text is lowered for A-Z, words are split at ASCII white space. A text of fewer words
has all of them as its only shingle; null, empty and blank texts have none and are
linked with nothing. Rows with one ``doc_id`` are one document; each is returned.
Rows without ``doc_id`` are linked with nothing, have no component and are kept.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.arrow import binary_column, blobs, cut_by_bytes, map_texts
from themeloom.llm.graph import connected_components
from themeloom.tables import column, materialize

HASHES = 84
CHUNK = 7
ERRORS = 1
# Confirmation looks at pairs up to this distance; at similarity 0.8 one in a million lies beyond.
MOST_DISTANCE = 35
# Rows and bytes of sets in one block of a group.
BLOCK_ROWS = 2048
BLOCK_BYTES = 24 << 20
# A list of document ids up to this length is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000

_A, _B = np.random.default_rng(20260101).integers(1, 2**63, (2, HASHES), dtype=np.uint64) * 2 + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted hashes of the distinct shingles of texts; words are told apart exactly."""

    def __init__(self, words: int = 2, most_words: int = 150_000):
        self.words = words
        self.most_words = most_words
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(0, dtype=np.uint64)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.known) > self.most_words:
            self._forget()
        first, known = len(self.known), self.known
        rows = [[known.setdefault(w, len(known)) for w in (text or b"").lower().split()] for text in texts]
        new = map(xxhash.xxh3_64_intdigest, itertools.islice(known, first, None))
        self.hashes = np.concatenate([self.hashes, np.fromiter(new, dtype=np.uint64)])
        return [self._set(np.array(row, dtype=np.int64)) for row in rows]

    def _set(self, words: np.ndarray) -> np.ndarray:
        n = max(len(words) - self.words + 1, 1) if len(words) else 0
        if self.words == 2 and len(words) > 1:
            # Only distinct pairs are hashed, and counted without relying on the hashes.
            pairs = np.unique(words[:-1] << 32 | words[1:])
            return np.sort(self._hashed([self.hashes[pairs >> 32], self.hashes[pairs & 0xFFFFFFFF]]))
        columns = [self.hashes[words[k : k + n]] for k in range(min(self.words, len(words)))]
        return np.unique(self._hashed(columns)) if n else np.zeros(0, dtype=np.uint64)

    def _hashed(self, columns: list[np.ndarray]) -> np.ndarray:
        hashed = np.full(len(columns[0]), len(columns), dtype=np.uint64)
        for column in columns:
            hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + column)
        return hashed


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(16)).astype("<u2")


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_id binary, signature binary, shingles binary"


def _sketch_task(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(words)
    for batch in cut_by_bytes(batches, "text", 2 << 20):
        sets = shingler.sets(blobs(batch.column("text")))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        full = sizes > 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(sizes),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                binary_column(
                    np.concatenate([signature(s) for s in sets if len(s)] or [np.zeros(0, "<u2")]), full * HASHES
                ),
                binary_column(np.concatenate(sets).astype("<u8"), sizes),
            ],
            ["doc_id", "n_shingles", "set_id", "signature", "shingles"],
        )


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for every chunk and every way to leave ``ERRORS`` of its symbols out."""
    keys = []
    for chunk in range(0, HASHES, CHUNK):
        for left_out in itertools.combinations(range(CHUNK), ERRORS):
            key = np.full(len(signatures), chunk * 1000 + sum(left_out) + 1, dtype=np.uint64)
            for k in range(CHUNK):
                if k not in left_out:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, chunk + k])
            keys.append(key)
    return np.stack(keys, axis=1)


def _gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together until they have some rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _key_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of nodes; of those that share one within a batch only the least goes on.

    The others are tied to it by a key of the pair's own, so each batch sends a key
    once however many nodes have it.
    """
    for batch in _gathered(batches, 10_000):
        nodes = np.asarray(batch.column("node"))
        signatures = np.frombuffer(b"".join(blobs(batch.column("signature"))), "<u2").reshape(-1, HASHES)
        keys = chunk_keys(signatures)
        flat, owners = keys.ravel(), np.repeat(nodes, keys.shape[1])
        order = np.lexsort((owners, flat))
        flat, owners = flat[order], owners[order]
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        pivots = np.repeat(owners[begins], np.diff(np.append(begins, len(flat))))
        ties = np.unique(np.stack([pivots, owners], axis=1)[pivots != owners], axis=0)
        tie_keys = mixed(mixed(ties[:, 0].astype(np.uint64)) + ties[:, 1].astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([flat[begins], tie_keys, tie_keys]).view(np.int64)),
                pa.array(np.concatenate([owners[begins], ties[:, 0], ties[:, 1]])),
            ],
            ["key", "node"],
        )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``100 * intersection >= percent * union``."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def tile_links(nodes, blocks, groups, signatures, sets, percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links in one tile: within its only block, or between its two blocks.

    Rows of one of ``groups`` are known to be linked already.
    """
    firsts: dict[int, int] = {}
    root = [firsts.setdefault(group, k) for k, group in enumerate(groups)]

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    two = blocks.min() != blocks.max()
    near: list[np.ndarray] = []
    for k in range(len(nodes) - 1):
        distance = (signatures[k + 1 :] != signatures[k]).sum(axis=1)
        close = distance <= MOST_DISTANCE
        if two:
            close &= blocks[k + 1 :] != blocks[k]
        others = np.flatnonzero(close)
        if len(others):
            near.append(np.stack([distance[others], np.full(len(others), k), others + k + 1], axis=1))
    links = []
    if near:
        pairs = np.concatenate(near).astype(np.int32)
        for _, a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
            x, y = find(a), find(b)
            if x != y and similar(sets[a], sets[b], percent):
                root[x] = y
                links.append((nodes[a], nodes[b]))
    return links


def hub(signatures: np.ndarray) -> int:
    """The row whose symbols are most often those that most rows have."""
    common = np.zeros(len(signatures), dtype=np.int64)
    for symbols in signatures.T:
        _, which, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        common += counts[which]
    return int(common.argmax())


TILE_COLUMNS = ("super", "low", "high", "node", "block", "known", "n_blocks")
LINK_SCHEMA = "super long, a long, b long"


def _tile_task(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each tile, and the hub of a block (``b`` null) whose group has others; a tile's rows come together."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in TILE_COLUMNS]
            yield from zip(*columns, blobs(batch.column("signature")), blobs(batch.column("shingles")))

    for key, group in itertools.groupby(rows(), key=lambda row: row[:3]):
        members = list(group)
        nodes = [row[3] for row in members]
        signatures = np.frombuffer(b"".join(row[7] for row in members), "<u2").reshape(-1, HASHES)
        links: list[tuple[int, int | None]] = []
        if len(members) > 1:
            blocks = np.array([row[4] for row in members])
            sets = [np.frombuffer(row[8], "<u8") for row in members]
            links += tile_links(nodes, blocks, [row[5] for row in members], signatures, sets, percent)
        if key[1] == key[2] and members[0][6] > 1:
            links.append((nodes[hub(signatures)], None))
        if links:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in ([key[0]] * len(links), *zip(*links))], ["super", "a", "b"]
            )


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """The links of tiles ``super, low, high``, written once."""

    def run(batches):
        return _tile_task(batches, percent)

    keys = ["super", "low", "high"]
    tiles = rows.select(*TILE_COLUMNS, "signature", "shingles")
    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys)
    return materialize(map_texts(dealt, run, LINK_SCHEMA), "links")


def _every(n_blocks) -> Column:
    return F.explode(F.sequence(F.lit(0), n_blocks - 1))


def _blocks_of(rows: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")


def confirmed_links(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links among the ``node, signature, shingles`` of each group ``super``, confirmed on full sets.

    A group beyond one block is dealt into blocks by a hash of the node. Each block
    is a tile; then the hub of every block, the node most like the others, meets all
    other blocks. That mostly joins a group of copies however large. Only nodes that
    are not in the group's largest component by then meet all nodes of the group, in
    tiles of two blocks, so no link that matters is left out and the pairs looked at
    grow with the square of the group only where copies of copies keep falling apart.
    """
    sizes = members.groupBy("super").agg(
        _blocks_of(F.count("*"), F.sum(F.octet_length("shingles").cast("long"))).alias("n_blocks")
    )
    placed = (
        members.join(sizes, "super")
        .withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks").cast("int"))
        .withColumn("known", F.col("node"))
    )
    found = _tiles(placed.withColumns({"low": F.col("block"), "high": F.col("block")}), percent)
    links, hubs = found.where("b IS NOT NULL"), found.where("b IS NULL").select("super", F.col("a").alias("node"))
    if hubs.isEmpty():
        return links.select("a", "b")
    large = materialize(placed.where("n_blocks > 1"), "large-groups")
    from_hubs = large.join(hubs, ["super", "node"], "left_semi").withColumn("low", _every(F.col("n_blocks")))
    to_all = large.withColumn("low", F.col("block"))
    met = from_hubs.withColumn("block", F.lit(-1)).unionByName(to_all.withColumn("block", F.lit(-2)))
    links = links.unionByName(_tiles(met.withColumn("high", F.lit(-1)), percent)).select("a", "b")

    joined = connected_components(links.join(large.select(F.col("node").alias("a")).distinct(), "a", "left_semi"))
    known = F.coalesce("component", "node").alias("known")
    columns = ["super", "node", "block", "n_blocks", known, "signature", "shingles"]
    now = materialize(large.drop("known").join(joined, "node", "left").select(*columns), "large-groups")
    main = now.groupBy("super", "known").agg(F.count("*").alias("n")).groupBy("super").agg(
        F.max_by("known", F.struct("n", "known")).alias("main")
    )
    rest = now.join(main, "super").where("known != main").drop("main")
    counted = rest.groupBy("super").agg(
        _blocks_of(F.count("*"), F.sum(F.octet_length("shingles").cast("long"))).alias("n_rest")
    )
    # Sources are what is left over, targets are all nodes of such a group.
    sources = rest.join(counted, "super").withColumns(
        {"low": F.pmod(F.xxhash64("node", F.lit(1)), "n_rest").cast("int"), "high": _every(F.col("n_blocks"))}
    )
    targets = now.join(counted, "super").withColumns({"high": F.col("block"), "low": _every(F.col("n_rest"))})
    pairs = sources.withColumn("block", F.lit(-1)).unionByName(targets.withColumn("block", F.lit(-2)))
    # The bounds differ, so that no tile is taken for a block of its own.
    last = _tiles(pairs.withColumn("high", -F.col("high") - 2).drop("n_rest"), percent)
    return links.unionByName(last.select("a", "b"))


def near_duplicates(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row.

    Linked documents have sets of shingles of ``words`` words with ``percent`` similarity or more.
    """

    def sketch(batches):
        return _sketch_task(batches, words)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(map_texts(source, sketch, SKETCH_SCHEMA), "sketches")
    rows = sketches.select("doc_id", "n_shingles", "set_id", "signature")
    full = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    heads = full.join(classes, "set_id").where("doc_id = node").select("node", "signature")
    keys = map_texts(heads, _key_task, "key long, node long")
    pivots = keys.withColumn("pivot", F.min("node").over(Window.partitionBy("key")))
    met = pivots.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    groups = materialize(
        connected_components(met).select(F.col("node"), F.col("component").alias("super")), "groups"
    )
    wanted = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    members = sketches.where("n_shingles > 0").withColumnRenamed("doc_id", "node").join(wanted, "node")
    links = confirmed_links(members.select("super", "node", "signature", "shingles"), percent)

    placed = rows.drop("signature").join(classes, "set_id", "left")
    # Rows with one doc_id are one document, so their classes are linked.
    repeated = (
        placed.where("doc_id IS NOT NULL AND node IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least < most")
        .select("doc_id", "least")
    )
    same = placed.join(repeated, "doc_id").select(F.col("node").alias("a"), F.col("least").alias("b"))
    components = connected_components(links.unionByName(same))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return placed.join(components, "node", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def first_documents(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of the documents that ``near_duplicates`` keeps, with all their columns.

    Of rows with one ``doc_id`` and the same text one stays, the least by its columns written
    as JSON. Rows with one ``doc_id`` and different texts are one document and stay or go
    together; rows without ``doc_id`` all stay.
    """
    found = near_duplicates(documents, percent, words)
    dropped = materialize(found.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    columns = [column(name) for name in documents.columns]
    kept = documents.join(dropped, "doc_id", "left_anti").select(*columns)
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count()
    repeated = materialize(ids.where("count > 1").select("doc_id"), "repeated")
    n_repeated = repeated.count()
    if not n_repeated:
        return kept
    repeated = F.broadcast(repeated) if n_repeated <= BROADCAST_ROWS else repeated
    whole = F.struct(*columns)
    # Combined in the map tasks, so a row that repeats without end arrives once per task.
    one = (
        kept.join(repeated, "doc_id", "left_semi")
        .groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256))
        .agg(F.min_by(whole, F.to_json(whole)).alias("row"))
        .select(*[F.col("row").getField(name).alias(name) for name in documents.columns])
    )
    return kept.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(one)
