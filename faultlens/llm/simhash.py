"""SimHash near-duplicates: 64-bit fingerprints linked through tables of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import bundled, merge_labels, raw, small_batches, store, unbundled
from faultlens.llm.components import connected
from faultlens.llm.substrings import _mix, _mix_here
from faultlens.session import ship

SHINGLE = 3
RADIUS = 3
TABLES = 8  # independent fingerprints of the classes of similar documents
SIMILAR_SHINGLE = 5  # words of the shingles whose Jaccard similarity must reach 4/5
BANDS, BAND = 24, 6  # bands of least hashes, hashes of a band: a pair at 0.8 shares none with a chance of 7 in 10,000
BLOCK_ROWS, BLOCK_BYTES = 1_024, 16 << 20  # texts of a class that are compared in one task
GRID = 3  # pivots whose distances place a fingerprint on the grid
HOME_BLOCK, SIDE_BLOCK = 16_384, 65_536  # fingerprints of a cell that meet in one task
PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(24)], dtype=np.uint64)
SIDE = 64 // (RADIUS + 1) + 1


def shingle_hashes(text: bytes | None, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of a text's n-word shingles, some thousands at a time; of the whole sequence where it is shorter, nothing without words."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        yield np.array([hashed(joined, 42)], np.uint64)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - n].tolist() if n > 1 else (ends - lengths).tolist()
    ends = ends[n - 1:].tolist()
    for at in range(0, len(starts), 1 << 15):
        yield np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at:at + (1 << 15)], ends[at:at + (1 << 15)])], np.uint64)


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """SimHash of a text's n-word shingles; 0 without words."""
    counts, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, n):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprint_row(text: bytes | None, many: int, n: int = SHINGLE) -> np.ndarray:
    """`many` independent SimHashes of a text's n-word shingles."""
    return fingerprints_of(shingle_hashes(text, n), many)


def fingerprints_of(hashes: Iterable[np.ndarray], many: int) -> np.ndarray:
    """`many` independent SimHashes of shingle hashes, which are mixed anew for each; bits are counted byte by byte."""
    counts, total = np.zeros((many * 8, 256)), 0
    salt = (np.arange(1, many + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    place = 256 * np.arange(many * 8)[None, :]
    for h in hashes:
        for at in range(0, len(h), 1024):
            mixed = _mix_here(h[at:at + 1024, None] + salt)
            counts += np.bincount((mixed.view(np.uint8).reshape(len(mixed), -1) + place).ravel(), minlength=counts.size).reshape(counts.shape)
        total += len(h)
    return np.packbits((2 * (counts @ _BITS) > total).ravel(), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; null, empty and blank texts have 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fps = np.array([fingerprint(x, n) for x in raw(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float)


def _home(fps: np.ndarray) -> np.ndarray:
    """The grid cell of each fingerprint: its distances to the grid pivots, in steps of the radius plus one."""
    home = np.zeros(len(fps), np.int64)
    for p in PIVOTS[:GRID]:
        home = home * SIDE + np.bitwise_count(fps ^ p).astype(np.int64) // (RADIUS + 1)
    return home


def _cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every grid cell that fingerprints within the radius may call home; each row's own cell comes first among its rows.

    A pair within the radius differs by at most the radius in every distance to a pivot, so its second member's cell lies among
    those the first one's interval touches. Only cells from the own one upwards are given: each pair then meets in the higher cell.
    """
    w = RADIUS + 1
    rows, cells, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), _home(fps)
    for p in PIVOTS[:GRID]:
        d = np.bitwise_count(fps ^ p).astype(np.int64)
        d, parts = d[rows], []
        for step in (0, -1, 1):
            c = d // w + step
            ok = (c >= (np.maximum(d - RADIUS, 0)) // w) & (c <= np.minimum(d + RADIUS, 64) // w)
            parts.append((rows[ok], (cells * SIDE + c)[ok]))
        rows, cells = (np.concatenate(x) for x in zip(*parts))
    up = cells >= home[rows]
    rows, cells = rows[up], cells[up]
    order = np.lexsort((cells, rows))
    return rows[order], cells[order]


def close_pairs(a: np.ndarray, b: np.ndarray, pivots: np.ndarray = PIVOTS[GRID:]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), in chunks, of all pairs a[i], b[j] within the radius.

    Further pivots split both sides by distance and drop what differs by more than the radius; survivors are verified.
    """
    def search(ia: np.ndarray, ib: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(ia) * len(ib) <= 1 << 19 or not len(left):
            for at in range(0, len(ia), step := max(1, (1 << 19) // max(1, len(ib)))):
                part = ia[at:at + step]
                x, y = np.nonzero(np.bitwise_count(a[part][:, None] ^ b[ib][None, :]) <= RADIUS)
                if len(x):
                    yield part[x], ib[y]
            return
        da, db = (np.bitwise_count(x ^ left[0]).astype(np.int64) for x in (a[ia], b[ib]))
        ib = ib[order := np.argsort(db, kind="stable")]
        db = db[order]
        for d in np.unique(da):
            lo, hi = np.searchsorted(db, (d - RADIUS, d + RADIUS + 1))
            if hi > lo:
                yield from search(ia[da == d], ib[lo:hi], left[1:])

    if len(a) and len(b):
        yield from search(np.arange(len(a)), np.arange(len(b)), pivots)


def links(distinct: DataFrame, tables: int = 1) -> DataFrame:
    """(k, a, b): links between distinct fingerprints (k, fp) of each k that connect all pairs within the radius; `distinct` should be a written table.

    Fingerprints are placed by their distances to the grid pivots and sent to the cells their intervals reach; a cell with many
    members is cut into blocks that meet pairwise in separate tasks. A task returns a spanning forest of its pairs, so a dense
    group never sends all its pairs on. Only the table of cells (SIDE ** GRID rows for each k at most) reaches the driver.
    """
    spark = distinct.sparkSession
    ship(spark)
    fps = distinct.select("k", "fp")
    many, span = tables, SIDE ** GRID

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, all_ = np.zeros(many * span, np.int64), np.zeros(many * span, np.int64)
        for b in batches:
            rows, cells = _cells(b.column("fp").to_numpy().view(np.uint64))
            cells = cells + span * b.column("k").to_numpy()[rows]
            first = np.r_[True, rows[1:] != rows[:-1]][:len(rows)]
            home += np.bincount(cells[first], minlength=len(home))
            all_ += np.bincount(cells, minlength=len(home))
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(home[at]), pa.array(all_[at])], ["cell", "home", "all"])

    counted = fps.mapInArrow(sizes, "cell long, home long, all long").groupBy("cell").agg(F.sum("home"), F.sum("all")).collect()
    blocks = np.ones((many * span, 2), np.int64)
    for cell, home, all_ in counted:
        blocks[cell] = max(1, -(-home // HOME_BLOCK)), max(1, -(-all_ // SIDE_BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 16_384):
            fps = b.column("fp").to_numpy().view(np.uint64)
            rows, cells = _cells(fps)
            table = span * b.column("k").to_numpy().astype(np.int64)
            cells = cells + table[rows]
            home = np.r_[True, rows[1:] != rows[:-1]][:len(rows)]
            nh, ns = blocks[cells].T
            mix = fps[rows] * np.uint64(0x9E3779B97F4A7C15)
            i, j = (mix >> np.uint64(33)).astype(np.int64) % nh, (mix >> np.uint64(13)).astype(np.int64) % ns
            # as a side row: its block j meets every home block; as a home row: its block i meets every side block
            out = []
            for k in range(int(nh.max(initial=0))):
                ok = k < nh
                out.append((rows[ok], cells[ok], np.full(ok.sum(), k), j[ok], 2 + (home & (i == k))[ok]))
            for k in range(int(ns.max(initial=0))):
                ok = home & (k < ns) & (k != j)
                out.append((rows[ok], cells[ok], i[ok], np.full(ok.sum(), k), np.full(ok.sum(), 1)))
            r, c, bi, bj, role = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c), pa.array(bi.astype(np.int32)), pa.array(bj.astype(np.int32)), pa.array(fps[r].view(np.int64)), pa.array(role.astype(np.int8)),
                 pa.array((_home(fps) + table)[r] == c)], ["cell", "i", "j", "fp", "role", "own"])

    def join(group: pa.Table) -> pa.Table:
        fp, role, own = (group.column(n).to_numpy() for n in ("fp", "role", "own"))
        fp = fp.view(np.uint64)
        at, side = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        labels = np.arange(len(fp))
        for x, y in close_pairs(fp[at], fp[side]):
            x, y = at[x], side[y]
            ok = ~own[y] | (fp[y] > fp[x])
            merge_labels(labels, x[ok], y[ok])
        moved = np.flatnonzero(labels != np.arange(len(fp)))
        k = group.column("cell")[0].as_py() // span
        return pa.table({"k": np.full(len(moved), k, np.int32), "a": fp[moved].view(np.int64), "b": fp[labels[moved]].view(np.int64)})

    placed = fps.mapInArrow(place, "cell long, i int, j int, fp long, role byte, own boolean")
    return placed.groupBy("cell", "i", "j").applyInArrow(join, "k int, a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs, whose class is named by its least doc_id.

    docs needs doc_id and text; other columns are not looked at. Null, empty and blank texts have the fingerprint zero, which is
    linked like any other. Texts under three words are one shingle. Repeated rows come out repeated. A null doc_id keeps its row
    and never names a class unless the class has nothing else. An empty table gives an empty table.
    """
    fps = store(fingerprints(docs), "fingerprints")
    distinct = store(fps.groupBy("fp").agg(F.min("doc_id").alias("lo")), "distinct")
    roots = connected(links(distinct.withColumn("k", F.lit(0))).select("a", "b"))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text: bytes | None) -> bytes:
    """128-bit hash of a text's lowered words; texts with the same words have the same shingles."""
    return xxhash.xxh128_digest(b" ".join(text.lower().split()) if text else b"")


def shingle_set(text: bytes | None, n: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return distinct_hashes(shingle_hashes(text, n))


def distinct_hashes(hashes: Iterable[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))


def bands(hashes: np.ndarray, many: int = BANDS, each: int = BAND) -> np.ndarray:
    """Keys of the bands: each mixes the least of the shingle hashes under `each` orders of its own; zeros without shingles."""
    if not len(hashes):
        return np.zeros(many, np.uint64)
    salt = _mix(np.arange(1, many * each + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
    least = np.full(many * each, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):  # few enough to stay in the cache of a core
        np.minimum(least, _mix_here(hashes[at:at + 256, None] ^ salt).min(axis=0), out=least)
    out = np.zeros(many, np.uint64)
    for column in least.reshape(many, each).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def proposals(text: bytes | None, tables: int = TABLES) -> np.ndarray:
    """What a text may be brought together by, its shingles hashed once: `tables` fingerprints, then the keys of its bands."""
    hashes = list(shingle_hashes(text, SIMILAR_SHINGLE))
    return np.concatenate([fingerprints_of(hashes, tables), bands(distinct_hashes(hashes))])


def confirm(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (x of left, y of right) at a Jaccard similarity of 4/5 or more that join all that such pairs join; pairs with one label count as joined.

    Without `right` the members of left meet each other.
    """
    size = np.array([len(x) for x in sets], np.int64)
    words = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.empty(0, np.int64)
    ids = np.split(words, np.cumsum(size)[:-1])
    mark, labels, out = np.zeros(len(words), bool), labels.copy(), []
    for x in left.tolist():
        others = left[left > x] if right is None else right
        others = others[(labels[others] != labels[x]) & (5 * size[others] >= 4 * size[x]) & (4 * size[others] <= 5 * size[x])]
        if len(others):
            mark[ids[x]] = True
            for y in others.tolist():
                if labels[y] != labels[x] and 9 * np.count_nonzero(mark[ids[y]]) >= 4 * (size[x] + size[y]):
                    out.append((x, y))
                    labels[labels == labels[y]] = labels[x]
            mark[ids[x]] = False
    return out


def confirmed(members: DataFrame) -> DataFrame:
    """(a, b): links that connect what the pairs of a class at a Jaccard similarity of 4/5 or more connect; members (cls, node, hashes) should be a written table.

    A class of one block is settled in one task. A larger one is dealt into blocks twice, which joins nearly all copies of one text; the texts
    outside its largest group then meet every block, so that no pair is left out.
    """
    def linked(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        if "role" in group.column_names:
            role, label = group.column("role").to_numpy(), np.unique(group.column("label").to_numpy(), return_inverse=True)[1]
            pairs = confirm(sets, label, np.flatnonzero(role == 1), np.flatnonzero(role == 2))
        else:
            pairs = confirm(sets, np.arange(len(node)), np.arange(len(node)))
        x, y = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": node[x], "b": node[y]})

    def blocks() -> Column:
        return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("hashes")) / BLOCK_BYTES), F.lit(1)).cast("int")

    def block(salt: int, n: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")

    sizes = store(members.groupBy("cls").agg(blocks().alias("n")), "sizes")
    placed = members.join(sizes, "cls")
    found = store(placed.groupBy("cls", block(0, "n").alias("i")).applyInArrow(linked, "a long, b long"), "confirmed")
    if sizes.where("n > 1").isEmpty():
        return found
    large = members.join(sizes.where("n > 1"), "cls")
    found = found.unionByName(store(large.groupBy("cls", block(1, "n").alias("i")).applyInArrow(linked, "a long, b long"), "confirmed"))
    named = store(large.join(connected(found), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "named")
    main = named.groupBy("cls", "label").count().groupBy("cls").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    out = named.join(main, "cls").where("label != main")
    outer = store(out.groupBy("cls").agg(blocks().alias("m")), "outer")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = (out.join(outer, "cls").select("cls", block(2, "m").alias("i"), every("n").alias("j"), "node", "label", "hashes", F.lit(1).alias("role"))
             .unionByName(named.join(outer, "cls").select("cls", every("m").alias("i"), block(3, "n").alias("j"), "node", "label", "hashes", F.lit(2).alias("role"))))
    return found.unionByName(store(sides.groupBy("cls", "i", "j").applyInArrow(linked, "a long, b long"), "confirmed"))


def similar_documents(docs: DataFrame, tables: int = TABLES) -> DataFrame:
    """(doc_id, component_id): classes of documents linked at a Jaccard similarity of 0.8 or more of their five-word shingles.

    `tables` independent 64-bit fingerprints of those shingles, looked up by pivot distances as in near_duplicates, and bands of least hashes only
    propose: what they bring together, directly or through others, is compared by its whole shingle sets (64-bit hashes), and only pairs at 0.8
    or more link. Texts with the same lowered words are one node; texts under five words are one shingle. Null, empty and blank texts are one class.
    A null doc_id and repeated rows are treated as in near_duplicates.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = raw(b, "text")
            rows = [proposals(x, tables).view(np.int64) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([text_key(x) for x in texts], pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                                             ["doc_id", "key", "fps"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([text_key(x) for x in raw(b, "text")], pa.binary()), b.column("text")], ["key", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("node"), pa.array([shingle_set(x).tobytes() for x in raw(b, "text")], pa.binary())],
                                             ["cls", "node", "hashes"])

    marked = store(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, fps array<long>"), "fingerprints")
    nodes = store(marked.groupBy("key").agg(F.min("doc_id").alias("lo"), F.first("fps").alias("fps")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", F.posexplode("fps").alias("k", "fp"))
    distinct = store(each.groupBy("k", "fp").agg(F.count("*").alias("n")), "distinct")
    found = store(links(distinct.where(F.col("k") < tables), tables), "links")
    name = lambda fp: -F.shiftrightunsigned(F.xxhash64("k", fp), 1) - 1  # noqa: E731  below all nodes
    shared = distinct.where("n > 1").select("k", "fp").unionByName(found.select("k", F.explode(F.array("a", "b")).alias("fp"))).distinct()
    edges = each.join(shared, ["k", "fp"], "left_semi").select(F.col("node").alias("a"), name("fp").alias("b")).unionByName(
        found.select(name("a").alias("a"), name("b").alias("b")))
    proposed = store(nodes.select("key", "node").join(connected(edges), "node").select("key", "node", F.col("root").alias("cls")), "proposed")
    texts = docs.select("text").mapInArrow(keyed, "key binary, text string").join(proposed, "key").groupBy("cls", "node").agg(F.first("text").alias("text"))
    members = store(texts.mapInArrow(hashed, "cls long, node long, hashes binary"), "members")
    roots = connected(confirmed(members))
    named = nodes.select("key", "lo", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    classes = named.join(least, "root").select("key", "component_id")
    return marked.select("doc_id", "key").join(classes, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, tables: int = TABLES) -> DataFrame:
    """docs without near copies: of each class of similar documents the rows with the least doc_id stay, as they are; rows without an id stay."""
    classes = similar_documents(docs, tables)
    gone = classes.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return unbundled(bundled(docs).join(gone, F.col("doc_id") == F.col("gone"), "left_anti"), docs)
