"""SimHash near-dedup with a bit-sliced comparison of fingerprints.

Fingerprint: the majority bits of the XXH64 (seed 42) of the text's word shingles. Two
fingerprints link at ``RADIUS`` or fewer differing bits. Candidates: the 64 bits fall into
8 blocks, so two fingerprints that differ in 2 bits agree on at least 6 whole blocks; for
each of the 28 choices of 6 blocks, fingerprints that agree on them form a bucket. Only 16
bits are free in a bucket, so it holds at most 65,536 distinct fingerprints: no bucket can
become hot, and nothing is dropped. Buckets are compared bit-sliced: fingerprint bits are
stored as planes of 64 lanes a word, the differing bits of many lanes are added up at once
in carry-save counters (ones, twos, over), and words whose lanes all exceed the radius are
abandoned. Links become components by star rounds.

``near_copies`` uses the same comparison with longer fingerprints to find candidates, for a
corpus whose near copies differ in more bits, and links those of sufficient Jaccard similarity.

Cases: a null or blank text has fingerprint 0 and links like any other; a text of fewer
words than a shingle is one shingle; copies share a fingerprint, which is compared once; a
null doc_id is ignored as component_id as long as another id is reachable. ``near_copies``
tells rows apart by a key of their own, so rows of a null or repeated doc_id are compared too.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import (
    components,
    keyed,
    listed,
    meet,
    raw,
    remove,
    scratch,
    sliced,
    smallest_reachable,
    staged,
    without,
)

RADIUS = 2
BLOCKS = 8
#: Of the comparison by similarity: numbers of a fingerprint, bands, min-hashes of a band.
LONGS = 4
BANDS = 14
ROWS = 4
#: Fingerprints compared at once; bounds the memory of a comparison.
LANES = 1024
SLICE = 1 << 18
#: Of a group that is compared in blocks: members and bytes of a block.
BLOCK = 1024
BLOCK_BYTES = 16 << 20


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = (np.cumsum([len(t) + 1 for t in tokens]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-words]]]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: a bit is set if set in over half of the run."""
    out = np.zeros(len(starts), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts)
        out |= (2 * ones.astype(np.int64) > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    runs: list[tuple[int, list[int]]] = []
    size = 0

    def flush() -> None:
        if runs:
            sizes = np.array([len(h) for _, h in runs])
            flat = np.concatenate([np.array(h, np.uint64) for _, h in runs])
            out[[i for i, _ in runs]] = majority(flat, np.cumsum(sizes) - sizes, sizes)
            runs.clear()

    for i, text in enumerate(texts):
        if h := shingle_hashes(text, words):
            runs.append((i, h))
            size += len(h)
            if size >= SLICE:
                flush()
                size = 0
    flush()
    return out


def with_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches):
        for b in sliced(batches):
            fps = fingerprints(raw(b.column("text")), words)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64))}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def near(fps: np.ndarray, radius: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i in lo..hi, of fingerprints within ``radius`` bits, i < j.

    ``fps`` has a row of 64-bit numbers per fingerprint. Words of 64 lanes are compared
    with one fingerprint by xor with its planes.
    """
    fps = fps.reshape(len(fps), -1)
    n, longs = fps.shape
    width = -(-n // 64)
    row, word = np.divmod(np.arange((hi - lo) * width), width)
    ahead = word * 64 + 63 > row + lo  # lanes behind the row are another row's pairs
    row, word = row[ahead], word[ahead]
    counters = [np.zeros(len(row), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(row), np.uint64)
    full = ~np.uint64(0)
    every = 8 if longs == 1 else 16
    for part in range(longs):
        bits = (fps[:, part, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        padded = np.zeros((64, width * 64), np.uint8)
        padded[:, :n] = bits.T
        planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        masks = (np.uint64(0) - bits[lo:hi]).T.copy()  # all ones where the bit is set
        for p in range(64):
            carry = planes[p][word] ^ masks[p][row]
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if p % every == every - 1:
                alive = (over | _above(counters, radius)) != full
                if not alive.all():
                    row, word, over = row[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(row):
                    return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = ~(over | _above(counters, radius))
    lanes = np.unpackbits(ok.view(np.uint8), bitorder="little").reshape(len(ok), 64)
    at, lane = np.nonzero(lanes)
    i, j = row[at] + lo, word[at] * 64 + lane
    keep = (j > i) & (j < n)
    return i[keep], j[keep]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``: a bit-sliced compare with a constant."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``: (index, index of its tree's root)."""
    n = len(fps)
    step = max(1, LANES * 16 // -(-n // 64))
    a = b = np.zeros(0, np.int64)
    for lo in range(0, n, step):
        i, j = near(fps, radius, lo, min(n, lo + step))
        label = components(n, np.concatenate([a, i]), np.concatenate([b, j]))
        a = np.flatnonzero(label != np.arange(n))
        b = label[a]
    return a, b


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the bits that a bucket's fingerprints share, as signed longs."""
    each = 64 // blocks
    out = []
    for free in combinations(range(blocks), radius):
        m = (1 << 64) - 1
        for k in free:
            m &= ~(((1 << each) - 1) << (k * each))
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def bucket_links(buckets: DataFrame, radius: int, fp: str, node: str) -> DataFrame:
    """Edges (a, b) of nodes that connect all links within the buckets.

    ``buckets`` has t and key, which name the bucket, ``fp`` (a long, or the bytes of
    several) and ``node`` (a long; may be the same column). A bucket is one run of the
    sorted rows; runs of one row are dropped and whole runs are compared in blocks.
    """

    def run(batches):
        rest: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            # Links between buckets of a block are links too.
            if held:
                names = np.concatenate([x for x, _ in held])
                names, first = np.unique(names, return_index=True)
                a, b = links(np.concatenate([f for _, f in held])[first], radius)
                held.clear()
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(names[a]), "b": pa.array(names[b])})

        def blocks(t, key, names, fps):
            if not len(t):
                return
            at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[at, len(t)])
            for i, k in zip(at[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                held.append((names[i : i + k], fps[i : i + k]))
                if sum(len(x) for x, _ in held) >= LANES:
                    yield from out()

        for b in batches:
            fps = b.column(fp)
            if fps.type == pa.int64():
                fps = fps.to_numpy().view(np.uint64)[:, None]
            else:
                fps = np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(b.num_rows, -1)
            new = [*(b.column(k).to_numpy() for k in ("t", "key", node)), fps]
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)] if rest else new
            t, key = rest[:2]
            turns = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))
            cut = int(turns[-1]) + 1 if len(turns) else 0
            yield from blocks(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
        if rest:
            yield from blocks(*rest)
        yield from out()

    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = buckets.repartition(parts, "t", "key").sortWithinPartitions("t", "key")
    return sorted_.mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all linked fingerprints of ``distinct`` (fp)."""
    masks = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for t, m in enumerate(block_masks(radius))
        ]
    )
    buckets = distinct.select(F.explode(masks).alias("k"), "fp").select(
        F.col("k.t").cast("long").alias("t"), F.col("k.key").alias("key"), "fp"
    )
    return bucket_links(buckets, radius, "fp", "fp")


def near_groups(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id)."""
    rows = staged(with_fingerprints(docs, words), "simhash")
    distinct = staged(
        rows.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "simhash-distinct"
    )
    edges = staged(fingerprint_links(distinct.select("fp"), radius), "simhash-links")
    roots = smallest_reachable(edges, "simhash-components")
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low_id"
    )
    lowest = labelled.groupBy("root").agg(F.min("low_id").alias("component_id"))
    ids = meet(labelled, lowest, "root").select(F.col("fp").alias("of"), "component_id")
    return rows.join(ids, rows["fp"] == ids["of"]).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits within which all but a negligible share of such pairs stay.

    Five standard deviations beyond the mean of pairs of that Jaccard similarity; texts of a
    few shingles differ somewhat more than the mean says.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + 5 * sqrt(bits * share * (1 - share)))


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash of hashes (the finaliser of splitmix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def signatures(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of the shingle sets of texts, by row: fingerprints of LONGS numbers, keys of BANDS
    min-hash bands, and a digest of 16 bytes."""
    fps = np.zeros((len(texts), LONGS), np.uint64)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    digests: list[bytes] = []
    runs: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if not runs:
            return
        at = [i for i, _ in runs]
        sizes = np.array([len(h) for _, h in runs])
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([h for _, h in runs])
        for k in range(LONGS):
            fps[at, k] = majority(flat if k == 0 else _spread(flat, k), starts, sizes)
        for band in range(BANDS):
            key = np.zeros(len(at), np.uint64)
            for r in range(ROWS):
                odd = np.uint64((0xD6E8FEB86659FD93 * (2 * (band * ROWS + r) + 1)) % (1 << 64) | 1)
                low = np.minimum.reduceat((flat ^ (flat >> np.uint64(31))) * odd, starts)
                key = _spread(key ^ low, r)
            keys[at, band] = key
        runs.clear()

    for i, text in enumerate(texts):
        h = shingle_set(text, words)
        digests.append(blake2b(h.tobytes(), digest_size=16).digest())
        if len(h):
            runs.append((i, h))
            size += len(h)
            if size >= SLICE:
                flush()
                size = 0
    flush()
    return fps, keys, digests


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity at least."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both) >= similarity


def exact_links(
    fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as in ``links``, of the pairs of that similarity within ``radius``.

    Pairs are verified in growing rounds; those that earlier ones connect need no look.
    """
    n = len(fps)
    label = np.arange(n)
    rng = np.random.default_rng(0)
    step = max(1, LANES * 16 // -(-n // 64))
    for lo in range(0, n, step):
        i, j = near(fps, radius, lo, min(n, lo + step))
        order = rng.permutation(len(i))
        i, j = i[order], j[order]
        take = n
        while True:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            pairs = zip(i[:take].tolist(), j[:take].tolist(), strict=True)
            ok = np.array([similar(sets[x], sets[y], similarity) for x, y in pairs], bool)
            a, b = i[:take][ok], j[:take][ok]
            tree = np.flatnonzero(label != np.arange(n))
            label = components(n, np.concatenate([tree, a]), np.concatenate([label[tree], b]))
            i, j = i[take:], j[take:]
            take *= 2
    a = np.flatnonzero(label != np.arange(n))
    return a, label[a]


def similar_links(
    rows: DataFrame, roots: DataFrame, words: int, similarity: float, radius: int, folder: str
) -> DataFrame:
    """Edges (a, b) that connect all rows of sufficient similarity among those of a root.

    ``rows`` has row and text, ``roots`` has node and root: the rows of a root are compared.
    Where they are more than a block, all meet its first block; members of the component
    that is then the largest are connected, and only the rest meets all others. What is
    written on the way lies in ``folder`` until the caller removes it.
    """

    def sets(batches):
        for b in sliced(batches):
            texts = raw(b.column("text"))
            found = [shingle_set(t, words).tobytes() for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "group": b.column("root"),
                    "node": b.column("node"),
                    "size": pa.array([len(x) for x in found], pa.int64()),
                    "fp": pa.array([f.tobytes() for f in signatures(texts, words)[0]], pa.binary()),
                    "shingles": pa.array(found, pa.binary()),
                }
            )

    def run(batches):
        rest: list[tuple] = []

        def out():
            if len(rest) > 1:
                names = np.array([r[2] for r in rest], np.int64)
                names, first = np.unique(names, return_index=True)
                fps = np.frombuffer(b"".join(rest[k][3] for k in first), np.uint64)
                held = [np.frombuffer(rest[k][4], np.uint64) for k in first]
                a, b = exact_links(fps.reshape(len(first), -1), held, radius, similarity)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(names[a]), "b": pa.array(names[b])})
            rest.clear()

        for b in batches:
            columns = [b.column(k).to_pylist() for k in ("t", "key", "node", "fp", "shingles")]
            for r in zip(*columns, strict=True):
                if rest and rest[-1][:2] != r[:2]:
                    yield from out()
                rest.append(r)
        yield from out()

    # Few texts have candidates; the others stay where they lie.
    texts = rows.join(listed(roots), rows["row"] == roots["node"]).select("root", "node", "text")
    members = staged(
        texts.mapInArrow(sets, "group long, node long, size long, fp binary, shingles binary"),
        "similar-sets",
        f"{folder}/sets",
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(dealt: DataFrame) -> DataFrame:
        sorted_ = dealt.repartition(parts, "t", "key").sortWithinPartitions("t", "key")
        return sorted_.mapInArrow(run, "a long, b long")

    edges = staged(compared(cells(members, BLOCK, first=True)), "similar-first", f"{folder}/first")
    sizes = members.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("double")).alias("bytes")
    )
    large = sizes.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("group")
    if large.isEmpty():
        return edges
    of_large = meet(members, large, "group")
    found = smallest_reachable(edges, "similar-first-groups").select(F.col("node").alias("of"), "root")
    named = of_large.select("group", "node").join(found, F.col("node") == F.col("of"), "left")
    named = named.select("group", "node", F.coalesce("root", "node").alias("root"))
    named = staged(named, "similar-first-named", f"{folder}/named")
    held = named.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("group").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    rest = meet(named, main, "group").where("root <> main").select("node")
    rest = staged(rest, "similar-rest", f"{folder}/rest")
    return edges.unionAll(compared(cells_with_rest(of_large, rest, BLOCK)))


def cells(rows: DataFrame, block: int = BLOCK, first: bool = False) -> DataFrame:
    """``rows`` (group, node, size and more) dealt to cells (t, key) that are compared whole.

    A group larger than a block is cut into blocks by a hash of its nodes; a cell is a pair of
    its blocks, so any two members of a group meet in one. With ``first`` only pairs with
    the first block are made. Groups are counted, never gathered; groups of one row go.
    """
    counts = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col("size").cast("double")).alias("__size")
    )
    cut = F.greatest(F.ceil(F.col("__n") / block), F.ceil(F.col("__size") / BLOCK_BYTES), F.lit(1))
    counts = counts.where("__n > 1").select("group", cut.cast("int").alias("__cut"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("__cut")).cast("int")
    every = F.sequence(F.lit(0), F.col("__cut") - 1)
    if first:
        every = F.when(F.col("__own") == 0, every).otherwise(F.array(F.lit(0)))
    others = F.when(F.col("__cut") == 1, F.array(F.lit(0))).otherwise(
        F.filter(every, lambda k: k != F.col("__own"))
    )
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    return (
        meet(rows, counts, "group")
        .withColumn("__own", own)
        .withColumn("__other", F.explode(others))
        .withColumn("t", F.col("group"))
        .withColumn("key", low.cast("long") * (1 << 31) + high)
        .drop("group", "size", "__cut", "__own", "__other")
    )


def cells_with_rest(rows: DataFrame, rest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cells of each block of ``rest`` with each block of ``rows``, as ``cells`` makes them.

    ``rest`` (node) are rows still to be compared with all members of their group.
    """
    flagged = rows.join(rest.select(F.col("node").alias("__rest")), F.col("node") == F.col("__rest"), "left")
    flagged = flagged.withColumn("__is", F.col("__rest").isNotNull()).drop("__rest")

    def blocks(when: Column) -> Column:
        n = F.count(F.when(when, F.lit(1)))
        size = F.coalesce(F.sum(F.when(when, F.col("size").cast("double"))), F.lit(0.0))
        return F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES)).cast("int")

    counts = flagged.groupBy("group").agg(
        blocks(F.lit(True)).alias("__all"), blocks(F.col("__is")).alias("__cut")
    )
    hashed = F.xxhash64("node", F.lit(2))
    places = meet(flagged, counts.where("__cut > 0"), "group")

    def cell(left: Column, right: Column) -> Column:
        return left.cast("long") * (1 << 31) + right

    mine = F.pmod(hashed, F.col("__cut")).cast("int")
    yours = F.pmod(hashed, F.col("__all")).cast("int")
    as_all = F.transform(F.sequence(F.lit(0), F.col("__cut") - 1), lambda k: cell(k, yours))
    as_rest = F.transform(F.sequence(F.lit(0), F.col("__all") - 1), lambda k: cell(mine, k))
    keys = F.when(F.col("__is"), F.array_union(as_all, as_rest)).otherwise(as_all)
    return (
        places.withColumn("key", F.explode(keys))
        .withColumn("t", F.col("group"))
        .drop("group", "size", "__all", "__cut", "__is")
    )


def near_copies(docs: DataFrame, words: int, similarity: float, key: str = "__row") -> DataFrame:
    """(row, keep) of each row of ``docs``, keep being the row that stays of its near copies.

    ``key`` names a column of ``docs`` that tells its rows apart. Of a component the smallest doc_id stays, nulls
    last, then the smallest row.

    A pair of Jaccard similarity 0.8 differs in about 15 % of a fingerprint's bits, far
    beyond what block pigeonholes find. So candidates share a band of min-hashes (a pair
    of that similarity misses all bands with probability under 0.001), and are compared
    bit-sliced on fingerprints of 64 * ``LONGS`` bits within ``radius_for``. Of the texts that
    candidates connect, those of sufficient similarity by their shingle sets are linked.
    Texts of one shingle set are one node, the lowest of their rows.
    """
    radius = radius_for(similarity, 64 * LONGS)

    def run(batches):
        for b in sliced(batches):
            fps, keys, digests = signatures(raw(b.column("text")), words)
            flat = pa.array(keys.view(np.int64).ravel())
            cuts = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": b.column("row"),
                    "doc_id": b.column("doc_id"),
                    "same": pa.array(digests, pa.binary()),
                    "fp": pa.array([f.tobytes() for f in fps], pa.binary()),
                    "keys": pa.ListArray.from_arrays(cuts, flat),
                }
            )

    texts = docs.select(
        F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    rows = staged(
        texts.mapInArrow(run, "row long, doc_id long, same binary, fp binary, keys array<long>"),
        "similar",
    )
    nodes = staged(
        rows.groupBy("same").agg(
            F.min("row").alias("node"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"),
        ),
        "similar-nodes",
    )
    buckets = (
        rows.join(nodes.select("node"), F.col("row") == F.col("node"))
        .select("node", "fp", F.posexplode("keys").alias("p", "key"))
        .select(F.xxhash64("p", "key").alias("group"), "node", F.lit(0).alias("size"), "fp")
    )
    spark = docs.sparkSession
    folder = f"{scratch(spark)}/rosterproof-similar-{uuid.uuid4().hex[:12]}"
    coarse = bucket_links(cells(buckets, BLOCK), radius, "fp", "node")
    coarse = staged(coarse, "similar-candidates", f"{folder}/candidates")
    coarse = smallest_reachable(coarse, "similar-candidate-groups")
    coarse = coarse.unionAll(coarse.select(F.col("root").alias("node"), "root")).distinct()
    coarse = staged(coarse, "similar-candidate-roots", f"{folder}/roots")
    edges = staged(similar_links(texts, coarse, words, similarity, radius, folder), "similar-links")
    # Candidates and shingle sets have been compared.
    remove(spark, folder)
    roots = smallest_reachable(edges, "similar-components")
    labelled = nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    labelled = labelled.select("same", F.coalesce("root", "node").alias("root"), "best")
    lowest = labelled.groupBy("root").agg(F.min("best")["row"].alias("keep"))
    kept = meet(labelled, lowest, "root").select("same", "keep")
    return meet(rows.select("row", "same"), kept, "same").select("row", "keep")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component, the one of smallest doc_id, nulls last.

    Rows are told apart by a key of their own, so ids may be null or repeat.
    """
    rows, key = keyed(docs, "similar-rows")
    found = staged(near_copies(rows, words, similarity, key), "similar-copies")
    return without(rows, key, found.where("row <> keep").select("row"))
