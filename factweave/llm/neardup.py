"""Near-duplicates by a multi-index Hamming join of MinHash signatures.

Each set of word shingles gets `HASHES` minima of 16 bits: its signature. At similarity s two signatures differ in Binomial(HASHES, 1 - s)
places; the radius R covers that with 3.5 standard deviations to spare at the threshold. The places are cut into `CHUNKS` chunks; by the pigeonhole
principle two signatures within R <= CHUNKS * (ERRORS + 1) - 1 agree in some chunk but for ERRORS = 1 places, so a key for
each chunk with each one place left out finds all pairs within R. Every found link is confirmed on the full sets.

Groups of copies never become all their pairs. Equal sets first become one representative. A bucket of equal keys is a star around its
smallest document, formed in two steps (in each map task, then over tasks), so a key that a third of all documents share reaches its reducer as
one row a task. The best star link of each document is confirmed and components are formed. What is left are buckets that hold several components. In the task that
has such a bucket, two bits of each minimum bound the Hamming distance of its members from below; components that come within the radius form a cluster, and only
the edges of a spanning forest leave the task. The members of a cluster are then settled on their full sets, in a grid of cells over blocks of members: a cell counts the common shingles
of all its pairs at once and again only the links that join components leave it. So pairs are compared where they meet and rows never grow with the square of a group; what a
block holds is bounded (`BLOCK_DOCS`, `BLOCK_SHINGLES`), and a bucket of more than `BUCKET` documents is a grid of its own.

Edge cases: null, empty or blank texts have the empty set and link with nothing; a text with fewer words than a shingle is one shingle;
rows with a null doc_id get no component and are kept; a doc_id that several rows have is one document that has all their links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.util import binaries, coded, materialise, mix, ragged, release, ship, shuffle_partitions, slices, words

HASHES, CHUNKS, ERRORS = 128, 21, 1
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Key rows in a partition of the join, and documents whose ids are broadcast at most (16 bytes each).
KEY_ROWS, BROADCAST_IDS = 2_000_000, 1_000_000
#: Documents of a bucket that one task compares by sketches; documents and shingles of a cell's side, on average.
BUCKET, BLOCK_DOCS, BLOCK_SHINGLES = 4096, 256, 200_000
#: Parts into which the rows of one class of equal sets are dealt.
SALT = 16

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_CUTS = [c * HASHES // CHUNKS for c in range(CHUNKS + 1)]


# --- sets and signatures -----------------------------------------------------------------------------------------------------


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, in a row, and where each text's start. A-Z count as a-z."""
    from xxhash import xxh3_64_intdigest

    flat, offsets = words(texts)
    codes, unique = coded(flat)
    each = np.fromiter((xxh3_64_intdigest(w.lower()) for w in unique.cast(pa.binary()).to_pylist()), np.uint64, len(unique))
    h, n = each[codes], np.diff(offsets)
    m = max(0, len(h) - size + 1)
    with np.errstate(over="ignore"):
        acc = h[:m].copy()
        for j in range(1, size):
            acc = mix(acc + np.uint64(j)) + h[j : j + m]
        acc = mix(acc)
        # windows inside one text only; a short text is one shingle, salted by its length
        count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        out = np.zeros(int(count.sum()), np.uint64)
        starts = np.concatenate([[0], np.cumsum(count)])
        long = np.flatnonzero(n >= size)
        at = np.repeat(offsets[:-1][long] - starts[:-1][long], count[long]) + (to := np.concatenate([np.arange(starts[i], starts[i + 1]) for i in long]) if len(long) else np.zeros(0, np.int64))
        out[to] = acc[at]
        for i in np.flatnonzero((n > 0) & (n < size)):
            x = np.uint64(n[i]) * np.uint64(0xC2B2AE3D27D4EB4F)
            for v in h[offsets[i] : offsets[i + 1]]:
                x = mix(np.array([x + v], np.uint64))[0]
            out[starts[i]] = x
    for i in long:
        out[starts[i] : starts[i + 1]].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[starts[:-1][count > 0]] = True
    return out[first], np.concatenate([[0], np.cumsum(first)])[starts]


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minima of each set that isn't empty, as 16-bit values."""
    base = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    at = 0
    while at < len(full):  # about 100,000 shingles at once stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(offsets[full], offsets[full[at]] + 100_000)))
        rows = full[at:to]
        lo, hi = offsets[rows[0]], offsets[rows[-1] + 1]
        part, cuts = base[lo:hi], offsets[rows] - lo
        for k in range(HASHES):
            low = np.minimum.reduceat((part ^ _XOR[k]) * _MUL[k], cuts)
            out[rows, k] = ((low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        at = to
    return out


def planes(sig: np.ndarray) -> np.ndarray:
    """The lowest and the second bit of all places of each signature. Places that differ in them differ, so they bound the Hamming distance from below."""
    return np.packbits(np.stack([sig & 1, sig >> 1 & 1], axis=1).astype(np.uint8), axis=2).reshape(len(sig), -1)


def sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in slices(batches):
            sets, offsets = shingles(b.column("text"), size)
            raw = memoryview(np.ascontiguousarray(sets)).cast("B")
            ids = [xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            sig = signatures(sets, offsets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(ids, pa.binary()), binaries(sig), binaries(planes(sig))], ["doc_id", "n_shingles", "set_id", "sig", "planes"])

    return run


def full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets, offsets = shingles(b.column("text"), size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ragged(sets, offsets)], ["id", "set"])

    return run


# --- the join ----------------------------------------------------------------------------------------------------------------


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """HASHES keys of each signature: place j stands for its chunk without place j."""
    with np.errstate(over="ignore"):
        each = mix(sig.astype(np.uint64) + _SALT)
        keys = np.empty_like(each)
        for a, z in zip(_CUTS[:-1], _CUTS[1:], strict=True):
            keys[:, a:z] = mix(each[:, a:z].sum(axis=1, dtype=np.uint64)[:, None] - each[:, a:z] + _SALT[a:z])
    return keys


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal stretches of a sorted array."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return cut, np.append(cut[1:], len(key))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `rows` rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def emit_keys(dealt: int):
    """(to, key, id, leader): of the documents that share a key in a task only the smallest goes to the key's own partition; the others
    have found their leader and are dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 8192):
            ids = b.column("id").to_numpy()
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            key, doc = chunk_keys(sig).ravel().view(np.int64), np.repeat(ids, HASHES)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            a, z = runs(key)
            leader = np.repeat(doc[a], z - a)
            to = (mix(key.view(np.uint64)) % np.uint64(dealt)).astype(np.int32)
            rest = np.flatnonzero(doc != leader)
            to[rest] = (mix(doc[rest].view(np.uint64) ^ key[rest].view(np.uint64)) % np.uint64(dealt)).astype(np.int32)
            for i in range(0, len(key), 1 << 18):
                s = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(to[s]), pa.array(key[s]), pa.array(doc[s]), pa.array(leader[s])], ["to", "key", "id", "leader"])

    return run


def find_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, leader) of keys that two documents or more share; a leader's own row only where other tasks or documents have the key."""
    got = [[c.to_numpy() for c in (b.column("key"), b.column("id"), b.column("leader"))] for b in batches if b.num_rows]
    if not got:
        return
    key, doc, leader = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    rest = doc != leader
    order = np.lexsort((doc[~rest], key[~rest]))
    k, d = key[~rest][order], doc[~rest][order]
    a, z = runs(k)
    first = np.repeat(d[a], z - a)
    shared = np.repeat(z - a, z - a) > 1
    key, doc, leader = np.concatenate([key[rest], k[shared]]), np.concatenate([doc[rest], d[shared]]), np.concatenate([leader[rest], first[shared]])
    for i in range(0, len(key), 1 << 18):
        s = slice(i, i + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(doc[s]), pa.array(leader[s])], ["key", "id", "leader"])


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of equal places of each pair's signatures."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).sum(axis=1).astype(np.int32))], ["a", "b", "same"])


def confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("set_a"), b.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    n = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * n >= percent * (len(both) - n)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


class Forest:
    """Sets that join: `join` says whether two were apart."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def root(self, x: int) -> int:
        while (y := int(self.up[x])) != x:
            self.up[x] = x = int(self.up[y])
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def joined(forest: Forest, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Of the pairs (x, y) of sets the places of those that join two that were apart."""
    if not len(x):
        return []
    r = forest.roots()
    _, first = np.unique(r[x] * len(r) + r[y], return_index=True)
    return [i for i in first.tolist() if forest.join(int(x[i]), int(y[i]))]


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (la, lb) that connect the components in each bucket (key, cell) whose members come within RADIUS by their planes. Rows come in order of key and cell."""
    small = 16

    def within(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = p ^ q
        return np.bitwise_count(d[..., 0] | d[..., 2]).astype(np.int16) + np.bitwise_count(d[..., 1] | d[..., 3]) <= RADIUS

    def bucket(label: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, int]]:
        names, own = np.unique(label, return_inverse=True)
        forest, apart = Forest(len(names)), len(names) - 1
        for i in range(0, len(own), 128):
            if not apart:
                return
            u, v = np.nonzero(within(p[i : i + 128, None], p[None, i:]))
            x, y = own[i + u], own[i + v]
            for k in joined(forest, x[x != y], y[x != y]):
                apart -= 1
                yield names[x[x != y][k]], names[y[x != y][k]]

    def settle(key, label, p) -> pa.RecordBatch:
        a, z = runs(key)
        n = z - a
        few = np.repeat(n <= small, n)
        out = [np.zeros((0, 2), np.int64)]
        for d in range(1, small):
            i = np.flatnonzero(few[:-d] & (key[d:] == key[:-d]) & (label[d:] != label[:-d])) if len(key) > d else np.zeros(0, np.int64)
            i = i[within(p[i], p[i + d])]
            out.append(np.stack([label[i], label[i + d]], axis=1))
        for k in np.flatnonzero(n > small):
            if got := list(bucket(label[a[k] : z[k]], p[a[k] : z[k]])):
                out.append(np.array(got, np.int64))
        both = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    rest = None
    for b in gathered(batches, 1 << 16):
        key = mix(b.column("key").to_numpy().view(np.uint64) + b.column("cell").to_numpy().astype(np.uint64)) if b.num_rows else None
        now = [key, b.column("label").to_numpy(), np.frombuffer(b"".join(b.column("planes").to_pylist()), np.uint64).reshape(-1, 4)]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = runs(now[0])[0][-1]  # the last bucket may go on
        if cut:
            yield settle(*(x[:cut] for x in now))
        rest = [x[cut:] for x in now]
    if rest is not None:
        yield settle(*rest)


def common(sets: list[np.ndarray], n: int) -> np.ndarray:
    """How many shingles each of the first n sets has in common with each of the others."""
    m = len(sets) - n
    size = np.array([len(x) for x in sets])
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    a, z = runs(flat)
    left = np.add.reduceat((own < n).astype(np.int64), a)
    right = (z - a) - left
    total = np.zeros((n, m), np.int64)
    # a shingle in many sets is a column of two matrices, one in few is counted pair by pair
    dense = left * right * 24 > n * m
    wide = np.flatnonzero(dense)
    for i in range(0, len(wide), 4096):
        part = wide[i : i + 4096]
        each = np.concatenate([np.arange(x, y) for x, y in zip(a[part], z[part], strict=True)])
        table = np.zeros((len(sets), len(part)), np.float32)
        table[own[each], np.repeat(np.arange(len(part)), (z - a)[part])] = 1
        total += (table[:n] @ table[n:].T).astype(np.int64)
    thin = np.flatnonzero(~dense & (left > 0) & (right > 0))
    i = 0
    work = np.cumsum(left[thin] * right[thin])
    while i < len(thin):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + (1 << 20))))
        part = thin[i:j]
        x = np.concatenate([own[u:v] for u, v in zip(a[part], a[part] + left[part], strict=True)])
        times = np.repeat(right[part], left[part])
        begin = np.repeat(a[part] + left[part], left[part])
        at = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())
        total += np.bincount(np.repeat(x, times) * m + own[at] - n, minlength=n * m).reshape(n, m)
        i = j
    return total


def settle_cells(percent: int):
    """Links (a, b) that join components in each cell(cluster, i, j): members of block i against those of block j, on their full sets. Rows come in order of cells, block i first."""

    def cell(side: np.ndarray, ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
        n = len(ids) if same else int((side == 0).sum())
        if not n or (not same and n == len(ids)) or (label == label[0]).all():
            return []
        every = [*sets, *sets] if same else sets
        both = common(every, n)
        size = np.array([len(x) for x in every])
        x, y = np.nonzero(100 * both >= percent * (size[:n, None] + size[None, n:] - both))
        y = y + (0 if same else n)
        names, own = np.unique(label, return_inverse=True)
        apart = own[x] != own[y]
        x, y = x[apart], y[apart]
        return [(int(ids[x[k]]), int(ids[y[k]])) for k in joined(Forest(len(names)), own[x], own[y])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            side, ids, label, sets = zip(*held, strict=True)
            got = cell(np.array(side), np.array(ids), np.array(label), list(sets), now[1] == now[2])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

        for b in batches:
            names = [b.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "id", "label")]
            for *at, side, doc, label, x in zip(*names, b.column("set"), strict=True):
                if now != at and held:
                    yield out()
                    held = []
                now = at
                held.append((side, doc, label, np.frombuffer(x.as_buffer(), np.uint64).copy()))
        if held:
            yield out()
        release()

    return run


# --- components --------------------------------------------------------------------------------------------------------------


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(id, label): the smallest id reachable over links(a, b). Minima spread to neighbours and then jump to the label's own label, so
    the number of rounds grows with the logarithm of the longest chain; each round is cut by a written table."""
    both = materialise(links.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.filter("a <> b").select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "ends")
    labels = materialise(both.groupBy(F.col("x").alias("id")).agg(F.least(F.col("x"), F.min("y")).alias("label")), name)
    while True:
        near = both.join(labels, both.y == labels.id).groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = materialise(step.join(up, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), name)
        labels = step.select("id", "label")
        if step.filter("label <> old").isEmpty():
            return labels


# --- the operator ------------------------------------------------------------------------------------------------------------


class NearDuplicates:
    """Links between documents whose sets of `size`-word shingles have a similarity of `percent` or more."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80):
        # R must cover the mean and 3.5 standard deviations of the differing places at the threshold
        p = 1 - percent / 100
        if HASHES * p + 3.5 * (HASHES * p * (1 - p)) ** 0.5 > RADIUS + 1:
            raise ValueError("the signature's radius doesn't cover this similarity")
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        ship(self.spark)
        self.docs = docs.select("doc_id", "text")
        self.rows = materialise(self.docs.mapInArrow(sketch(size), "doc_id long, n_shingles long, set_id binary, sig binary, planes binary"), "signatures")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(id, set) of the full sets, made again from the texts of these ids; a doc_id with several texts has several rows."""
        ids = materialise(ids.distinct(), "wanted")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return materialise(self.docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(full_sets(self.size), "id long, set binary"), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b) those that link on the full sets."""
        sets = self.sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
        one, two = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        return materialise(pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(confirm(self.percent), "a long, b long"), "links")

    def within_radius(self, pairs: DataFrame, sigs: DataFrame) -> DataFrame:
        """(a, b, same) of pairs whose signatures differ in RADIUS places at most."""
        one, two = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        return pairs.join(two, "b").join(one, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(agreeing, "a long, b long, same int").filter(F.col("same") >= HASHES - RADIUS)

    def labels(self) -> DataFrame:
        """(id, label) of all documents that have a link; label is the smallest doc_id reachable."""
        some = self.rows.filter("n_shingles > 0 and doc_id is not null")
        classes = some.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
        classes = materialise(classes, "classes")
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part")
        equal = some.select("doc_id", "set_id", F.pmod("doc_id", F.lit(SALT)).cast("int").alias("part")).join(classes.filter("n > 1").select("set_id", "id", parts), ["set_id", "part"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        # sets of three shingles or fewer link with equal sets only; a doc_id with several texts has a signature for each
        sigs = materialise(some.filter(f"n_shingles * {100 - self.percent} >= {self.percent}").join(classes.select(F.col("id").alias("doc_id"), "set_id"), ["doc_id", "set_id"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "sig", "planes"), "sigs")
        n = max(shuffle_partitions(self.spark), sigs.count() * HASHES // KEY_ROWS)
        keys = sigs.mapInArrow(emit_keys(8 * n), "to int, key long, id long, leader long")
        stars = materialise(keys.repartition(n, "to").drop("to").mapInArrow(find_stars, "key long, id long, leader long"), "stars")
        pairs = stars.filter("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).count().select("a", "b")
        near = self.within_radius(pairs, sigs)
        # the link of each document that looks best is confirmed first
        best = near.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")).select("a", "b")
        links = self.confirmed(materialise(best, "best"))
        members = stars.select("key", "id").unionByName(stars.filter("id <> leader").select("key", F.col("leader").alias("id"))).distinct()
        left = materialise(self.mixed(members, components(links)), "mixed")
        clusters = self.clusters(left, sigs, n)
        links = links.unionByName(self.settled(left.select("id", "label").distinct().join(clusters, "label"), sigs, n))
        return components(links.unionByName(equal))

    def mixed(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, n, id, label) of members(key, id) whose bucket of n holds more than one component."""
        known = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        keys = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
        return known.join(keys, "key").select("key", "n", "id", "label")

    def clusters(self, left: DataFrame, sigs: DataFrame, tasks: int) -> DataFrame:
        """(label, cluster): components that reach each other through buckets in which members come within the radius."""
        block = F.pmod(F.xxhash64("id"), F.col("side"))
        cells = left.withColumn("side", F.ceil(F.col("n") / BUCKET)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
        cells = cells.select("key", (F.least(block, "j") * F.col("side") + F.greatest(block, "j")).alias("cell"), "id", "label")
        met = cells.join(sigs.select("id", "planes"), "id").repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(meet, "a long, b long")
        return components(materialise(met.distinct(), "met"), "clusters").select(F.col("id").alias("label"), F.col("label").alias("cluster"))

    def settled(self, docs: DataFrame, sigs: DataFrame, tasks: int) -> DataFrame:
        """The links that join components among docs(id, label, cluster). A component with more members than a block fills blocks of its own, which aren't compared with each other."""
        docs = materialise(docs.join(sigs.groupBy("id").agg(F.sum("n_shingles").alias("n")), "id"), "clustered")
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES))
        own = docs.groupBy("cluster", "label").agg(blocks.alias("own"), F.count("*").alias("docs"), F.sum("n").alias("n"))
        of = Window.partitionBy("cluster").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
        large = own.filter("own > 1").withColumn("first", F.coalesce(F.sum("own").over(of), F.lit(0)))
        small = own.filter("own = 1").groupBy("cluster").agg(F.ceil(F.greatest(F.sum("docs") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).alias("small"))
        total = materialise(own.groupBy("cluster").agg(F.sum(F.when(F.col("own") > 1, F.col("own")).otherwise(0)).alias("large")).join(small, "cluster", "left").select("cluster", "large", F.coalesce("small", F.lit(0)).alias("small")), "grids")
        placed = docs.join(materialise(large.select("cluster", "label", "own", "first"), "large"), ["cluster", "label"], "left").join(total, "cluster")
        block = F.when(F.col("own").isNotNull(), F.col("first") + F.pmod(F.xxhash64("id"), F.col("own"))).otherwise(F.col("large") + F.pmod(F.xxhash64("label", F.lit(1)), F.col("small")))
        # blocks of one large component are skipped against each other
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("large") + F.col("small") - 1), lambda j: F.col("own").isNull() | (j < F.col("first")) | (j >= F.col("first") + F.col("own")))
        cells = placed.withColumn("block", block).select("id", "label", "cluster", "block", F.explode(others).alias("other"))
        cells = materialise(cells.select("id", "label", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side")), "cells")
        sets = self.sets_of(docs.select("id"))
        by = ("cluster", "i", "j")
        return materialise(cells.join(sets, "id").repartition(tasks, *by).sortWithinPartitions(*by, "side").mapInArrow(settle_cells(self.percent), "a long, b long"), "settled")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row."""
        found = self.rows.select("doc_id", "n_shingles").join(self.labels().withColumnRenamed("id", "doc_id"), "doc_id", "left")
        component = F.coalesce("label", "doc_id")
        return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    return NearDuplicates(docs, size, percent).run()


def op10_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those whose group has a smaller doc_id; rows without a doc_id stay."""
    labels = NearDuplicates(docs, size, percent).labels()
    gone = materialise(labels.filter("label <> id").select(F.col("id").alias("doc_id")), "dropped")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
