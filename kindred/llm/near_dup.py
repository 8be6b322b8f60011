"""Operator 3: near-duplicate documents by MinHash bands, verified through odd sketches and full sets.

1. Each text becomes its set of distinct 5-word shingles (hashed), its MinHash samples, ``BANDS`` band keys of ``ROWS`` samples each, and
   an odd sketch: many more samples (the smallest hash in each of ``BINS`` parts of the hash range) folded into a parity bitmap. The XOR of
   two bitmaps has a population count that estimates how many samples differ, most precisely for high similarities (Mitzenmacher, Pagh
   and Pham, 2014).
2. Documents with equal sets (a 128-bit cryptographic digest of the full sorted set, and its size) form a class, represented by its
   smallest id; only representatives go on.
3. In each bucket (a band key that representatives share), every member is paired with the bucket's smallest member. Pairs whose
   sizes or sketches rule the threshold out are dropped (a pair at the threshold has a chance below 1e-6 of that); the others are decided
   on the full sets.
4. Links give components. A bucket whose other members lie in one component is settled: no further pair could change a component. Members of
   the other buckets meet in blocks, first their sketches, then the full sets of those that a sketch pairs with a document of another component;
   each pair of blocks returns a forest of the links that join components, at most a row for each document. So
   every pair that shares a band is decided or already joined, and no step emits all pairs of a bucket. Blocks are bounded
   by rows and by shingles.

At a similarity of 0.75 a pair shares none of the 32 bands with a chance of 5e-6.

Nulls and texts without words have empty sets: ``n_shingles`` 0, linked with nothing. Repeated rows are one
node with the doc_id they share, and stay as many rows; where their texts differ, each is compared and the id ties them. A null doc_id takes no part in links and is kept as its own
component (``component_id`` null, ``kept`` true). Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._shared import components, read, stage, unstage, with_lists

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Samples of an odd sketch, and its bits.
BINS, SKETCH_BITS = 512, 1024
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Standard errors beyond which a sketch rules a pair out.
SIGMAS = 5.0
#: Documents, and shingles, of a bucket that are compared with as many others in one task (roughly: they are parted by hash).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_rng = np.random.Generator(np.random.PCG64(977))
_A = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_I = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_WORDS = SKETCH_BITS // 64
SKETCH = [f"k{i}" for i in range(_WORDS)]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the SAMPLES hash functions over a set that isn't empty."""
    out = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[a : a + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    return X.mix((X.mix(samples ^ _I).reshape(-1, BANDS, ROWS) * _A[:ROWS]).sum(axis=2, dtype=np.uint64) + _B[:BANDS])


def bin_samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash in each of BINS parts of the hash range that isn't empty."""
    h = np.sort(X.mix(shingles ^ _I[0]))
    part = h >> np.uint64(64 - BINS.bit_length() + 1)
    return h[np.append(True, part[1:] != part[:-1])] if len(h) else h


def odd_sketch(samples: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps (rows of uint64) of lists of samples: bit h of a bitmap flips for each sample that hashes to h."""
    every = np.concatenate([*samples, np.zeros(0, np.uint64)])
    at = (X.mix(every ^ _I[1]) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    rows = np.repeat(np.arange(len(samples)), [len(s) for s in samples]) * SKETCH_BITS
    odd = np.bincount(rows + at, minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view(np.uint64).reshape(-1, _WORDS)


def most_differing(percent: int = PERCENT) -> np.ndarray:
    """By the number of parts that either of two sets fills: the largest XOR count of two sketches that doesn't rule the threshold out.

    At a similarity of J, at least J of the filled parts hold equal samples, but for sampling errors; the others give two
    differing samples at most.
    """
    j, filled = percent / 100, np.arange(BINS + 1)
    differing, error = 2 * (1 - j) * filled, 2 * np.sqrt(j * (1 - j) * filled)
    slope = np.exp(-2 * differing / SKETCH_BITS)
    count = SKETCH_BITS / 2 * (1 - slope)
    variance = (slope * error) ** 2 + np.maximum(SKETCH_BITS / 4 * (1 - slope**2) - differing * slope**2, 0)
    return np.ceil(count + SIGMAS * np.sqrt(variance) + 1).astype(np.int64)


def differing(xor_count: int) -> float:
    """The number of samples in only one of two sketches that their XOR count estimates."""
    return -SKETCH_BITS / 2 * math.log(1 - 2 * min(xor_count / SKETCH_BITS, 0.4999))


def estimate(xor_count: int, filled_a: int, filled_b: int) -> float:
    """The similarity that an XOR count of two odd sketches of so many samples estimates, where both fill about the same parts."""
    common = (filled_a + filled_b - differing(xor_count)) / 2
    return max(0.0, common) / max(filled_a, filled_b, 1)


_SIGNED = "doc_id long, t long, n_shingles long, s1 long, s2 long, filled int, bands array<long>, " + ", ".join(f"{k} long" for k in SKETCH)


def _sign(batches):
    fields = [("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("filled", pa.int32()), ("bands", pa.list_(pa.int64()))]
    schema = pa.schema(fields + [(k, pa.int64()) for k in SKETCH])
    for batch in batches:
        for part in X.slices(batch):
            n = part.num_rows
            size, digest = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            samples, bins = np.zeros((n, SAMPLES), np.uint64), []
            for i, s in enumerate(X.shingle_sets(part.column("text"))):
                bins.append(bin_samples(s))
                if len(s):
                    size[i], digest[i] = len(s), np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    samples[i] = minhash(s)
            keys = band_keys(samples)
            sketch = odd_sketch(bins)
            lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), X.signed(keys.ravel()))
            cols = [part.column("doc_id"), part.column("t"), pa.array(size), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array([len(b) for b in bins], pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(X.signed(np.ascontiguousarray(sketch[:, j]))) for j in range(_WORDS)], schema=schema)


def _shingled(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("s", pa.binary())])
    for batch in batches:
        for part in X.slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in X.shingle_sets(part.column("text"))], pa.binary())], schema=schema)


def _confirm(percent: int):
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(good))

    return run


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, s): full sets of the documents with these ids (doc); only their texts are shuffled and shingled."""
    ids = stage(ids.select("doc").distinct(), "ids")
    texts = with_lists(docs.select("doc_id", "text"), ids, "doc")
    out = stage(texts.mapInArrow(_shingled, "doc_id long, s binary").groupBy("doc_id").agg(F.min("s").alias("s")), "sets")
    unstage(ids)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets confirm; only texts of paired documents are shingled again."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    left = sets.select(F.col("doc_id").alias("a_"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b_"), F.col("s").alias("sb"))
    joined = pairs.hint("merge").join(left.hint("merge"), pairs.a == left.a_).select("a", "b", "sa").hint("merge").join(right.hint("merge"), F.col("b") == right.b_).select("a", "b", "sa", "sb")
    links = stage(joined.mapInArrow(_confirm(percent), "a long, b long"), "confirmed")
    unstage(sets)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    signed = stage(docs.mapInArrow(_sign, _SIGNED), "signed")
    docs, nodes, tied = _nodes(docs, signed)
    some = nodes.filter("n_shingles > 0 AND node IS NOT NULL").drop("doc_id").withColumnRenamed("node", "doc_id")
    classes = stage(some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = stage(
        some.hint("merge").join(classes.hint("merge"), ["s1", "s2", "n_shingles"]).select("doc_id", "rep", "n_shingles", "filled", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"), *SKETCH),
        "members",
    )
    unstage(classes)
    reps = member.filter("doc_id = rep")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = stage(keyed.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).filter("center < last").select("key", "center"), "buckets")
    inside = stage(keyed.hint("merge").join(buckets.hint("merge"), "key").filter("center < doc_id").select("key", "center", "doc_id").distinct(), "inside")
    unstage(buckets)
    stars = stage(inside.select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    held = [stars, inside]
    if not stars.limit(1).count():
        labels = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    else:
        sketches = stage(reps.select("doc_id", F.col("n_shingles").alias("n"), "filled", *SKETCH).dropDuplicates(["doc_id"]), "sketches")
        pairs = stage(_sketched(stars, sketches, percent), "pairs")
        links = _verified(pairs, docs, percent)
        labels = components(links)
        more = _settle(inside, sketches, labels, docs, percent)
        held += [sketches, pairs, links, labels]
        if more is not None:
            held.append(more)
            labels = components(links.union(more))
            held.append(labels)
    if tied is not None:
        tied = stage(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(tied.join(member, tied.b == member.doc_id).select("a", F.col("rep").alias("b"))), "edges")
        labels = components(tied)
        held += [tied, labels]
    label = labels.select(F.col("node").alias("rep"), "label")
    one = member.select("doc_id", "rep").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = one.hint("merge").join(label.hint("merge"), "rep", "left").select(F.col("doc_id").alias("d"), F.coalesce("label", "rep").alias("c"))
    found = stage(found, "found")
    unstage(member, *held)
    out = nodes.select("doc_id", "node", "n_shingles").join(found, F.col("node") == F.col("d"), "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _nodes(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs by node, signed with node, links (a, b) between the nodes of one id, or None).

    A node is a doc_id. Where an id stands in rows with different texts, the first text (by hash) has the id as its node, each other one
    a number beyond all ids, and links tie them.
    """
    several = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("t").alias("_m"), F.max("t").alias("_x")).filter("_m < _x").select(F.col("doc_id").alias("_d"), "_m")
    several = stage(several, "several")
    number = several.count()
    if not number:
        unstage(several)
        return docs.select("doc_id", "text"), signed.withColumn("node", F.col("doc_id")), None
    small = F.broadcast(several) if number <= 1_000_000 else several.hint("merge")
    beyond = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "t"), F.lit(1 << 61))
    node = F.when(F.col("_d").isNull() | (F.col("t") == F.col("_m")), F.col("doc_id")).otherwise(beyond)
    named = lambda df: df.join(small, df.doc_id == F.col("_d"), "left").withColumn("node", node).drop("_d", "_m")
    nodes = named(signed)
    tied = nodes.filter("n_shingles > 0 AND node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    return named(docs).select(F.col("node").alias("doc_id"), "text"), nodes, tied


def _differing(p: str, q: str) -> F.Column:
    total = F.lit(0)
    for k in SKETCH:
        total = total + F.bit_count(F.col(p + k).bitwiseXOR(F.col(q + k)))
    return total


def _sized(p: str, q: str, percent: int) -> F.Column:
    """Sets of such sizes can reach the threshold."""
    return F.least(p, q) * 100 >= F.greatest(p, q) * percent


def _sketched(stars: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    x = sketches.select(F.col("doc_id").alias("x"), F.col("n").alias("xn"), F.col("filled").alias("xf"), *(F.col(k).alias("x" + k) for k in SKETCH))
    y = sketches.select(F.col("doc_id").alias("y"), F.col("n").alias("yn"), F.col("filled").alias("yf"), *(F.col(k).alias("y" + k) for k in SKETCH))
    joined = stars.hint("merge").join(x.hint("merge"), stars.a == x.x).drop("x").hint("merge").join(y.hint("merge"), F.col("b") == y.y)
    limit = F.element_at(F.array(*(F.lit(int(v)) for v in most_differing(percent))), (F.least(F.lit(BINS), F.col("xf") + F.col("yf")) + 1).cast("int"))
    return joined.filter(_sized("xn", "yn", percent) & (_differing("x", "y") <= limit)).select("a", "b")


def _settle(inside: DataFrame, sketches: DataFrame, labels: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """Links across the components of each bucket's members (key, doc_id; all but the center, whose pairs are decided); None if there are none."""
    state = stage(inside.select("key", F.col("doc_id").alias("doc")).hint("merge").join(labels.hint("merge"), F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("label", "doc").alias("c")), "state")
    weight = sketches.select(F.col("doc_id").alias("d"), "n")
    ends = state.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_keys = stage(ends, "open_keys")
    if not open_keys.limit(1).count():
        unstage(state, open_keys)
        return None
    opened = stage(state.hint("merge").join(open_keys.hint("merge"), "key").hint("merge").join(weight.hint("merge"), F.col("doc") == F.col("d")).select("key", "doc", "c", "n"), "opened")
    blocks = opened.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    parts = stage(opened.hint("merge").join(blocks.hint("merge"), "key").withColumn("k", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("blocks")).cast("int")), "parts")
    full = parts.hint("merge").join(sketches.select(F.col("doc_id").alias("d"), "filled", *SKETCH).hint("merge"), F.col("doc") == F.col("d")).drop("d")
    cells = full.select("key", "doc", "c", "n", "filled", *SKETCH, "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    cells = cells.select("key", "doc", "c", "n", "filled", *SKETCH, "k", F.least("k", "x").alias("i"), F.greatest("k", "x").alias("j"))
    near = stage(cells.groupBy("key", "i", "j").applyInPandas(_near_in_cell(percent), "key long, i int, j int, k int, doc long, c long"), "near")
    unstage(state, open_keys, opened, parts)
    if not near.limit(1).count():
        unstage(near)
        return None
    sets = _sets(docs, near.select("doc"))
    met = near.hint("merge").join(sets.hint("merge"), F.col("doc") == F.col("doc_id")).select("key", "i", "j", "k", "doc", "c", "s")
    out = stage(met.groupBy("key", "i", "j").applyInPandas(_links_of_cell(percent), "a long, b long"), "settled")
    unstage(near, sets)
    return out


def _near_in_cell(percent: int):
    """Of two blocks of a bucket (or one), the documents that some sketch of another component may be similar to."""
    limit = most_differing(percent)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        words = cell[SKETCH].to_numpy(np.int64).view(np.uint64)
        n, filled, c, k = (cell[x].to_numpy() for x in ("n", "filled", "c", "k"))
        within = cell["i"].iloc[0] == cell["j"].iloc[0]
        keep = np.zeros(len(cell), bool)
        for a in range(len(cell)):
            b = np.flatnonzero((c != c[a]) & (np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent) & (within | (k != k[a])))
            b = b[b > a]
            if len(b):
                count = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
                b = b[count <= limit[np.minimum(BINS, filled[a] + filled[b])]]
                keep[b] = True
                keep[a] |= len(b) > 0
        return cell.loc[keep, ["key", "i", "j", "k", "doc", "c"]]

    return run


def _links_of_cell(percent: int):
    """Links of two blocks of a bucket (or inside one) that join components, as a forest: at most a row for each document."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("doc", ignore_index=True)
        k, doc, sets = cell["k"].to_numpy(), cell["doc"].tolist(), [np.frombuffer(s, np.uint64) for s in cell["s"]]
        within = cell["i"].iloc[0] == cell["j"].iloc[0]
        size = np.array([len(s) for s in sets])
        n = len(sets)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(column, kind="stable")
        posted, first = owner[order], np.append(0, np.cumsum(np.bincount(column)))
        parent = {c: c for c in cell["c"]}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        labels, out = cell["c"].tolist(), []
        ends = np.append(0, np.cumsum(size))
        for a in range(n):
            mine = column[ends[a] : ends[a + 1]]
            times = first[mine + 1] - first[mine]
            at = np.repeat(first[mine], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            common = np.bincount(posted[at], minlength=n)
            linked = 100 * common >= percent * (size[a] + size - common)
            linked[: a + 1] = False
            if not within:
                linked &= k != k[a]
            for b in np.flatnonzero(linked).tolist():
                p, q = root(labels[a]), root(labels[b])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((doc[a], doc[b]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
