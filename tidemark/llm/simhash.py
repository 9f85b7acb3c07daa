"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared at anchors.  The anchors are the words of a covering
code on 61 of the 64 bits: two blocks of the perfect binary Golay code, covering
radius 3, and one of the perfect Hamming code of length 15, covering radius 1,
together 2**35 anchors.  Every fingerprint has one home, its nearest anchor, and
is replicated to every anchor within covering radius plus threshold, some 150:
two fingerprints within the threshold meet at the home of either.  The blocks
share the threshold, so their excess distances add up to at most it.

Anchors with few fingerprints compare all of them with those at home there.  At
crowded anchors nothing is compared pairwise: two fingerprints differ in at most
two bits exactly if some point lies within one bit of both, so each is sent to
its 65 neighbouring points and linked to the least one there, which gives the
same components with a number of links in proportion to the fingerprints.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Words per shingle, hash seed, and bits that may differ.
SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Generator polynomial, length and covering radius of the [23, 12] Golay and the
#: [15, 11] Hamming code (fixed values); their words side by side are the anchors.
GOLAY, HAMMING = (0xC75, 23, 3), (0x13, 15, 1)
BLOCKS = (GOLAY, GOLAY, HAMMING)
#: An anchor with more fingerprints is crowded.
CROWDED = 64
#: Shingles whose bits are counted at a time.
STEP = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included, unsigned."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= k:
        return h(b" ".join(w), SEED)
    n, ones = len(w) - k + 1, np.zeros(64, dtype=np.int64)
    join = b" ".join
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        grams = zip(*(w[a + j : b + j] for j in range(k)), strict=True)
        hashes = np.array([h(join(g), SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def syndrome(x: np.ndarray, generator: int, length: int) -> np.ndarray:
    """Remainder of words of ``length`` bits by the generator polynomial."""
    s, degree = x.astype(np.uint32), generator.bit_length() - 1
    for bit in range(length - 1, degree - 1, -1):
        s = np.where(s >> bit & 1, s ^ np.uint32(generator << (bit - degree)), s)
    return s


@cache
def cosets(generator: int, length: int, radius: int) -> list[np.ndarray]:
    """Error patterns by syndrome, one table per excess distance 0, 1, 2.

    Table e holds, for each syndrome, all patterns of weight up to the radius
    (e = 0: exactly one, the code is perfect) or of weight radius + e; rows are
    filled up with -1.
    """
    out = []
    for e in range(THRESHOLD + 1):
        weights = range(radius + 1) if e == 0 else [radius + e]
        pats = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(length), w)], dtype=np.int64)
        s = syndrome(pats, generator, length).astype(np.int64)
        order = np.argsort(s, kind="stable")
        s, pats = s[order], pats[order]
        count = np.bincount(s, minlength=1 << (generator.bit_length() - 1))
        table = np.full((len(count), count.max()), -1, dtype=np.int64)
        table[s, np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)] = pats
        out.append(table)
    return out


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, is home) for all anchors that cover it."""
    x, at, near = fp.view(np.uint64), 0, []
    for code in BLOCKS:
        part = (x >> np.uint64(at) & np.uint64((1 << code[1]) - 1)).astype(np.int64)
        s = syndrome(part, code[0], code[1])
        words = [np.where(t[s] < 0, -1, (part[:, None] ^ t[s]) << at) for t in cosets(*code)]
        near.append(words)
        at += code[1]
    index, anchors, home = [], [], []
    for excess in product(range(THRESHOLD + 1), repeat=len(BLOCKS)):
        if sum(excess) > THRESHOLD:
            continue
        key = np.zeros((len(fp), 1), dtype=np.int64)
        for words, e in zip(near, excess):
            one, two = key[:, :, None], words[e][:, None, :]
            key = np.where((one < 0) | (two < 0), -1, one | two).reshape(len(fp), -1)
        i, j = np.nonzero(key >= 0)
        index.append(i)
        anchors.append(key[i, j])
        home.append(np.full(len(i), not any(excess)))
    return np.concatenate(index), np.concatenate(anchors), np.concatenate(home)


def covered(fps: DataFrame) -> DataFrame:
    """Each distinct fingerprint at all its anchors: anchor, fp, home."""

    def run(batches):
        for b in batches:
            all_fp = b.column("fp").to_numpy()
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at : at + 4096]
                i, anchor, home = anchors_of(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i]), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components
    are those of all pairs that differ in at most THRESHOLD bits."""
    post = covered(fps)
    homes = covered(fps).filter("home").select("anchor").distinct()
    # Only anchors that are some fingerprint's home can bring a pair together.
    # Always by shuffle: both sides grow with the fingerprints.
    cand = scratch.put(post.join(homes.hint("merge"), "anchor"))
    crowd = cand.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    at = cand.join(crowd, "anchor")
    few = at.filter(F.col("n") <= CROWDED).select("anchor", "fp", "home")
    pairs = (
        few.filter("home")
        .select("anchor", F.col("fp").alias("a"))
        .join(few.select("anchor", F.col("fp").alias("b")), "anchor")
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD))
        .select("a", "b")
    )
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    spread = at.filter(F.col("n") > CROWDED).select("fp").distinct().withColumn("point", F.explode(points))
    # At most 65 distinct fingerprints lie within one bit of a point.
    least = F.min("fp").over(Window.partitionBy("point"))
    stars = spread.select(F.col("fp").alias("a"), least.alias("b")).filter("a != b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, spark_scratch: Scratch) -> DataFrame:
    """node and label (the least node of its component) for all nodes of ``edges`` (a, b).

    Each round takes the least label among the neighbours and then the label's
    own label, which shortens long chains; rounds are written to the shared
    folder.  Nothing but the number of changes comes to the driver.
    """
    both = spark_scratch.put(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().toDF("node", "other")
    )
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    labels = spark_scratch.put(labels)
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        best = both.join(seen, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = spark_scratch.put(
            step.join(up, "label", "left").select("node", "old", F.least(F.col("label"), F.coalesce("above", "label")).alias("label"))
        )
        if not new.filter("label != old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, fp, component_id.

    component_id is the smallest doc_id that can be reached over links between
    fingerprints that differ in at most two bits.  A text without words (null,
    empty, white space) has fingerprint zero and is linked like any other.  Null
    ids are passed over unless a component has no other.  Equal fingerprints are
    one node, so copies cost one row each.  Other columns are not read; an empty
    table gives no rows.  Who gives a ``scratch`` may drop it after reading.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, k))
    nodes = scratch.put(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    label = components(links(nodes, scratch), scratch)
    named = nodes.join(label, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    per_fp = named.join(least, "label").select("fp", "component_id")
    return rows.join(per_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
