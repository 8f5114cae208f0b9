"""Near-duplicates by b-bit MinHash (operator 5).

1. One pass over the texts gives each document its distinct 5-word shingles, the minima of 128 hash functions over them,
   32 band keys of 4 whole minima each, and a packed signature of the low 4 bits of every minimum (64 bytes).
2. Documents of one and the same set form a class; the smallest doc_id stands for it from here on.
3. Documents that share a band key are candidates. Each bucket pairs its members with its smallest id, never all with all.
   Matching nibbles of two signatures, corrected for chance collisions (1 in 16), estimate the similarity; pairs more than
   six standard errors below the threshold go. The rest are confirmed on their full sets, computed again from the texts.
4. Confirmed links are joined to components. In buckets that still hold several, members outside the largest component meet all
   others, by signature and in blocks of bounded size; those of the largest never meet each other. Members with a possible
   link to another component are reported, tied into clusters. Each cluster then confirms such links on full sets, in
   blocks again, and reports only links that join something.

What step 4 sends: with B members to a block, a member of the largest component goes to one task for every B members outside
it, and one of these to a task for every B members of the bucket. A million near copies and one straggler are a million rows
and a thousand. Where no component dominates, work is the product of what has to be compared. Texts are read again for candidates
alone; of clusters, the sets are sent. A hot bucket or a text with many partners is dealt over salts before it is joined.

A pair at the threshold of 0.85 shares no band with probability (1 - 0.85^4)^32 < 1e-10; nothing else loses links: no
cap holds on buckets, partners or candidates.

Defined results: a null or empty text, or one of white space, has no shingles, is its own component and is kept. A null
doc_id is linked with nothing and kept, with a null component. Equal doc_ids are one document. Texts are
shingled whole, however long, each in one task; a component is named by its smallest doc_id, so nothing ties. The query reads doc_id and text
alone; the stage keeps all columns whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import MIX_A, MIX_B, claim, columns_of, materialize, mixed, shingles, spread, table, word_hash
from lodestone.llm.components import components

WIDTH, HASHES, BANDS, BITS = 5, 128, 32, 4
ROWS = HASHES // BANDS
BLOCK = 1024  # members of a block, by signature
SET_SHARE = 512  # shingles of a set that weigh as much as one more member, where sets are sent
SALTS, HOT = 64, 1000  # parts of a hot key, and the pairs of one text from which it is hot
SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def hash_family(n: int = HASHES, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the hash functions x -> (a x + b) mod 2^64."""
    steps = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * MIX_A + np.uint64(seed))
    return steps[:n] | np.uint64(1), steps[n:]


def minima(sets: np.ndarray, family: tuple[np.ndarray, np.ndarray], block: int = 2048) -> np.ndarray:
    a, b = (x[:, None] for x in family)
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), block):
        values = a * sets[None, i : i + block]
        values += b
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    parts = low.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64) * MIX_B
    for j in range(rows):
        out = mixed(out + parts[:, j])
    return out


def packed(low: np.ndarray) -> bytes:
    """The low 4 bits of every minimum, two to a byte. The minima are folded first: with (a x + b) mod 2^64 the lowest
    bits would depend on the lowest bits of x alone."""
    nibbles = ((low ^ (low >> np.uint64(32)) ^ (low >> np.uint64(17))) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return (nibbles[0::2] | (nibbles[1::2] << 4)).tobytes()


def estimated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (rows of 64-bit words), from the count of equal nibbles, corrected for chance."""
    z = x ^ y
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    differ = np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(axis=-1)
    chance = 2.0**-BITS
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


def estimate_floor(threshold: float) -> float:
    chance = 2.0**-BITS
    p = threshold * (1 - chance) + chance
    return threshold - 6 * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = hash_family()
    claim(word_hash)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        n, a, b, bands, signatures = [], [], [], [], []
        for text in texts:
            s = shingles(text, WIDTH)
            n.append(len(s))
            a.append(int(mixed(s ^ MIX_A).sum().view(np.int64)) if len(s) else 0)
            b.append(int(mixed(s ^ MIX_B).sum().view(np.int64)) if len(s) else 0)
            low = minima(s, family)
            bands.append(band_keys(low).view(np.int64) if len(s) else None)
            signatures.append(packed(low) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
        )


def signed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, SIGNATURES)


def _candidates(floor: float):
    """Keeps pairs whose signatures allow a similarity at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(estimated(x, y) >= floor))

    return run


def _confirm(percent: int):
    """Pairs (a, b) with both texts, those of one a mostly side by side: keeps those with 100 |A and B| >= percent |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(word_hash)
        last, left = None, None
        for batch in batches:
            ids, texts_a, texts_b, keep = batch.column(0).to_pylist(), batch.column(2), batch.column(3), []
            for i, a in enumerate(ids):
                if a != last:
                    last, left = a, shingles(texts_a[i].as_py(), WIDTH)
                right = shingles(texts_b[i].as_py(), WIDTH)
                at = np.searchsorted(left, right)
                common = int(np.count_nonzero(left[np.minimum(at, len(left) - 1)] == right)) if len(left) else 0
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def salt_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def confirmed(spark: SparkSession, pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that hold on their full sets. Rows are linear in the pairs; the pairs of an a that has many are dealt over salts,
    and only its own text is repeated for them."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT, SALTS - 1).otherwise(0)))
    hot = counts.where(F.col("n") > HOT).select("a", salts.alias("salt"), F.lit(True).alias("hot"))
    dealt = pairs.withColumn("salt", salt_of("b")).join(hot, ["a", "salt"], "left").select("a", "b", F.when(F.col("hot"), F.col("salt")).otherwise(0).alias("salt"))
    left = counts.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", salts.alias("salt"))
    with_b = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.join(left, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by (key, i, j), as many at a time as arrive together."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches(([] if rest is None else rest.to_batches()) + [batch])
        if not rest.num_rows:
            continue
        key, i, j = (rest.column(n).to_numpy() for n in ("key", "i", "j"))
        whole = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
        if len(whole):
            cut = int(whole[-1]) + 1
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def split_groups(rows: pa.Table) -> Iterator[pa.Table]:
    key, i, j = (rows.column(n).to_numpy() for n in ("key", "i", "j"))
    edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
        yield rows.slice(start, end - start)


def near_rows(group: pa.Table, labels: np.ndarray, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block pair: (row, rows of the other block that another label has now and whose estimate allows a link)."""
    i, j, block = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("block").to_numpy()
    signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint64).reshape(len(block), -1)
    x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for k in range(0, len(x), 128):
        rows = x[k : k + 128]
        near = estimated(signatures[rows][:, None, :], signatures[y][None, :, :]) >= floor
        for row, hit in zip(rows.tolist(), near, strict=True):
            partners = y[hit]
            partners = partners[labels[partners] != labels[row]]
            if len(partners):
                yield row, partners


def merge(labels: np.ndarray, rows: np.ndarray) -> None:
    """One label for all that share one with rows: the smallest."""
    found = np.unique(labels[rows])
    labels[np.isin(labels, found)] = found[0]


def _active(floor: float):
    """Buckets' block pairs -> (id, component, root): members with a possible link to another component; components that such
    links tie within the block pair have one root. As many rows as members, not as pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches):
            out: dict[tuple[int, int], int] = {}
            for group in split_groups(rows):
                ids, comps = group.column("id").to_numpy(), group.column("component").to_numpy()
                roots, active = comps.copy(), np.zeros(len(ids), bool)
                for row, partners in near_rows(group, comps, floor):
                    active[row] = active[partners] = True
                    merge(roots, np.append(partners, row))
                for n in np.flatnonzero(active).tolist():
                    known = (int(ids[n]), int(roots[n]))
                    out[known] = int(comps[n])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array(list(out.values()), pa.int64()), pa.array([k[1] for k in out], pa.int64())], names=["id", "component", "root"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(word_hash)
    for batch in batches:
        sets = [shingles(t, WIDTH) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "size", "set"])


def _cluster_links(floor: float, percent: int):
    """Block pairs of a cluster with their sets -> links (a, b) confirmed on full sets, as many as join what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches):
            a, b = [], []
            for group in split_groups(rows):
                ids, labels = group.column("id").to_numpy(), group.column("component").to_numpy().copy()
                sets = [np.frombuffer(raw, np.uint64) for raw in group.column("set").to_pylist()]
                sizes = np.array([len(s) for s in sets])
                for row, partners in near_rows(group, labels, floor):
                    partners = partners[100 * np.minimum(sizes[partners], sizes[row]) >= percent * np.maximum(sizes[partners], sizes[row])]
                    linked = []
                    for n in partners.tolist():
                        if labels[n] in labels[linked]:
                            continue
                        common = len(np.intersect1d(sets[row], sets[n], assume_unique=True))
                        if 100 * common >= percent * (sizes[row] + sizes[n] - common):
                            linked.append(n)
                    if linked:
                        a += [int(min(ids[row], ids[n])) for n in linked]
                        b += [int(max(ids[row], ids[n])) for n in linked]
                        merge(labels, np.array([*linked, row]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def in_block_pairs(members: DataFrame, block: int | None = None) -> DataFrame:
    """members (key, id, component, weight) -> key, id, component, block, i, j: a row for each pair of blocks that a member has to be in.

    Keys of one component are left out. The blocks of the largest component of a key come first; they are paired with the blocks
    of the other members only, and these with each other too. A block weighs about as much as block says."""
    block = block or BLOCK
    sizes = members.groupBy("key", "component").agg(F.sum("weight").alias("weight"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("weight", "component")).alias("top"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks_of = lambda weight: F.ceil(weight / block).cast("int")
    keys = keys.select("key", F.col("top.component").alias("largest"), blocks_of(F.col("top.weight")).alias("own"), blocks_of(F.col("total") - F.col("top.weight")).alias("others"))
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = members.select("key", "id", "component").withColumn("salt", salt_of("id")).join(keys, ["key", "salt"])
    inside = F.col("component") == F.col("largest")
    place = F.xxhash64("id")
    placed = placed.withColumn("block", F.when(inside, F.pmod(place, F.col("own"))).otherwise(F.col("own") + F.pmod(place, F.col("others"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("own")).otherwise(0), F.col("own") + F.col("others") - 1)))
    return placed.select("key", "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def sorted_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def links(spark: SparkSession, reps: DataFrame, texts: DataFrame, percent: int = 85) -> DataFrame:
    """reps (doc_id, bands, signature) of classes -> (id, component) for every class that is not the smallest of its component."""
    floor = estimate_floor(percent / 100)
    members = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    buckets = members.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(spark, members.join(buckets, "key"), "members")
    signatures = reps.select(F.col("doc_id").alias("id"), "signature")
    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    signed_pairs = stars.join(signatures.withColumnRenamed("id", "b").withColumnRenamed("signature", "sig_b"), "b").join(signatures.withColumnRenamed("id", "a").withColumnRenamed("signature", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")
    stars = materialize(spark, signed_pairs.mapInArrow(_candidates(floor), "a long, b long"), "candidates")
    # Only texts of candidates are kept: the ids are broadcast where Spark finds them small, else the texts are shuffled once.
    wanted = stars.select(F.col("a").alias("doc_id")).union(stars.select(F.col("b").alias("doc_id"))).distinct()
    kept_texts = materialize(spark, texts.join(materialize(spark, wanted, "wanted"), "doc_id", "left_semi"), "texts")
    edges = materialize(spark, confirmed(spark, stars, kept_texts, percent), "links")
    comps = components(spark, edges)

    # In a bucket of two the only pair has been tried.
    labelled = members.where("n > 2").join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), F.lit(1).alias("weight"))
    open_rows = in_block_pairs(materialize(spark, labelled, "labelled")).join(signatures, "id")
    active = sorted_groups(open_rows).select("key", "i", "j", "block", "id", "component", "signature").mapInArrow(_active(floor), "id long, component long, root long")
    active = materialize(spark, active.distinct(), "active")
    if active.isEmpty():
        return comps
    ties = active.where("component <> root").select(F.col("root").alias("a"), F.col("component").alias("b"))
    clusters = components(spark, ties).withColumnRenamed("id", "member")
    own = active.select("id", F.col("component").alias("own")).distinct()
    sets = materialize(spark, texts.join(materialize(spark, own.select(F.col("id").alias("doc_id")).distinct(), "wanted"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, size long, set binary"), "sets")
    clustered = own.join(clusters, F.col("member") == F.col("own"), "left").join(sets.select("id", "size"), "id")
    clustered = clustered.select(F.coalesce("component", "own").alias("key"), "id", F.col("own").alias("component"), (1 + F.col("size") / SET_SHARE).alias("weight"))
    pairs = in_block_pairs(materialize(spark, clustered, "clusters")).join(signatures, "id").join(sets.select("id", "set"), "id")
    new = sorted_groups(pairs).select("key", "i", "j", "block", "id", "component", "signature", "set").mapInArrow(_cluster_links(floor, percent), "a long, b long")
    return components(spark, edges.union(materialize(spark, new, "links")))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    signatures = materialize(spark, signed(docs), "signatures")
    sets = signatures.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(spark, sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "bands", "signature")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    comps = links(spark, materialize(spark, reps, "reps"), texts, percent)
    labels = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = signatures.select("doc_id", "n_shingles", "set_a", "set_b").join(labels, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def dedup_stage(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one document of each group, columns unchanged."""
    gone = near_duplicates(spark, docs, percent).where(~F.col("kept")).select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*columns_of(docs))
