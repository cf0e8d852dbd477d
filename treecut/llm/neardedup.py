"""Operator 4, near-duplicate detection with HyperMinHash.

1. Each text becomes its set of word shingles.  Texts with equal sets form a
   class; only classes go on.
2. The smallest hash in each of 256 parts of the hash space is kept as its
   count of leading zeros and ten mantissa bits.  Bands of six such registers
   (an empty one borrows another's, in a fixed random order) put classes into
   buckets; buckets with the same members are one bucket.
3. A bucket is cut into chunks of bounded size.  Two classes are compared in the
   first bucket that they share: the Jaccard similarity is estimated from the
   registers, less the collisions to be expected of registers this short; pairs
   that may reach the threshold are confirmed on their full sets, and a chunk
   returns a spanning forest of its links, not its pairs.
4. Where a bucket of several chunks is not yet one component, the classes outside
   its largest component are compared with each other and with those inside, chunk
   by chunk: no pair of a bucket is left out but those known to be one component.
   Buckets come in two rounds; those that are one component after the first need
   no second.
5. Components come from hooking to the smallest neighbour, pointer doubling and
   contraction.

Defined cases: a text without words has an empty set and links with nothing; a
text of one word has the shingle that is that word; rows may repeat (equal sets
always link); a row with a null key takes part, gets its component's smallest
key, and is kept only where the component has no key at all; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, growing, load, once_per_worker, scan, stored, words_of

#: Registers of a signature, each the smallest hash of its part of the space.
REGISTERS = 256
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Registers of a band. A pair at the least similarity of 0.8 agrees on a band
#: with probability 0.8 ** 6, and on none of the 42 bands with 3e-6.
BAND = 6
#: Buckets are compared in two rounds, in the order of their numbers: first about
#: six of a class's 42; by then most groups are one component, and only buckets
#: that are not go on.
ROUNDS = (-(1 << 63), -(1 << 63) + (1 << 64) // 7, 1 << 63)
#: Classes of a chunk of a bucket.
CHUNK = 512
#: An estimate this many standard deviations below the threshold is given up.
DEVIATIONS = 5.0


def shingles(text: str | None, size: int) -> set[bytes]:
    """Distinct shingles of ``size`` words; a shorter text is one shingle."""
    words = words_of(text)
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def hashes(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    own = shingles(text, size)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own), dtype=np.uint64, count=len(own)))


def class_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def registers(own: np.ndarray) -> np.ndarray:
    """HyperMinHash of sorted hashes: leading zeros and mantissa of the smallest
    hash per part.  A double holds just these two as exponent and fraction."""
    start = np.searchsorted(own, np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56))
    full = np.append(start[1:], len(own)) > start
    rest = own[np.minimum(start, len(own) - 1)] << np.uint64(8)
    bits = (rest >> np.uint64(11)).astype(np.float64).view(np.uint64)
    exponent = np.maximum(bits >> np.uint64(52), np.uint64(1023)) - np.uint64(1023)
    fraction = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return np.where(full, ((exponent << np.uint64(MANTISSA)) | fraction).astype(np.uint16), EMPTY)


def bands(signature: np.ndarray) -> list[int]:
    """One signed 64-bit hash per band."""
    full = signature != EMPTY
    if not full.all():
        order = once_per_worker("probes", lambda: np.random.default_rng(4).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1))
        empty = np.flatnonzero(~full)
        filled = signature.copy()
        filled[empty] = signature[order[empty, full[order[empty]].argmax(axis=1)]]
        signature = filled
    return [xxhash.xxh64_intdigest(signature[i : i + BAND].tobytes(), i) - (1 << 63) for i in range(0, REGISTERS - BAND + 1, BAND)]


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers of two unrelated sets of n and m shingles that agree
    by chance: both smallest hashes (exponential, in units of a part) fall into
    the same cell of the same leading-zero class."""
    a, b = np.asarray(n, dtype=float) / REGISTERS, np.asarray(m, dtype=float) / REGISTERS

    def cells() -> tuple[np.ndarray, np.ndarray]:
        both, low = np.logspace(-3, 12, 600), 2.0 ** -np.arange(1, 41)[:, None]
        return np.log(both), (low / (1 << MANTISSA) * (np.exp(-both * low) - np.exp(-both * 2 * low))).sum(axis=0)

    return a * b / (a + b) * np.interp(np.log(a + b), *once_per_worker("cells", cells))


def estimate(one: np.ndarray, n: int, many: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of one signature against ``many``."""
    used = (one != EMPTY) | (many != EMPTY)
    agree = ((one == many) & used).sum(axis=1)
    chance = expected_collisions(n, m)
    return (agree / np.maximum(used.sum(axis=1), 1) - chance) / (1 - chance)


def confirmed(left: list[np.ndarray], right: list[np.ndarray], near: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs ``near`` (left x right) reach the threshold on their
    full sets; shared shingles are counted as products of 0/1 matrices."""
    sets = [*left, *right]
    n, n_left = np.array([len(s) for s in sets]), len(left)
    value, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    common = often > 1  # a shingle of one set is shared with none
    owner, column = owner[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n_left, len(right)), dtype=np.float64)
    step = max(1, (4 << 20) // len(sets))
    for low in range(0, int(common.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(sets), min(step, int(common.sum()) - low)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        shared += part[:n_left] @ part[n_left:].T
    both = np.rint(shared).astype(np.int64)
    return near & (100 * both >= percent * (n[:n_left, None] + n[None, n_left:] - both))


def met_before(bucket: int, own: list[list[int]]) -> np.ndarray:
    """Whether two classes also meet in a bucket of a smaller number, where they
    are compared already.  ``own``: each class's buckets."""
    flat = np.array([b for x in own for b in x], dtype=np.int64)
    of = np.repeat(np.arange(len(own)), [len(x) for x in own])
    value, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    use = (often > 1) & (value < bucket)
    place, pick = np.cumsum(use) - 1, use[column]
    table = np.zeros((len(own), int(use.sum())), dtype=np.float32)
    table[of[pick], place[column[pick]]] = 1
    return table @ table.T > 0


def forest(bucket: int, rows: list[tuple], size: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the classes of a chunk, or of two, as a spanning forest.
    ``rows``: class number, whether of the second chunk, a text of the class, its
    buckets, its component so far."""
    rows = list({r[0]: r for r in rows}.values())
    number, second, text, own, label = zip(*rows)
    second, label = np.array(second), np.array(label)
    near = (label[:, None] != label) & ~met_before(bucket, own)
    if second.any():
        near &= ~second[:, None] & second
    else:
        near &= np.triu(np.ones_like(near), 1)
    use_l, use_r = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(use_l, use_r)]
    sets = {i: hashes(text[i], size) for i in np.union1d(use_l, use_r).tolist()}
    least = percent / 100
    n_l, n_r = (np.array([len(sets[i]) for i in use.tolist()], dtype=np.int64) for use in (use_l, use_r))
    near &= 100 * np.minimum(n_l[:, None], n_r) >= percent * np.maximum(n_l[:, None], n_r)
    signature = {i: registers(own) for i, own in sets.items()}
    right = np.array([signature[i] for i in use_r.tolist()])
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        at = np.flatnonzero(near[i])
        slack = DEVIATIONS * np.sqrt(least * (1 - least) / np.minimum(REGISTERS, np.maximum(n_l[i], n_r[at])))
        near[i, at] = estimate(signature[int(use_l[i])], n_l[i], right[at], n_r[at]) >= least - slack
    some_l, some_r = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(some_l):
        return
    use_l, use_r, near = use_l[some_l], use_r[some_r], near[np.ix_(some_l, some_r)]
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    linked = confirmed([sets[i] for i in use_l.tolist()], [sets[i] for i in use_r.tolist()], near, percent)
    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(use_l[i])), find(int(use_r[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
    for i in root:
        if find(i) != i:
            yield number[find(i)], number[i]


def sketch(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """Per row: its number (a hash of key and text), class, set size and bands."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(key, text).alias("row"))
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part, found = batch.slice(lo, 2000), []
                for (body,) in scan([part], "_text"):
                    own = hashes(body, size)
                    found.append((class_of(own), len(own), bands(registers(own))) if len(own) else (None, 0, []))
                cls, n, band = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "row", "cls", "n_shingles", "bands"])

    return source.mapInArrow(run, f"doc_id {kind}, row long, cls binary, n_shingles long, bands array<long>")


def compare(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Links found in groups (``bucket``, ``one``, ``two``) of texts."""
    fields = ["bucket", "one", "two", "member", "second", "_text", "own", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = groupby(scan(batches, *fields), key=lambda r: r[:3])
        links = (x for (bucket, _, _), rows in chunks for x in forest(bucket, [r[3:] for r in rows], size, percent))
        yield from emit(links, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    ordered = groups.select(*fields).repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of every node
    that ``links`` (a, b) name.  Each node hooks to its smallest neighbour, hooks
    are followed to their ends by doubling, and the links between the ends are the
    next round's: a link that is settled is never joined again."""
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    whole: DataFrame | None = None
    while whole is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "hooks")
        while True:
            ahead = hook.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            hook = stored(hook.join(growing(ahead), "label").select("node", F.col("_next").alias("label"), (F.col("label") != F.col("_next")).alias("_moved")), "hooks")
            moved = not hook.where("_moved").isEmpty()
            hook = hook.drop("_moved")
            if not moved:
                break
        if whole is None:
            whole = hook
        else:
            further = hook.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            whole = stored(whole.join(growing(further), "label", "left").select("node", F.coalesce("_next", "label").alias("label")), "labels")
        ends = [hook.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")) for side in "ab"]
        met = edges.join(growing(ends[0]), "a").join(growing(ends[1]), "b").where("_a <> _b")
        edges = stored(met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    return whole


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their component so far, of buckets that are not one
    component; ``inside`` are those of the bucket's largest component, of which the
    bucket has ``n_in``."""
    told = members.join(growing(labels.withColumnRenamed("node", "member")), "member", "left").withColumn("label", F.coalesce("label", "member"))
    told = stored(told, "labelled")
    parts = told.groupBy("bucket", "label").agg(F.count("*").alias("_n"))
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("_parts"), F.max(F.struct("_n", "label")).alias("_main")).where("_parts > 1")
    open_ = stored(open_.select("bucket", F.col("_main.label").alias("_main"), F.col("_main._n").alias("n_in")), "open")
    return told.join(growing(open_), "bucket").select("bucket", "member", "n", "label", "n_in", (F.col("label") == F.col("_main")).alias("inside"))


def _dealt(members: DataFrame, *groups: Column) -> DataFrame:
    """Members in the groups of chunks (``one``, ``two``) that each is sent to."""
    dealt = members.select("member", "bucket", "label", F.explode(F.array_distinct(F.flatten(F.array(*groups)))).alias("_g"))
    return dealt.select("member", "bucket", "label", "_g.one", "_g.two", "_g.second")


def _group(one: Column, two: Column, second: Column) -> Column:
    return F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), second.alias("second"))


def _chunks(n: Column) -> Column:
    return F.ceil(n / CHUNK).cast("int")


def _chunk(n: Column) -> Column:
    return F.pmod(F.xxhash64("member", "bucket"), _chunks(n)).cast("int")


def _diagonal(members: DataFrame) -> DataFrame:
    """Each chunk of a bucket by itself."""
    own = _chunk(F.col("n"))
    return _dealt(members, F.array(_group(own, own, F.lit(False))))


def _against_largest(members: DataFrame) -> DataFrame:
    """All pairs of a bucket that are not both of its largest component: chunks of
    the others meet each other and those of the largest one, which do not meet."""
    n_out = F.col("n") - F.col("n_in")
    outer, inner, zero = _chunks(n_out), _chunks(F.col("n_in")), F.lit(0)
    none = F.array().cast("array<struct<one:int,two:int,second:boolean>>")
    own = _chunk(n_out)
    others = F.transform(F.sequence(zero, outer - 1), lambda o: _group(F.least(own, o), F.greatest(own, o), own > o))
    largest = F.transform(F.sequence(outer, outer + inner - 1), lambda i: _group(own, i, F.lit(False)))
    mine = outer + _chunk(F.col("n_in"))
    met = F.transform(F.sequence(zero, outer - 1), lambda o: _group(o, mine, F.lit(True)))
    return _dealt(members, F.when(F.col("inside"), none).otherwise(F.concat(others, largest)), F.when(F.col("inside"), met).otherwise(none))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``
    and ``row`` (the hash of key and text by which a row can be found again)."""
    rows = stored(sketch(docs, text, key, size), "sketches")
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.min("row").alias("member"), F.first("bands").alias("bands")), "classes")
    band = classes.select("member", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("member")
    filled = band.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(20,0)")).alias("_sum"), F.bit_xor(mark).alias("_xor")).where("n > 1")
    buckets = stored(filled.groupBy("n", "_sum", "_xor").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    members = stored(band.join(growing(buckets), "bucket").select("bucket", "member", "n"), "members")
    own = members.groupBy("member").agg(F.sort_array(F.collect_list("bucket")).alias("own"))  # a bucket per band at most
    texts = docs.select(F.xxhash64(key, text).alias("member"), F.col(text).alias("_text"))
    texts = stored(texts.join(growing(own), "member").dropDuplicates(["member"]), "texts")
    links: DataFrame | None = None
    labels = docs.sparkSession.createDataFrame([], "node long, label long")
    for low, high in zip(ROUNDS, ROUNDS[1:]):
        here = members.where(F.col("bucket").between(low, high - 1))
        found = stored(_open_members(here, labels), "found")
        n_out = F.col("n") - F.col("n_in")
        whole, few = F.col("n") <= CHUNK, n_out <= CHUNK
        first = _diagonal(found.where(whole | ~few)).unionByName(_against_largest(found.where(~whole & few)))
        new = stored(compare(first.join(growing(texts), "member"), size, percent), "links")
        links = new if links is None else links.union(new)
        labels = components(links)
        # Buckets of which not all pairs were compared and that are not one component yet.
        rest = found.where(~whole & ~few).select("bucket", "member", "n")
        more = stored(compare(_against_largest(_open_members(rest, labels)).join(growing(texts), "member"), size, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)

    known = classes.select("cls", "member").join(growing(labels.withColumnRenamed("node", "member")), "member", "left")
    known = stored(known.select("cls", F.coalesce("label", "member").alias("_label")), "class-labels")
    # A row without words is a component of its own: its hash, with a flag.
    placed = stored(rows.join(growing(known), "cls", "left").select("doc_id", "row", "n_shingles", "_label"), "placed")
    least = stored(placed.where("_label is not null").groupBy("_label").agg(F.min("doc_id").alias("_least"), F.min("row").alias("_row")), "least")
    done = placed.join(growing(least), "_label", "left").withColumn("component_id", F.when(F.col("_label").isNull(), F.col("doc_id")).otherwise(F.col("_least")))
    alone = F.col("_label").isNull() | (F.col("_least").isNull() & (F.col("row") == F.col("_row")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), alone)
    return done.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are 80 % alike."""
    return near_duplicates(load(spark, sf_dir, "documents"), size=2).drop("row")
