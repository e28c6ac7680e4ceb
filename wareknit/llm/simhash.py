"""Near duplicates by SimHash fingerprints, found with pivot distance tables.

Texts are fingerprinted in 64 bits (words between ASCII white space, A-Z lower-cased; XXH64 of shingles; a bit is set if
over half the shingles' hashes have it), and two kinds of links are followed to groups.

fingerprint_groups: three-word shingles, repeats included; fingerprints, each kept once, are linked at 3 or fewer
differing bits. The pivot table holds each fingerprint's Hamming distances to many reference fingerprints, eight to a
long. By the triangle inequality, two fingerprints within 3 bits differ by at most 3 in every coordinate, so that a
pair whose coordinates differ by more is discarded; survivors are verified bit by bit. Pairs are only looked for where
whole blocks of bits agree: 3 bits that differ leave at least two of five blocks whole (with more fingerprints: three of
six, or four of seven), so that no link is lost, and the join's condition discards and verifies before a pair is made.

one_of_each_group: sets of five-word shingles, linked at a Jaccard similarity of 0.8 or more. Such pairs differ in up to a
sixth of their bits (small sets in more), and no 64 bits leave a block whole for sure; so a set has BANDS words of 64 bits, a longer fingerprint, and
texts meet where one of its BANDS * BLOCKS blocks of BITS bits is whole (a pair of similarity 0.8 has no such
block with chance 0.00006; sets of fewer than LARGE shingles also meet on FEW_BITS bits). The closest pairs (NEAR of
64 bits) are linked before, as in fingerprint_groups. Blocks are then held against each other only to find the texts that meet
any of another group: pivot table and bits discard inside that join, which makes a row for each block of a text at
most, never one for each pair. What meets there is looked at as follows, and survivors are verified on the whole shingle sets.

Members of a key are looked at twice, so that a group of many copies doesn't make all its pairs. First each is held
against the key's head (its smallest member or, of similar texts, the one that meets most others in all its keys). Then, in keys of three members or more, those that didn't get into the head's
group are held against all members that aren't in their own group: all pairs whose link could still join two groups. The head is a pivot there: its
distance to each member is known, and pairs whose distances to it differ by more than the limit are discarded. Texts
meet on shingles the second time, each on its rarest ones only, as many as two texts of similarity 0.8 need to share
one. So versions of one text that were changed too much to be near duplicates don't meet each other.

Groups: labels go along links by alternating large-star and small-star steps, each step written to the shared folder,
until nothing changes.

Edge cases: null and word-less texts are one group (fingerprint zero, linked like any other); a text of fewer words than
a shingle is one shingle; equal fingerprints are one group; null ids are ignored by the smallest id unless a group has
no other; repeated rows each have a row, and are rows like any other where one of a group stays; an empty table gives an
empty result; other columns are not read, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved, slices, whole_text

NEAR = 3
PIVOTS = 16
SEED = 42
SHINGLE, SIMILAR = 5, 0.8
#: Large sets of similarity 0.8 differ in 10 bits on average, with a deviation of 3. Bits of sets of fewer than LARGE shingles
#: spread wider (a set of five against four of them can differ in thirty): they are not discarded by their fingerprints.
FAR, LARGE = 22, 64
#: Words of a set's longer fingerprint, blocks of a word (one begins at each sixteenth bit), and a block's bits; FEW_BITS of small sets.
BANDS, BLOCKS, BITS, FEW_BITS = 25, 4, 14, 10
#: Chance that a bit differs between sets of similarity 0.8 at most: large ones, small ones (five shingles and four of them).
DIFFER, DIFFER_SMALL = 0.154, 0.1875
#: Rare shingles that a text carries to its meetings; only what is discarded there depends on it.
START = 64
#: Links that a task writes in the search for groups.
LINKS_A_TASK = 100_000
#: Odd factors that make a shingle's hash BANDS hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, length: int) -> np.ndarray:
    """XXH64 of the text's shingles, as big-endian integers."""
    import xxhash

    words = text.encode().lower().split()
    shingles = map(b" ".join, zip(*(words[k:] for k in range(length)))) if len(words) >= length else [b" ".join(words)] if words else []
    digest, seed = xxhash.xxh64_digest, SEED
    return np.frombuffer(b"".join([digest(s, seed) for s in shingles]), ">u8")


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint (as a signed integer): the bits that over half the hashes have."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):  # a very long text is summed in pieces
        ones += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: str) -> int:
    return bits_of(shingle_hashes(text, 3))


def fingerprint(text: Column) -> Column:
    """The 64 bits as a (signed) long."""

    @F.arrow_udf("long")
    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t.as_py() or "") for t in batch], pa.int64())

    return bits(text)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of their numbers."""
    import xxhash

    return [int.from_bytes(xxhash.xxh64_digest(f"pivot {i}".encode(), SEED), "big", signed=True) for i in range(n)]


def pivot_table(fps: DataFrame, n: int = PIVOTS) -> DataFrame:
    """fp and its distances to n pivots, eight to a column of type long."""
    refs = pivots(n)
    for k in range(0, n, 8):
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long"), 8 * i) for i, r in enumerate(refs[k : k + 8])]
        total = parts[0]
        for p in parts[1:]:
            total = total.bitwiseOR(p)
        fps = fps.withColumn(f"d{k // 8}", total)
    return fps


def block_masks(blocks: int, whole: int) -> list[int]:
    """All choices of so many whole blocks, as masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(one, whole)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def within(a: str, b: str, limit: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limit


def may_be_similar(a: str, b: str) -> Column:
    """Not discarded: a small set has no fingerprint to be discarded by."""
    return F.coalesce(within(a, b, FAR), F.lit(True))


def with_heads(rows: DataFrame, central: bool = False) -> DataFrame:
    """Of rows (band, key, node, fp, …) those that share band and key with another, with a head of that key's members, its
    head_fp, and how many members share it.

    The head is the smallest node or, if central, the one that meets the most members in all of its keys: of many versions of
    a text it is one that most others are near.
    """
    first = F.min(F.struct("node", "fp"))
    if central:
        shared = saved(rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
        met = saved(rows.join(shared, ["band", "key"]), "met")
        meets = saved(met.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
        rows, first = met.join(meets, "node").select(rows.columns + ["meets"]), F.min_by(F.struct("node", "fp"), F.struct(-F.col("meets"), "node"))
    heads = rows.groupBy("band", "key").agg(first.alias("head"), F.count("*").alias("members")).filter("members > 1")
    heads = saved(heads.select("band", "key", F.col("head.node").alias("head"), F.col("head.fp").alias("head_fp"), "members"), "heads")
    return saved(rows.drop("meets").join(heads, ["band", "key"]), "with-heads")


def with_labels(met: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of with_heads with the group, by edges, of the node (label) and of the head (head_label)."""
    roots = groups(edges)
    named = met.join(roots.select("node", F.col("root").alias("label")), "node", "left")
    named = named.join(roots.select(F.col("node").alias("head"), F.col("root").alias("head_label")), "head", "left")
    return saved(named.withColumn("label", F.coalesce("label", "node")).withColumn("head_label", F.coalesce("head_label", "head")), "labelled")


def still_apart(named: DataFrame, limit: Column) -> DataFrame:
    """a, b: pairs that share a key, have different labels, and may be linked by what limit says of the sides a and b.

    named: rows of with_labels, with d, their distance to the head. Pairs with heads are left out.
    """
    apart = saved(named.filter("label <> head_label"), "apart")
    # Written, so that the pairs' join is one of two plain tables.
    members = saved(named.filter("node <> head").join(apart.select("band", "key").distinct(), ["band", "key"], "left_semi"), "members")
    own_key = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))
    once = (F.col("b.label") == F.col("b.head_label")) | (F.col("a.node") < F.col("b.node"))
    pairs = apart.alias("a").join(members.alias("b"), own_key & (F.col("a.label") != F.col("b.label")) & once & limit)
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def links(fps: DataFrame, count: int, near: int = NEAR) -> DataFrame:
    """a, b: pairs of distinct fingerprints fp with near or fewer differing bits, enough to join all that are linked."""
    whole = 2 if count < 1 << 25 else 3 if count < 1 << 31 else 4
    masks = block_masks(near + whole, whole)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    distances = [f"d{k}" for k in range(PIVOTS // 8)]
    rows = pivot_table(fps).withColumn("k", F.explode(keys)).select("k.band", "k.key", "fp", F.col("fp").alias("node"), *distances)
    met = with_heads(rows)
    first = saved(met.filter((F.col("node") != F.col("head")) & within("fp", "head_fp", near)).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "first-links")
    limit = F.abs(F.col("a.d") - F.col("b.d")) <= near
    for k in distances:
        for i in range(8):
            x, y = (F.shiftrightunsigned(F.col(f"{side}.{k}"), 8 * i).bitwiseAND(F.lit(255)) for side in "ab")
            limit &= F.abs(x - y) <= near
    limit &= within("a.fp", "b.fp", near)
    # Keys of two members are done, and so are those whose members all are their head's.
    open_ = saved(met.filter((F.col("members") > 2) & (F.col("node") != F.col("head")) & ~within("fp", "head_fp", near)).select("band", "key").distinct(), "open-keys")
    if open_.isEmpty():
        return first
    rows = met.join(open_, ["band", "key"], "left_semi").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("head_fp"))))
    return first.unionByName(still_apart(with_labels(rows, first), limit))


def groups(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge (a, b) is connected to."""
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    # Few links are written in few files: however many partitions shuffles have, each step would write one for each.
    parts = 1 + now.count() // LINKS_A_TASK
    while True:
        # Large star: every greater neighbour of u goes to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are written, so that the join is one of two plain tables, whose frequent keys Spark can split.
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large.coalesce(parts), "large-star")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = saved(small.coalesce(parts), "small-star")
        # Nothing changes any more where each node has one link, to a node that has none to a smaller one.
        if now.groupBy("u").count().filter("count > 1").isEmpty() and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp long, component_id: the smallest id of the documents linked, over any number of links."""
    marked = saved(docs.select(F.col(id_col), fingerprint(whole_text(text_col)).alias("fp")), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = groups(links(distinct.select("fp"), distinct.count()))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Both written: the rows of a large group, or of a frequent fingerprint, are those of a plain join, which Spark can split.
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    classes = saved(rooted.join(ids, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def words_of(hashes: np.ndarray) -> list[int]:
    """The longer fingerprint: BANDS words (as signed integers) of bits that over half of a set's hashes have."""
    ones = np.zeros(64 * BANDS, np.int64)
    for a in range(0, len(hashes), 255):  # sums of a byte each
        x = hashes[a : a + 255, None] * FACTORS[0]
        x ^= x >> np.uint64(32)
        x *= FACTORS[1]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.int64).tolist()


def signature(text: Column) -> Column:
    """struct<node long, fp long, keys array<long>>: a number for the set of shingles, its fingerprint if it is large, the words of its longer fingerprint."""

    @F.arrow_udf("struct<node: long, fp: long, keys: array<long>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for (batch,) in slices((b,) for b in batches):
            nodes, fps, keys = [], [], []
            for t in batch:
                own = np.unique(shingle_hashes(t.as_py() or "", SHINGLE))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                fps.append(bits_of(own) if len(own) >= LARGE else None)
                keys.append(words_of(own.astype(np.uint64)))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "fp", "keys"])

    return made(text)


def jaccard(a: str, b: str) -> Column:
    """Similarity of the shingle sets of two texts."""

    @F.arrow_udf("double")
    def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in slices(batches):
            sets: dict[str, np.ndarray] = {}
            out = []
            for pair in zip(*columns):
                x, y = (sets[t] if t in sets else sets.setdefault(t, np.unique(shingle_hashes(t, SHINGLE))) for t in (c.as_py() for c in pair))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
            yield pa.array(out, pa.float64())

    return similarity(F.col(a), F.col(b))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of pairs (a, b); texts: node, text."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = saved(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]), "compared-texts")
    sides = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return saved(sides.select("a", "b", jaccard("x", "y").alias("similarity")), "compared")


def shingle_set(text: Column) -> Column:
    """The hashes of the set of shingles, as longs."""

    @F.arrow_udf("array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (batch,) in slices((b,) for b in batches):
            sets = [np.unique(shingle_hashes(t.as_py() or "", SHINGLE)).astype(np.uint64).view(np.int64) for t in batch]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))

    return made(text)


def rare_shingles(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """node, n, shingle, place, start, after: of each text's n shingles, in the order of how few of the texts have them, those
    among which two texts of that similarity share one, with up to START of them as an array (after: how many places come later). Shingles of
    one text alone are counted in the places, but left out."""
    own = saved(texts.select("node", shingle_set(F.col("text")).alias("set")), "shingle-sets").select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    often = saved(own.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1"), "shared-shingles")
    shared = own.join(often, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("l"))
    lone = F.col("n") - F.size("l")
    length = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1 - lone).cast("int")
    kept = shared.select("node", "n", lone.alias("lone"), F.slice("l", F.lit(1), length).alias("l"))
    start = F.transform(F.slice("l", 1, START), lambda s: s["shingle"])
    first = kept.select("node", "n", "lone", start.alias("start"), F.posexplode("l").alias("k", "s"))
    return saved(first.select("node", "n", "s.shingle", (F.col("lone") + F.col("k") + 1).alias("place"), "start", (F.col("n") - F.col("lone") - F.size("start")).alias("after")), "rare-shingles")


def similar_apart(named: DataFrame, first: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """a, b: pairs of nodes with different labels that may have that similarity, one of them apart from a head of its keys.

    named: rows of with_labels; first: a, b, similarity of pairs with heads. All nodes in a key with one that is apart
    take part (a key of two members is done: its pair was one with a head). They meet on their rare shingles: of two sets of similarity t, the first shingle that both have, rare ones
    first, leaves at least t / (1 + t) of the sum of their sizes in either, itself included, so that no pair is lost.
    """
    rows = saved(named.select("node", "fp", "label", "band", "key", ((F.col("label") != F.col("head_label")) & (F.col("members") > 2)).alias("apart")), "apart")
    taking = rows.join(rows.filter("apart").select("band", "key").distinct(), ["band", "key"], "left_semi").select("node").distinct()
    facts = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("label").alias("label"), F.max("apart").alias("apart"))
    # One head that the node was held against is its pivot.
    pivot = first.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(F.col("a").alias("head"), "similarity")).alias("pivot"))
    facts = saved(facts.join(taking, "node", "left_semi").join(pivot, "node", "left").select("node", "fp", "label", "apart", "pivot.head", (1 - F.col("pivot.similarity")).alias("d")), "taking-part")
    rare = rare_shingles(texts.join(facts, "node", "left_semi").dropDuplicates(["node"]), similar)
    rare = saved(rare.join(facts, "node"), "meeting")
    least = F.ceil((F.col("a.n") + F.col("b.n")) * (similar / (1 + similar)) - 1e-9)
    enough = (F.col("a.n") - F.col("a.place") + 1 >= least) & (F.col("b.n") - F.col("b.place") + 1 >= least)
    once = ~F.col("b.apart") | (F.col("a.node") < F.col("b.node"))
    pivots_agree = F.coalesce((F.col("a.head") != F.col("b.head")) | (F.abs(F.col("a.d") - F.col("b.d")) <= 1 - similar + 1e-9), F.lit(True))
    # What both starts hold, and all that comes after the start that ends first, is the most that two sets can share.
    both = F.array_intersect("a.start", "b.start")
    at_first = (F.size(both) == 0) | (F.get(both, F.lit(0)) == F.col("a.shingle"))
    starts_agree = F.size(both) + F.greatest("a.after", "b.after") >= least
    limit = enough & once & (F.col("a.label") != F.col("b.label")) & may_be_similar("a.fp", "b.fp") & pivots_agree & starts_agree & at_first
    pairs = rare.filter("apart").alias("a").join(rare.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & limit)
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def far(bits: int, small: Column) -> Column:
    """So many of the bits differ at most: five deviations more than the mean."""
    most, most_small = (int(bits * p + 5 * (bits * p * (1 - p)) ** 0.5) for p in (DIFFER, DIFFER_SMALL))
    return F.when(small, most_small).otherwise(most)


def block_rows(nodes: DataFrame) -> DataFrame:
    """The columns of nodes (fp, keys, …) but these, and key, a long for each block of the words keys: its place, and its bits."""
    word = nodes.select("*", F.posexplode("keys").alias("band", "word"))

    def keys(bits: int, kind: int) -> list[Column]:
        part = [F.shiftrightunsigned("word", 16 * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(BLOCKS)]
        return [F.shiftleft((F.col("band") * BLOCKS + i).cast("long") * 2 + kind, BITS).bitwiseOR(part[i]) for i in range(BLOCKS)]

    blocks = F.when(F.col("fp").isNull(), F.array(*keys(BITS, 0), *keys(FEW_BITS, 1))).otherwise(F.array(*keys(BITS, 0)))
    return word.select("*", F.explode(blocks).alias("key")).drop("fp", "keys", "band", "word")


def nearest_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes of equal fingerprints, and of fingerprints that links joins."""
    named = saved(nodes.filter("fp is not null").groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-nodes")
    same = nodes.join(named, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = saved(links(named.select("fp"), named.count()), "nearest-links")
    side = {c: named.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in "ab"}
    near = found.join(side["a"], "a").join(side["b"], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.unionByName(near)


def meeting_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fp, band, key: the nodes' blocks that are whole in a node of another group, by edges, too, from which neither pivot
    table nor bits tell this one apart. However many such nodes there are, a block is one row."""
    labels = groups(edges).select("node", F.col("root").alias("label"))
    facts = nodes.join(labels, "node", "left").select("node", "keys", F.coalesce("label", "node").alias("label"), F.col("fp").isNull().alias("small"), F.col("fp").alias("own"), F.get("keys", F.lit(0)).alias("fp"), F.get("keys", F.lit(1)).alias("more"))
    facts = saved(pivot_table(facts, 8).withColumnsRenamed({"fp": "bits", "own": "fp"}), "pivot-table")
    rows = block_rows(facts)
    small = F.col("a.small") & F.col("b.small")
    # Both sides need the same columns, so that one shuffle serves both.
    limit = (F.col("a.node") != F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    limit &= F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) + F.bit_count(F.col("a.more").bitwiseXOR(F.col("b.more"))) <= far(128, small)
    for i in range(8):
        x, y = (F.shiftrightunsigned(f"{side}.d0", 8 * i).bitwiseAND(F.lit(255)) for side in "ab")
        limit &= F.abs(x - y) <= far(64, small)
    met = rows.alias("a").join(rows.alias("b"), (F.col("a.key") == F.col("b.key")) & limit, "left_semi").select("node", "key")
    return saved(met.join(nodes.select("node", "fp"), "node").select("node", "fp", F.lit(0).alias("band"), "key"), "meeting-rows")


def bits_agree(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that may be similar by all bits of the longer fingerprints."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("keys").alias(f"{c}_keys"), F.col("fp").isNull().alias(f"{c}_small")) for c in "ab")
    differ = F.aggregate(F.zip_with("a_keys", "b_keys", lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda v, w: v + w)
    return pairs.join(x, "a").join(y, "b").filter(differ <= far(64 * BANDS, F.col("a_small") & F.col("b_small"))).select("a", "b")


def similar_links(nodes: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b: pairs of nodes (node, fp, keys) of that similarity or more, enough to join all that are linked; texts: node, text."""
    near = compared(saved(nearest_pairs(nodes), "nearest-pairs"), texts)
    linked = near.filter(F.col("similarity") >= similar).select("a", "b")
    met = with_heads(meeting_rows(nodes, linked), central=True)
    # One head for each node joins nearly all of a large group; other heads are looked at where the group is still another.
    near_head = met.filter((F.col("node") != F.col("head")) & may_be_similar("fp", "head_fp"))
    one = compared(saved(near_head.groupBy(F.col("node").alias("b")).agg(F.mode("head", True).alias("a")), "pairs-with-a-head"), texts)
    linked = linked.unionByName(one.filter(F.col("similarity") >= similar).select("a", "b"))
    other = with_labels(met, linked).filter((F.col("label") != F.col("head_label")) & may_be_similar("fp", "head_fp")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    other = saved(other.join(one.select("a", "b"), ["a", "b"], "left_anti"), "other-heads")
    rest = compared(saved(bits_agree(other, nodes), "pairs-with-heads"), texts)
    linked = linked.unionByName(rest.filter(F.col("similarity") >= similar).select("a", "b"))
    last = compared(saved(similar_apart(with_labels(met, linked), one.unionByName(rest), texts, similar), "pairs-apart"), texts)
    return linked.unionByName(last.filter(F.col("similarity") >= similar).select("a", "b"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each group of similar texts: the one with the smallest id, an id before none, then by the text's hash."""
    digest, gone_id, gone_digest = (free_name(docs, n) for n in ("text_digest", "gone_id", "gone_digest"))
    text = whole_text(text_col)
    keyed = docs.withColumn(digest, F.xxhash64(text))
    rows = keyed.select(F.col(id_col).alias("id"), F.col(digest).alias("digest"), signature(text).alias("s"))
    marked = saved(rows.select("id", "digest", "s.node", "s.fp", "s.keys"), "signatures")
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("digest").alias("digest"))
    nodes = saved(marked.groupBy("node").agg(F.min(row).alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    heads = nodes.select("node", F.col("least.id").alias(gone_id), F.col("least.digest").alias(gone_digest))
    same_row = keyed[id_col].eqNullSafe(F.col(gone_id)) & (keyed[digest] == F.col(gone_digest))
    found = similar_links(nodes.select("node", "fp", "keys"), keyed.select(id_col, digest, text.alias("whole_text")).join(heads, same_row).select("node", F.col("whole_text").alias("text")), similar)
    roots = groups(found)
    rooted = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    stays = saved(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.digest"), "staying")
    same = marked["id"].eqNullSafe(stays["id"]) & (marked["digest"] == stays["digest"])
    gone = saved(marked.join(stays, same, "left_anti").select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct(), "gone")
    kept = keyed.join(gone, same_row, "left_anti")
    # Rows of one id and one text are told apart by nothing; where there are any, one of them is taken.
    again = saved(marked.groupBy("id", "digest").count().filter("count > 1").select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest)), "repeated")
    if not again.isEmpty():
        kept = kept.join(again, same_row, "left_anti").unionByName(kept.join(again, same_row, "left_semi").dropDuplicates([id_col, digest]))
    return kept.select(docs.columns)
