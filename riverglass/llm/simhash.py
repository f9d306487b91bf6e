"""Operator 7: SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by their rank in Gray order, where neighbours share leading bit patterns, and cut
into leaf groups. A node keeps the bits on which all fingerprints below it agree, and upper nodes factor the bits that
their children share. A self-join walks the index from the root with pairs of nodes, level by level: the differences
on the bits that both nodes share are a lower bound for every pair below them, so whole groups are pruned. Pairs of
leaf groups that remain are compared with whole fingerprints. Groups count fingerprints, not documents, so copies of
one text cost nothing, and they are cut by position in the order, so a crowded region just has more groups.

Defined cases: null and empty texts have no words and fingerprint zero; a null ``doc_id`` never names a component unless all of its
ids are null; repeated rows get the same row each; very long texts are shingled whole; an empty table gives an empty one; only ``doc_id`` and ``text`` are read.

The pipeline's stage, ``keep_one_similar``, links documents whose sets of word shingles have a Jaccard similarity of
``least`` or more. The index gives its first links: fingerprints at three or fewer differing bits, verified on the sets.
No radius of fingerprints holds all such pairs (at similarity 0.8 they are ten bits apart on average, up to 17), so
pairs that it left apart come from a prefix filter, which is exact: in any common order of the shingles, two such sets share one
of the first n - ceil(least n) + 1, n being a set's size. Shingles that are frequent over all documents come last in that order.
Sets that share a shingle are not paired with each other: members of the group's largest component are known to be
linked, so only the rest meets the group, in blocks, and only pairs whose sizes, places, parity bits and number of shared
shingles allow the similarity are verified, on 48-bit hashes. Of a large group neighbours in Gray order are verified first.

Very long texts are taken whole. Column names of the table may be anything; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, discard, fresh, running_totals, store


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, in order; a shorter text is one run, one without words none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: bit i is set if it is set in over half of the XXH64 hashes of the text's word shingles."""
    hashes = shingle_hashes(text, words, seed)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 64):
        part = hashes[at : at + 255 * 64]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a long with the same bits."""

    def run(batch):
        fps = np.fromiter((fingerprint(t, words) for t in batch["text"]), np.uint64, len(batch["text"]))
        return {"doc_id": batch["doc_id"], "fp": fps.view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", run)


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, shifted so that signed order is the order of the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _node(value: str = "value", ones: str = "ones") -> list[Column]:
    return [F.bit_and(value).alias("value"), F.bit_or(ones).alias("ones")]


def hamming_links(fps: DataFrame, most: int = 2, leaf: int = 256, fan: int = 16) -> DataFrame:
    """Edges (u, v) that connect any two of the distinct ``fps.fp`` at ``most`` or fewer differing bits.

    The edges span the same components as all such pairs: a pair of leaf groups yields a spanning forest of its links.
    """
    one = fps.select("fp", gray_rank(F.col("fp")).alias("rank"), F.lit(1).cast("long").alias("one_"))
    placed = running_totals(one, [], ["rank"], "one_", "at", "gray")
    leaves = store(placed.groupBy(F.floor(F.col("at") / leaf).alias("id")).agg(*_node("fp", "fp"), F.collect_list("fp").alias("fps")), "leaves")
    levels = [leaves.select("id", "value", "ones")]
    n = levels[0].count()
    while n > 1:
        levels.append(store(levels[-1].groupBy(F.floor(F.col("id") / fan).alias("id")).agg(*_node()), "nodes"))
        n = -(-n // fan)
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for nodes in levels[-2::-1]:
        side = lambda s: nodes.select(F.floor(F.col("id") / fan).alias(s), F.col("id").alias(f"{s}_id"), F.col("value").alias(f"{s}_value"), F.bitwise_not(F.col("value").bitwiseXOR(F.col("ones"))).alias(f"{s}_mask"))  # noqa: B023, E731
        both = F.col("a_value").bitwiseXOR(F.col("b_value")).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask"))
        down = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a_id") <= F.col("b_id")) & (F.bit_count(both) <= most))
        pairs = store(down.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "pairs")
    members = leaves.select("id", "fps")
    joined = pairs.join(members.toDF("a", "a_fps"), "a").join(members.toDF("b", "b_fps"), "b").select("a_fps", "b_fps")
    return arrow_map(joined, "u long, v long", lambda batch: _leaf_links(batch, most))


def _leaf_links(batch: dict[str, list], most: int) -> dict[str, list]:
    us, vs = [], []
    for a, b in zip(batch["a_fps"], batch["b_fps"], strict=True):
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= most
        i, j = np.nonzero(near)
        apart = a[i] != b[j]
        i, j = a[i[apart]].tolist(), b[j[apart]].tolist()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:  # noqa: B023
                root[x] = x = root.setdefault(up, up)  # noqa: B023
            return x

        for x, y in zip(i, j, strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                us.append(x)
                vs.append(y)
    return {"u": us, "v": vs}


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    prints = store(fingerprints(docs, words), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(hamming_links(distinct, most))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store(linked.join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_FEW = 1 << 20  # names of sets up to which they are broadcast (16 MB), so that no other set moves
_LATE = 1 << 17  # frequent shingles that are broadcast (1 MB)
_BLOCK = 256  # members of a group that meet its others at a time
_BITS = 1 << 14  # parity bits of the largest sets (2 KB)


def _prefix(size: int, least: float) -> int:
    return size - math.ceil(least * size - 1e-9) + 1 if size else 0


def _set_print(hashes: np.ndarray) -> int:
    """Fingerprint of a set of shingles."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _packed(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes: sets are kept in six bytes a shingle."""
    return np.unique(hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.int64)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Bits, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as bits.

    There are at least as many bits as shingles (a power of 2, from 256 to ``_BITS``), or sets that have little in common would fill them all.
    """
    width = min(max(256, 1 << (len(hashes) - 1).bit_length()), _BITS)
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool), bitorder="little").view(np.int64)


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which the parities of two sets differ; the longer one is folded, once, as sizes of similar sets differ by a quarter at most."""
    half = lambda p: (F.size(p) / 2).cast("int")
    xor = lambda p, q: F.zip_with(p, q, lambda x, y: x.bitwiseXOR(y))
    fold = lambda p: xor(F.slice(p, F.lit(1), half(p)), F.slice(p, half(p) + 1, half(p)))
    both = F.when(F.size(a) > F.size(b), xor(fold(a), b)).when(F.size(a) < F.size(b), xor(a, fold(b))).otherwise(xor(a, b))
    return F.aggregate(both, F.lit(0), lambda n, x: n + F.bit_count(x))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(row, u1, u2, doc, id, size, fp, parity, hashes): every row's set of shingles; id names the set, u1 and u2 the row's content."""

    def run(batch):
        out = {**{n: batch[n] for n in ("u1", "u2", "doc")}, "id": [], "size": [], "fp": [], "parity": [], "hashes": []}
        for text in batch["text"]:
            got = np.unique(shingle_hashes(text, words))
            out["id"].append(xxhash.xxh3_64_intdigest(got.tobytes()) - 2**63)
            out["hashes"].append(_packed(got))
            out["size"].append(len(out["hashes"][-1]) // 6)
            out["fp"].append(_set_print(got))
            out["parity"].append(_parity(got))
        return out

    rows = docs.select(*_row_key(), F.col("doc_id").cast("long").alias("doc"), "text")
    sets = arrow_map(rows, "u1 long, u2 long, doc long, id long, size int, fp long, parity array<long>, hashes binary", run)
    return store(sets.select(F.monotonically_increasing_id().alias("row"), "*"), "shingles")


def _row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("u1"), F.xxhash64("text", F.lit("row"), "doc_id").alias("u2")]


def _frequent(sets: DataFrame, most: int = _LATE, room: int = 1 << 20) -> np.ndarray:
    """The shingles found in most sets, counted over all of them; a task forgets those that are alone among ``room`` of its hashes.

    They go last in the order of shingles. That order decides how many pairs are looked at, never which are found.
    """

    def run(batches):
        held, n = [], 0

        def flush():
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            on = counts > 1
            return pa.RecordBatch.from_pydict({"hash": pa.array(names[on]), "n": pa.array(counts[on])})

        for batch in batches:
            for x in batch.column("hashes").to_pylist():
                held.append(_unpacked(x))
                n += len(held[-1])
                if n >= room:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counts = sets.select("hashes").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return np.array(sorted(r.hash for r in counts.orderBy(F.desc("n"), "hash").limit(most).collect()), np.int64)


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(hash, copies, id, size, place) of the shingles in each set's prefix that other sets' prefixes hold too.

    Shingles that the same sets hold are one group, named after the least of them; ``copies`` is their number. So two long texts
    that have hundreds of them in common meet once, not once for each.
    """
    late = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batch):
        out = {"id": batch["id"], "size": batch["size"], "hash": []}
        for x in batch["hashes"]:
            got = _unpacked(x)
            at = np.searchsorted(late.value, got).clip(max=max(len(late.value) - 1, 0))
            last = late.value[at] == got if len(late.value) else np.zeros(len(got), bool)
            out["hash"].append(got[np.argsort(last, kind="stable")[: _prefix(len(got), least)]])
        return out

    found = arrow_map(sets.select("id", "size", "hashes"), "id long, size int, hash array<long>", run)
    found = found.select("id", "size", F.posexplode("hash").alias("place", "hash"))  # made twice: a table of all prefixes would be larger than the texts' parquet
    shared = store(found.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("hash"), "shared")
    each = store(found.join(shared, "hash", "left_semi").distinct(), "groups")
    held = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(seed) for seed in ("m1", "m2")])
    names = store(held.groupBy("n", "m1", "m2").agg(F.min("hash").alias("hash"), F.count(F.lit(1)).alias("copies")).select("hash", "copies"), "names")
    merged = store(each.join(names, "hash").select("hash", "copies", "id", "size", "place"), "merged")
    discard(each, names, shared)
    return merged


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct candidates (a, b) whose sets reach ``least``: (u, v)."""
    pairs = store(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    named = store(sets.select("id", "row").join(ids, "id", "left_semi").groupBy("id").agg(F.min("row").alias("row")), "named")
    rows = F.broadcast(named.select("row")) if named.count() <= _FEW else named.select("row").hint("merge")
    wanted = store(sets.select("row", "id", "hashes").join(rows, "row").select("id", "hashes"), "sets")
    both = pairs.join(wanted.toDF("a", "a_set"), "a").join(wanted.toDF("b", "b_set"), "b").select("a", "b", "a_set", "b_set")

    def run(batch):
        out = {"u": [], "v": []}
        for a, b, x, y in zip(batch["a"], batch["b"], batch["a_set"], batch["b_set"], strict=True):
            x, y = _unpacked(x), _unpacked(y)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if shared >= least * (len(x) + len(y) - shared) - 1e-9:
                out["u"].append(a)
                out["v"].append(b)
        return out

    links = store(arrow_map(both, "u long, v long", run), "links")
    discard(pairs, named, wanted)
    return links


def _index_links(sets: DataFrame, most: int) -> DataFrame:
    """Candidates (a, b) by the Gray-order index: sets of one fingerprint, and of fingerprints at ``most`` or fewer differing bits."""
    prints = store(sets.select("id", "fp").distinct(), "prints")
    distinct = store(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    equal = prints.join(distinct, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    name = lambda c: distinct.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id"))
    near = hamming_links(distinct.select("fp"), most).join(name("u"), "u").join(name("v"), "v")
    return equal.union(near.select(F.least("u_id", "v_id"), F.greatest("u_id", "v_id"))).distinct()


def _neighbours(groups: DataFrame, sets: DataFrame, large: int, turns: int = 16) -> DataFrame:
    """Candidates (a, b) in groups of over ``large`` sets: neighbours in Gray order of their fingerprints, turned in several ways.

    A set takes part in its largest group only. Rows are range-partitioned, so a large group is spread over many tasks.
    """
    sizes = groups.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)
    home = groups.join(sizes, "hash").groupBy("id").agg(F.max_by("hash", F.struct("n", "hash")).alias("hash"))
    prints = sets.groupBy("id").agg(F.min("fp").alias("fp"))
    turned = F.array(*[F.shiftleft("fp", 64 // turns * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 64 // turns * i)) if i else F.col("fp") for i in range(turns)])
    rows = home.join(prints, "id").select("hash", "id", F.posexplode(turned).alias("turn", "fp")).select("hash", "turn", gray_rank(F.col("fp")).alias("rank"), "id")
    order = ["turn", "hash", "rank", "id"]

    def run(batches):
        last = np.zeros((3, 0), np.int64)
        for batch in batches:
            now = np.concatenate((last, [batch.column(n).to_numpy() for n in ("turn", "hash", "id")]), axis=1)
            same = (now[:2, 1:] == now[:2, :-1]).all(axis=0)
            a, b = now[2, :-1][same], now[2, 1:][same]
            last = now[:, -1:]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    dealt = store(rows, "orders").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _apart(groups: DataFrame, sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of different components that share enough of their prefixes to reach ``least``.

    In each group all that are outside its largest component, in blocks, meet all members, which are dealt over salts.
    A pair comes out only if sizes, places in the prefixes and parity bits leave it the similarity.
    """
    rows = groups.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = store(rows.select("hash", "copies", "id", "size", "place", "root"), "members")
    parts = rows.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("hash")
    main = parts.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), F.max("n").alias("most")).where("roots > 1")
    main = store(main.select("hash", "main", F.ceil((F.col("n") - F.col("most")) / _BLOCK).alias("blocks"), F.ceil(F.col("n") / (8 * _BLOCK)).alias("salts")), "mains")
    some = rows.join(main, "hash")
    bits = sets.select("id", "parity").join(some.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    rows = store(some.join(bits, "id"), "mixed")
    spread = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(c))
    own = rows.select("hash", "copies", "id", "size", "place", "root", "parity", spread("salts", "salt").alias("salt"))
    block = rows.where("root <> main").groupBy("hash", "salts", spread("blocks", "block").alias("block")).agg(F.collect_list(F.struct("id", "size", "place", "root", "parity")).alias("others"))
    block = block.select("hash", "others", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    met = own.join(block, ["hash", "salt"])

    def fits(x: Column) -> Column:
        small, large = F.least(x["size"], F.col("size")), F.greatest(x["size"], F.col("size"))
        reach = F.least(x["place"], F.col("place")) + F.least(x["size"] - x["place"], F.col("size") - F.col("place"))
        near = _bits_apart(x["parity"], F.col("parity")) <= (small + large) * ((1 - least) / (1 + least)) + 1e-6
        return (x["root"] != F.col("root")) & (small >= large * least - 1e-9) & (reach >= (small + large) * (least / (1 + least)) - 1e-6) & near

    pairs = met.select("id", "size", F.explode(F.filter("others", fits)).alias("x"), "hash", "copies")
    a = F.struct("id", "size")
    b = F.struct("x.id", "x.size")
    pairs = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "hash", "copies").distinct()  # two others of a group meet twice
    counted = pairs.groupBy("a", "b").agg(F.sum("copies").alias("shared"))
    # what lies behind a prefix: with it, sets as similar as asked for must be able to reach this many common shingles
    behind = lambda size: F.ceil(F.col(size) * least - 1e-9) - 1
    enough = F.col("shared") + F.greatest(behind("a.size"), behind("b.size")) >= (F.col("a.size") + F.col("b.size")) * (least / (1 + least)) - 1e-6
    return counted.where(enough).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def similar_links(sets: DataFrame, least: float, most: int = 3, large: int = 64) -> DataFrame:
    """Edges (u, v) between ids of similar sets; they span the same components as all similar pairs."""
    near = _verified(_index_links(sets, most), sets, least)
    groups = _prefixes(sets, least)
    near = near.union(_verified(_neighbours(groups, sets, large), sets, least))
    roots = store(connected_components(near), "roots")
    return near.union(_verified(_apart(groups, sets, roots, least), sets, least))


def keep_one_similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of similar documents: the one with the smallest doc_id, null last."""
    sets = shingle_sets(docs, words)
    roots = connected_components(similar_links(sets, least))
    named = sets.select("doc", "u1", "u2", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "u1", "u2")).alias("best")
    kept = store(named.groupBy(F.coalesce("root", "id").alias("root")).agg(best).select("best.u1", "best.u2"), "kept")
    discard(sets)
    u1, u2, k1, k2 = fresh(docs, "u1", "u2", "kept_u1", "kept_u2")
    rows = docs.withColumns(dict(zip((u1, u2), _row_key(), strict=True)))
    same = (F.col(u1) == F.col(k1)) & (F.col(u2) == F.col(k2))
    return rows.join(kept.toDF(k1, k2).hint("merge"), same, "left_semi").dropDuplicates([u1, u2]).select(*docs.columns)
