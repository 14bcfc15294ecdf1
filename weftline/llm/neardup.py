"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: a document's shingles are hashed into ``bins`` bins over up to twice as many rounds.  In the first ``bins``
rounds every shingle chooses a bin; in round ``bins + b`` every shingle goes to bin b.  A bin keeps the smallest
(round, hash), and a document stops when its bins are full, so every bin fills for any set, most documents need one or
two rounds, and the share of equal bins of two sketches is close to the Jaccard similarity of the sets.

Candidates: ``bins / rows`` bands of ``rows`` equal bins.  With 128 bins and bands of 4, a pair at similarity 0.8
shares none with probability (1 - 0.8^4)^32 < 10^-7.  Equal sets are merged before (by a 128-bit hash), so a band holds
different texts only.

Links: every member of a band is compared with the band's smallest id on full shingle sets, which is linear in the
number of members.  That gives components.  What could still be missing are links between members of different
components, so bands that hold several are looked at again: members outside of the band's largest component are
compared with members of other components, first by sketch and then by hashed sets, each pair only in the first band
that it shares.  A found link joins two components at once, and pairs inside one component need no look, as they
can't change the result: a band gives fewer links than it has members, never its pairs.  These links are confirmed on
full sets as well.  A large band is cut into blocks of members, and only the members outside of the largest component
are copied to each, so no group is gathered and no component is paired with itself.

Crowded bands: where more members than a block holds are outside of the largest component (many documents with one long
passage in common), copies would grow with the square.  The documents of such bands meet by rare shingles instead: with
the shingles of all of them in one order, the rarest first, two sets at the threshold have a shingle in common among the
first (100 - percent) % of each, plus one.  This is exact, and a passage that all of them hold comes last, so most
documents meet nobody.  A shingle that still has more such members than a block is cut into pairs of tiles.

Cases: null or empty text has no shingles, is linked with nothing and kept; rows with equal ids count as one document
(their links join, and they are kept or dropped together); a null id is linked with nothing, has a null component and
is kept; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, U64, _BASE, Words, grams, map_arrow, mix, pieces, texts, within, words, written
from weftline.llm.components import components

BINS = 128
ROWS = 4
BLOCK = 2000
#: Equal bins below which no pair of similarity 0.8 is expected (mean 102, five standard deviations below).
LEAST_EQUAL = 79
SKETCH = "doc_id long, n_shingles long, set_hi long, set_lo long, bins binary, bands array<long>"


def shingles(found: Words, n: int) -> np.ndarray:
    """Sorted (document << 52 | hash) of the distinct shingles of each document."""
    docs = len(found.first) - 1
    counts = np.diff(found.first)
    total = len(found.code)
    keys = [np.zeros(0, U64)]
    ok = within(found.first, n, total)
    if len(ok):
        doc = found.doc[: len(ok)]
        keys.append((doc[ok].astype(U64) << U64(52)) | (grams(found.code, n)[ok] >> U64(12)))
    for k in range(1, n):  # shorter documents: the whole sequence
        short = np.flatnonzero(counts == k)
        if len(short):
            with np.errstate(over="ignore"):
                value = np.full(len(short), k, U64)
                for m in range(k):
                    value = value * U64(_BASE) + found.code[found.first[short] + m]
            keys.append((short.astype(U64) << U64(52)) | (mix(value) >> U64(12)))
    assert docs < 4096
    keys = np.concatenate(keys)
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def sketches(keys: np.ndarray, docs: int, bins: int = BINS) -> np.ndarray:
    """(docs, bins) matrix of the smallest (round, hash) in each bin; documents without shingles stay at the maximum."""
    empty = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(docs * bins, empty, U64)
    doc, value = (keys >> U64(52)).astype(np.int64), keys & U64((1 << 52) - 1)
    full = np.zeros(docs, bool)
    for turn in range(2 * bins):
        if not len(value):
            break
        with np.errstate(over="ignore"):
            h = mix(value + U64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        place = (h & U64(bins - 1)).astype(np.int64) if turn < bins else turn - bins
        rank = (U64(turn) << U64(48)) | (h >> U64(16))
        np.minimum.at(out, doc * bins + place, rank)
        full = (out.reshape(docs, bins) != empty).all(axis=1)
        more = ~full[doc]
        doc, value = doc[more], value[more]
    return out.reshape(docs, bins)


def _sketch_batch(n: int):
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = texts(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in pieces(offsets):
            found = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LOWER)
            keys = shingles(found, n)
            docs = j - i
            first = np.searchsorted(keys, np.arange(docs + 1, dtype=U64) << U64(52))
            counts = np.diff(first)
            matrix = sketches(keys, docs)
            value = keys & U64((1 << 52) - 1)
            with np.errstate(over="ignore"):
                sums = [np.concatenate(([U64(0)], np.cumsum(mix(value + U64(s))))) for s in (1, 2)]
                hi, lo = ((s[first[1:]] - s[first[:-1]]).astype(np.int64) for s in sums)
                joined = np.zeros((docs, BINS // ROWS), U64)
                for r in range(ROWS):
                    joined = joined * U64(_BASE) + matrix[:, r::ROWS]
                joined = mix(joined + np.arange(BINS // ROWS, dtype=U64) * U64(0xD1342543DE82EF95))
            small = (mix(matrix) & U64(0xFFFFFFFF)).astype(np.uint32)
            some = counts > 0
            yield {
                "doc_id": ids.slice(i, docs),
                "n_shingles": pa.array(counts.astype(np.int64)),
                "set_hi": pa.array(hi),
                "set_lo": pa.array(lo),
                "bins": pa.array([small[d].tobytes() if some[d] else None for d in range(docs)], pa.binary()),
                "bands": pa.ListArray.from_arrays(
                    pa.array(np.arange(docs + 1) * (BINS // ROWS), pa.int32()), pa.array(joined.astype(np.int64).ravel())
                ),
            }

    return work


def sketch(docs: DataFrame, *, n: int = 4) -> DataFrame:
    """Size of the shingle set, its 128-bit hash, a compact sketch and the band keys of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, _sketch_batch(n), SKETCH)


def similar(n: int, percent: int):
    """Arrow step: keeps the pairs (a, b) whose texts' shingle sets have 100 * common >= percent * union."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        left, lo = texts(batch.column("text_a"))
        right, ro = texts(batch.column("text_b"))
        good = np.zeros(batch.num_rows, bool)
        for i, j in pieces(lo + ro):
            x = shingles(words(left[lo[i] : lo[j]], lo[i : j + 1] - lo[i], LOWER), n)
            y = shingles(words(right[ro[i] : ro[j]], ro[i : j + 1] - ro[i], LOWER), n)
            both = np.concatenate((x, y))
            both.sort()
            same = both[1:][both[1:] == both[:-1]]
            edges = np.arange(j - i + 1, dtype=U64) << U64(52)
            size = np.diff(np.searchsorted(both, edges))
            common = np.diff(np.searchsorted(same, edges))
            good[i:j] = (common > 0) & (100 * common >= percent * (size - common))
        keep = pa.array(good)
        yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return work


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that have a pair, written.

    The ids grow with the documents, so the join is a sort-merge one at every size, not a broadcast on small inputs.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(named.join(ids.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi"), "near-texts")


def verify(pairs: DataFrame, own: DataFrame, *, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets; both joins are plain, so a document with very many pairs is split."""
    one = own.select(F.col("doc_id").alias("ida"), F.col("text").alias("text_a"))
    two = own.select(F.col("doc_id").alias("idb"), F.col("text").alias("text_b"))
    both = pairs.join(two, F.col("b") == F.col("idb")).join(one, F.col("a") == F.col("ida"))
    return map_arrow(both.select("a", "b", "text_a", "text_b"), similar(n, percent), "a long, b long").distinct()


def _hashed_sets(n: int):
    """Arrow step: 32-bit hashes of each document's shingles, ascending."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = texts(batch.column("text"))
        for i, j in pieces(offsets):
            keys = shingles(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LOWER), n)
            first = np.searchsorted(keys, np.arange(j - i + 1, dtype=U64) << U64(52))
            small = ((keys >> U64(20)) & U64(0xFFFFFFFF)).astype(np.uint32)
            sets = [small[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield {"d": batch.column("doc_id").slice(i, j - i), "hashes": pa.array(sets, pa.binary())}

    return work


def across(percent: int):
    """Group step: links between different components in one block of a band, fewer than its members."""

    def work(key: tuple, members: pa.Table) -> pa.Table:
        block, band = key[1].as_py(), members.column("band")[0].as_py()
        doc = members.column("doc").to_numpy()
        stray = members.column("stray").to_numpy(zero_copy_only=False).astype(bool)
        _, comp = np.unique(members.column("comp").to_numpy(), return_inverse=True)
        bins = np.frombuffer(b"".join(members.column("bins").to_pylist()), np.uint32).reshape(len(doc), BINS)
        sets = [np.frombuffer(x, np.uint32) for x in members.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets])
        found = []
        for s in np.flatnonzero(stray):
            other = np.flatnonzero((comp != comp[s]) & ((block == 0) & (doc > doc[s]) | ~stray))
            equal = bins[other] == bins[s]
            near = equal.sum(axis=1) >= LEAST_EQUAL
            with_ = other[near]
            if band >= 0:  # a pair that meets by a shingle is not held to its first band
                with_ = with_[equal[near].reshape(-1, BINS // ROWS, ROWS).all(axis=2).argmax(axis=1) == band]
            if not len(with_):
                continue
            joined = np.concatenate([sets[k] for k in with_])
            at = np.minimum(np.searchsorted(sets[s], joined), size[s] - 1)
            same = np.add.reduceat(sets[s][at] == joined, np.concatenate(([0], np.cumsum(size[with_])[:-1])))
            linked = with_[100 * same >= percent * (size[with_] + size[s] - same)]
            for k in linked:
                if comp[k] != comp[s]:
                    found.append((min(doc[s], doc[k]), max(doc[s], doc[k])))
                    comp[comp == comp[k]] = comp[s]
        a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return work


def _shingle_lists(n: int):
    """Arrow step: each document's distinct shingles."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = texts(batch.column("text"))
        for i, j in pieces(offsets):
            keys = shingles(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LOWER), n)
            first = np.searchsorted(keys, np.arange(j - i + 1, dtype=U64) << U64(52))
            values = (keys & U64((1 << 52) - 1)).astype(np.int64)
            yield {"d": batch.column("doc_id").slice(i, j - i), "list": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))}

    return work


def rare_shingles(crowd: DataFrame, own: DataFrame, *, n: int, percent: int) -> DataFrame:
    """Shingles by which the documents of ``crowd`` (doc, comp) must meet if they are links: key, band (-1), doc, comp."""
    wanted = own.join(crowd.select("doc").hint("merge"), F.col("doc_id") == F.col("doc"), "left_semi").dropDuplicates(["doc_id"])
    lists = written(map_arrow(wanted, _shingle_lists(n), "d long, list array<long>"), "near-shingles")
    each = lists.select("d", F.size("list").alias("size"), F.explode("list").alias("key"))
    shared = each.groupBy(F.col("key").alias("s")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = each.join(written(shared, "near-shared").hint("merge"), F.col("key") == F.col("s"))
    doc = Window.partitionBy("d")
    known = known.withColumn("at", F.row_number().over(doc.orderBy("n", "s"))).withColumn("some", F.count(F.lit(1)).over(doc))
    # shingles of one document only come before all others
    first = known.filter(F.expr(f"at + size - some <= {100 - percent} * size div 100 + 1"))
    return first.join(crowd.hint("merge"), F.col("d") == F.col("doc")).select("key", F.lit(-1).alias("band"), "doc", "comp")


def mixed_groups(labelled: DataFrame) -> DataFrame:
    """Groups (``labelled``: key, doc, comp) of several components: k, size, strays, the largest component ``main``, and a
    print of the members."""
    parts = labelled.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")
    )
    groups = parts.groupBy(F.col("key").alias("k")).agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("size"),
        (F.sum("n") - F.max("n")).alias("strays"),
        F.max_by("comp", F.struct("n", "comp")).alias("main"),
        F.bit_xor("x").alias("x"),
        F.bit_xor("y").alias("y"),
    )
    return groups.filter("parts > 1").drop("parts")


def placed(labelled: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of the groups in ``mixed``, copied so that strays meet all other members in groups (key, block, tile).

    Up to a block of strays: members of the main component in blocks, and the strays in each of them.  Beyond that strays
    are cut into tiles too, and two tiles, or a tile and a block, meet at a time: of two tiles the later one stands for
    members (not stray), a tile meets itself in block 0.  No group has more than about two blocks of rows.
    """
    inside = labelled.join(mixed, F.col("key") == F.col("k"))
    inside = inside.withColumn("stray", F.col("comp") != F.col("main"))
    own = F.xxhash64("doc")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    tiles = F.ceil(F.col("strays") / BLOCK).cast("int")
    mains = F.ceil((F.col("size") - F.col("strays")) / BLOCK).cast("int")

    def at(tile, block, stray):
        return F.struct(tile.cast("int").alias("tile"), block.cast("int").alias("block"), stray.alias("stray"))

    def against(other):
        mine = F.pmod(own, tiles).cast("int")
        later = at(mine, other, F.lit(True))
        return F.when(other < mine, at(other, mine, F.lit(False))).when(other == mine, at(mine, F.lit(0), F.lit(True))).otherwise(later)

    few = F.when(F.col("stray"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: at(F.lit(0), b, F.lit(True)))).otherwise(
        F.array(at(F.lit(0), F.pmod(own, blocks), F.lit(False)))
    )
    many = F.when(F.col("stray"), F.transform(F.sequence(F.lit(0), tiles + mains - 1), against)).otherwise(
        F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: at(t, tiles + F.pmod(own, mains), F.lit(False)))
    )
    inside = inside.select("key", "band", "doc", "comp", F.explode(F.when(F.col("strays") <= BLOCK, few).otherwise(many)).alias("at"))
    return inside.select("key", "band", "doc", "comp", "at.stray", "at.block", "at.tile")


def cross_links(bands: DataFrame, comps: DataFrame, reps: DataFrame, own: DataFrame, *, n: int, percent: int) -> DataFrame:
    """Links (a, b) between different components of a band (``bands``: key, band, doc)."""
    named = comps.select(F.col("node").alias("n"), "component")
    labelled = bands.join(named, F.col("doc") == F.col("n"), "left")
    labelled = labelled.select("key", "band", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed = written(mixed_groups(labelled).drop("x", "y"), "near-mixed")
    inside = placed(labelled, mixed.filter(F.col("strays") <= BLOCK))
    crowded = mixed.filter(F.col("strays") > BLOCK).select("k")
    if not crowded.isEmpty():
        crowd = written(labelled.join(crowded, F.col("key") == F.col("k"), "left_semi").select("doc", "comp").distinct(), "near-crowd")
        rare = written(rare_shingles(crowd, own, n=n, percent=percent), "near-rare")
        # shingles of one passage have the same members; one of them is enough
        some = written(mixed_groups(rare).dropDuplicates(["x", "y", "size"]), "near-mixed")
        inside = inside.union(placed(rare, some))
    inside = written(inside, "near-inside")
    wanted = own.join(inside.select("doc").distinct(), F.col("doc_id") == F.col("doc"), "left_semi").dropDuplicates(["doc_id"])
    sets = map_arrow(wanted, _hashed_sets(n), "d long, hashes binary")
    bins = reps.select(F.col("doc_id").alias("r"), "bins").dropDuplicates(["r"])
    known = written(sets.join(bins, F.col("d") == F.col("r")).select("d", "bins", "hashes"), "near-known")
    members = inside.join(known.hint("merge"), F.col("doc") == F.col("d")).drop("d")
    return members.groupBy("key", "block", "tile", "band").applyInArrow(across(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, n: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    sketched = written(sketch(docs, n=n), "near-sketches")
    sets = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hi", "set_lo", "n_shingles")
    many = sets.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = written(many.select(F.col("set_hi").alias("h"), F.col("set_lo").alias("l"), F.col("n_shingles").alias("s"), "rep"), "near-sets")
    same = (F.col("set_hi") == F.col("h")) & (F.col("set_lo") == F.col("l")) & (F.col("n_shingles") == F.col("s"))
    joined = sketched.join(many, same, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = joined.filter("n_shingles > 0 AND rep = doc_id")
    narrow = reps.select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "key"))
    lead = narrow.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).filter("last > lead")
    lead = written(lead.select(F.col("key").alias("k"), "lead"), "near-leads")
    bands = written(narrow.join(lead.hint("merge"), F.col("key") == F.col("k")).select("key", "band", "doc", "lead"), "near-bands")
    pairs = written(bands.filter("doc > lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct(), "near-pairs")
    own = texts_of(docs, pairs)
    links = written(verify(pairs, own, n=n, percent=percent), "near-links")
    more = written(cross_links(bands, components(links), reps, own, n=n, percent=percent), "near-cross")
    more = written(verify(more, own, n=n, percent=percent), "near-links")
    # rows with equal ids and different sets link those sets
    own = joined.filter("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    shared = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = own.join(shared.select(F.col("doc_id").alias("i")), F.col("b") == F.col("i"), "left_semi")
    final = components(links.union(more).union(repeated)).select("node", "component")
    out = joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    named = final.withColumnRenamed("node", "rn")
    out = out.join(named, F.col("rep") == F.col("rn"), "left")
    component = F.coalesce("component", "rep")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, n: int = 4, percent: int = 80) -> DataFrame:
    """The documents of which one of each component stays, with all their columns."""
    gone = written(near_duplicates(docs, n=n, percent=percent).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
