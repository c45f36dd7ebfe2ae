"""Near-duplicate documents: an exact Jaccard self-join of word n-gram sets through prefix trees.

1. Equal sets are one class, stood for by its smallest document.
2. n-grams have one global order. Two sets at the threshold share an n-gram among the first of
   each, so only documents that meet there can link. The order is that of the hashes, but n-grams
   that occur at the head of more than ``HOT`` documents stand at its end, by their number of
   documents. A document keeps a head somewhat longer than it needs, so that it still has its first
   n-grams when some prove hot; only documents made up mostly of hot ones are read as a whole.
3. The documents that meet in an n-gram are first compared with one of them. Where they prove to be
   one component already, nothing more is needed; only pairs across components are compared. The
   first n-grams of documents that meet the same component stand in one prefix tree, which is walked
   once for a block of documents at a time: what each of them shares with a path is counted once for
   all documents below it, and a pair comes out once with its count, not once per shared n-gram.
4. The candidates of a document, in blocks of bounded size, are stored in a prefix tree of their
   ordered n-grams. The document walks the tree once; overlap counted on a shared path serves all
   sets below it, and a subtree is left when what remains of it or of the document cannot reach
   the overlap that its smallest set needs.

n-grams are compared by 64-bit hashes; a chance collision inside a pair changes its overlap by
one and has a probability below 1e-12 for sets of a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import batches
from tidegauge.llm.components import connected
from tidegauge.session import cut_lineage

#: Documents with one n-gram at their head beyond which it moves to the end of the order. Changes the work, not the result.
HOT = 64
#: Bits, as a power of two, that mark the documents whose sets are needed (4 MB).
MARKS_LOG2 = 25
#: Sets in one prefix tree, about.
BLOCK = 128
#: Documents, and n-grams of theirs, in a block of documents whose first n-grams are compared, about.
FAMILY, WEIGHT = 256, 1 << 14
#: Bytes of text whose sets are made at a time.
SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def needed(n, m, percent: int):
    """Smallest overlap of sets of sizes n and m that reaches the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def lead(n: int, percent: int) -> int:
    """How many n-grams from the front of the order must be looked at for a set of size n."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-gram hashes of each text."""
    data, bounds = batches.raw(column)
    data = _LOWER[data]
    starts, ends = batches.runs(_INSIDE[data], bounds)
    words = batches.hashes(data, starts, ends)
    grams = batches.chained(words, k)
    first = np.searchsorted(starts, bounds).tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1].view(np.int64))
        elif b > a:
            yield batches.chained(words[a:b], b - a).view(np.int64)
        else:
            yield grams[:0].view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))


def parities(sets: list[np.ndarray]) -> pa.ListArray:
    """For each set, 256 bits: whether it holds an odd number of n-grams of each of 256 kinds.

    Bits that differ between two sets are n-grams that one of them lacks.
    """
    kind = [(batches.mixed(s.view(np.uint64)) >> np.uint64(56)).astype(np.int64) + 256 * i for i, s in enumerate(sets)]
    odd = np.bincount(np.concatenate(kind), minlength=256 * len(sets)) & 1
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * 4, pa.int32()), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))


def fingerprints(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: size of its set, two digests, its parities, and the first n-grams by hash order."""
    def run(parts):
        for part in batches.sliced(parts, "text", SLICE):
            sets = list(sets_of(part.column("text"), k))
            sizes = [len(s) for s in sets]
            digests = [[int(batches.mixed(s.view(np.uint64) ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for salt in (1, 1 << 33)]
            leads = [lead(len(s), percent) for s in sets]
            heads = [s[:n + n // 2 + 12] for s, n in zip(sets, leads, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(d, pa.int64()) for d in digests), parities(sets), _lists(heads)],
                                             ["doc_id", "n", "f1", "f2", "odd", "head"])

    return docs.select("doc_id", "text").mapInArrow(run, batches.schema_of(docs, ["doc_id"], "n long, f1 long, f2 long, odd array<long>, head array<long>"))


def _sets(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(doc, n, grams) of the chosen documents and a few others, written once.

    The chosen ids are marked in a bitmap of fixed size by their hash, which goes to all tasks, so
    that no text is shuffled. Documents that share a mark come along and meet no pair later; the
    more of them, the more is written, up to all sets.
    """
    marks = chosen.select(F.pmod(F.xxhash64("doc"), F.lit(1 << MARKS_LOG2)).alias("at"))
    words = marks.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << MARKS_LOG2 - 6, np.uint64)
    bitmap[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.asarray(part.column("at"))
            marked = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            for some in batches.sliced(iter([part.filter(pa.array(marked.astype(bool)))]), "text"):
                sets = list(sets_of(some.column("text"), k))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["doc", "n", "grams"])

    known = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARKS_LOG2)).alias("at"))
    return cut_lineage(known.mapInArrow(run, "doc long, n long, grams array<long>"))


def _met(posts: DataFrame) -> DataFrame:
    """n-grams posted by two documents or more, with the number of posts."""
    return cut_lineage(posts.groupBy("g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("c"))
                 .where("lo < hi").select("g", "c"))


def tree_links(block: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links of the probing sets of a block with its members, by a walk over the members' prefix tree."""
    bounds = np.concatenate([[0], np.cumsum(np.asarray(block.column("n")))])
    flat = np.asarray(block.column("grams").combine_chunks().flatten())
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))  # frequent n-grams first: long shared paths
    ranked = rank[inverse.ravel()]
    ids = block.column("id").to_pylist()
    rows = [np.sort(ranked[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    asks = block.column("probe").to_pylist()
    members = sorted((i for i, x in enumerate(asks) if not x), key=lambda i: rows[i].astype(">u4").tobytes())
    if not members:
        return []
    most, least = max(len(rows[i]) for i in members), min(len(rows[i]) for i in members)
    shared = [0]
    for i, j in zip(members[:-1], members[1:], strict=True):
        size = min(len(rows[i]), len(rows[j]))
        differ = np.flatnonzero(rows[i][:size] != rows[j][:size])
        shared.append(int(differ[0]) if len(differ) else size)
    out = []
    for probe in (i for i, x in enumerate(asks) if x):
        n = len(rows[probe])
        mask = np.zeros(len(values), bool)
        mask[rows[probe]] = True
        left = n - np.cumsum(mask)  # what remains of the probing set behind each n-gram
        floor = needed(n, least, percent)
        path, cut = np.zeros(1, np.int64), None  # overlap on the path so far; depth of the subtree left
        for depth, i in zip(shared, members, strict=True):
            if cut is not None and depth >= cut:
                continue
            tail = rows[i][depth:]
            overlap = path[depth] + np.cumsum(mask[tail])
            alive = overlap + np.minimum(most - depth - 1 - np.arange(len(tail)), left[tail]) >= floor
            path = np.concatenate([path[:depth + 1], overlap])
            cut = depth + int(np.argmin(alive)) + 1 if not alive.all() else None
            both = int(path[-1])
            if cut is None and ids[i] != ids[probe] and 100 * both >= percent * (n + len(rows[i]) - both):
                out.append((ids[probe], ids[i]))
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    counts = cut_lineage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")))
    tagged = cut_lineage(pairs.join(counts, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), cast(ceil(c / {BLOCK}) as bigint))").alias("block")))
    member = tagged.join(sets, F.col("b") == F.col("doc")).select("a", "block", F.col("b").alias("id"), "n", "grams", F.lit(False).alias("probe"))
    probe = (tagged.select("a", "block").distinct().join(sets, F.col("a") == F.col("doc"))
             .select("a", "block", F.col("a").alias("id"), "n", "grams", F.lit(True).alias("probe")))

    def run(block: pa.Table) -> pa.Table:
        found = tree_links(block, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return cut_lineage(member.union(probe).groupBy("a", "block").applyInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Words are what stands between blanks, A-Z lower-cased; a shorter text is one n-gram, a text
    without words (or null) has an empty set and links with nothing. Rows with a null doc_id come
    back with a null component. Rows that share a doc_id are compared each by its own set and
    linked as one. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = cut_lineage(fingerprints(docs, k, percent))
    names = cut_lineage(marks.select("doc_id", "n", "f1", "f2"))
    classes = cut_lineage(names.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    heads = cut_lineage(marks.join(classes.select("n", "f1", "f2", F.col("rep").alias("doc_id")), ["doc_id", "n", "f1", "f2"], "left_semi")
                  .select(F.col("doc_id").alias("doc"), "n", "odd", "head"))
    _discard(marks)
    posts = _posts(docs, heads, k, percent)
    grouped = cut_lineage(connected(_links(docs, heads, posts, k, percent)))
    named = (classes.join(grouped, F.col("rep") == F.col("node"), "left")
             .select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")))
    named = cut_lineage(named)
    return (names.join(named, ["n", "f1", "f2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def _discard(step: DataFrame) -> None:
    """Delete a written step that is read no more."""
    spark, files = step.sparkSession, step.inputFiles()
    if files:
        place = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _posts(docs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """(g, doc, n, pos): the first n-grams of each document in the global order, where two documents meet."""
    spread = heads.select("doc", "n", F.posexplode("head").alias("i", "g"))
    met = _met(spread)
    inside = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    shared = cut_lineage(spread.join(met, "g").withColumn("hot", F.col("c") > HOT)
                   .withColumn("before", F.sum(F.col("hot").cast("int")).over(inside)).drop("c"))
    lead_of = F.expr(f"n - cast(ceil({percent} * n / 100) as bigint) + 1")
    plain = shared.where(~F.col("hot")).withColumn("pos", (F.col("i") - F.col("before")).cast("long")).where(F.col("pos") < lead_of).select("g", "doc", "n", "pos")
    touched = shared.where("hot").groupBy("doc").agg(F.count(F.lit(1)).alias("hots"), F.collect_list("i").alias("at"))  # at most a head
    room = heads.join(touched, "doc").withColumn("short", F.size("head") - F.col("hots") < lead_of)
    room = cut_lineage(room.select("doc", "n", "short", F.filter(F.transform("head", lambda g, i: F.when(~F.array_contains("at", i), g)), lambda g: g.isNotNull()).alias("cold")))
    # documents short of other n-grams: their whole sets in the global order
    order = Window.partitionBy("doc", "n").orderBy("hot", "c", "g")
    whole = (_sets(docs, room.where("short").select("doc"), k).select("doc", "n", F.explode("grams").alias("g"))
             .join(met.where(F.col("c") > HOT), "g", "left").withColumn("hot", F.col("c").isNotNull())
             .withColumn("pos", (F.row_number().over(order) - 1).cast("long")).where(F.col("pos") < lead_of).select("g", "doc", "n", "pos"))
    whole = cut_lineage(whole)
    asked = cut_lineage(whole.select("g").distinct())
    others = (room.where(~F.col("short")).select("doc", "n", F.posexplode("cold").alias("pos", "g")).where(F.col("pos") < lead_of)
              .join(asked, "g", "left_semi").select("g", "doc", "n", F.col("pos").cast("long").alias("pos")))
    return cut_lineage(plain.union(whole).union(others).groupBy("g", "doc", "n").agg(F.min("pos").alias("pos")))


def _links(docs: DataFrame, heads: DataFrame, posts: DataFrame, k: int, percent: int) -> DataFrame:
    """Enough links (a, b) to join every pair of documents that is linked by a chain."""
    first = cut_lineage(posts.groupBy("g").agg(F.min(F.struct("doc", "n", "pos")).alias("x"), F.max("doc").alias("hi")).where("x.doc < hi").select("g", "x.*"))
    # counts here miss n-grams with another first document: what falls through is tried again below
    tried = cut_lineage(_promising(first.alias("x").join(posts.alias("y"), "g").where("x.doc < y.doc"), percent))
    found = _verified(tried, _sets(docs, _ends(tried), k), percent)
    known = cut_lineage(connected(found))
    rest = cut_lineage(_reaching(_across(heads, posts, known, percent), percent).join(tried, ["a", "b"], "left_anti"))
    return found.union(_verified(rest, _sets(docs, _ends(rest), k), percent))


def _across(heads: DataFrame, posts: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b, met, rest, both, longer) of pairs in different components that share first n-grams and are alike in size and parities.

    An n-gram belongs to the family of the component of its first document. The documents of a
    family outside that component meet all its documents, block by block, in one tree a block;
    small families share a task. A pair that meets in several families has a row for each.
    """
    state = heads.select("doc").distinct().join(known, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("at"))
    tagged = cut_lineage(posts.join(state, "doc").select("g", "doc", "n", "pos", "at"))
    # of each n-gram: the component of its first document, unless all its documents are in it
    main = cut_lineage(tagged.groupBy("g").agg(F.min_by("at", "doc").alias("main"), F.min("at").alias("lo"), F.max("at").alias("hi"))
                       .where("lo < hi").select("g", "main"))
    family = (tagged.join(main, "g").groupBy("main", "doc", "n", "at").agg(F.array_sort(F.collect_list(F.struct("g", "pos"))).alias("line"))  # within a head
              .join(heads.select("doc", "n", "odd"), ["doc", "n"])
              .select("main", "doc", "n", "at", "odd", F.col("line.g").alias("grams"), F.col("line.pos").alias("places")))
    family = cut_lineage(family)
    outside, length = F.col("at") != F.col("main"), F.size("grams")
    blocks = lambda rows, weight: F.ceil(F.greatest(rows / FAMILY, weight / WEIGHT, F.lit(1)))
    sizes = (family.groupBy("main").agg(F.sum(outside.cast("long")).alias("xs"), F.sum(F.when(outside, length).otherwise(0)).alias("xw"),
                                        F.count(F.lit(1)).alias("ys"), F.sum(length).alias("yw"))
             .withColumn("nx", blocks(F.col("xs"), F.col("xw"))).withColumn("ny", blocks(F.col("ys"), F.col("yw"))))
    sizes = cut_lineage(sizes)
    small = sizes.where("nx = 1 and ny = 1").agg(blocks(F.sum("ys"), F.sum("yw"))).first()[0] or 1
    dealt = (family.join(sizes.select("main", "nx", "ny"), "main").withColumn("one", F.expr("nx = 1 and ny = 1"))
             .withColumn("key", F.when(F.col("one"), F.pmod(F.xxhash64("main"), F.lit(small))).otherwise(F.col("main"))))
    row = ["one", "key", "doc", "n", "at", "main", "odd", "grams", "places"]
    block = lambda n: F.pmod(F.xxhash64("doc", "n"), F.col(n))
    asking = dealt.where(outside).select(*row, F.lit(True).alias("probe"), block("nx").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"))
    asked = dealt.select(*row, F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"), block("ny").alias("j"))
    return cut_lineage(asking.unionByName(asked).groupBy("one", "key", "i", "j")
                       .applyInArrow(lambda rows: family_pairs(rows, percent), "a long, b long, met long, rest long, both long, longer long"))


def family_pairs(block: pa.Table, percent: int) -> pa.Table:
    """The pairs of a block, each with the number of its n-grams in common, by one walk over the prefix tree of the asked documents.

    The walk carries the overlap of every asking document with the path; on a shared path it is
    counted once. ``rest`` is the most they can share behind their last meeting.
    """
    read = lambda name: np.asarray(block.column(name).combine_chunks())
    nested = lambda name: np.asarray(block.column(name).combine_chunks().flatten())
    doc, n, at, main, probe = (read(c) for c in ("doc", "n", "at", "main", "probe"))
    odd = nested("odd").reshape(-1, 4)
    lens = np.asarray(block.column("grams").combine_chunks().value_lengths()).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lens)])
    grams, places = nested("grams"), nested("places")
    values, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    order = np.empty(len(values), np.int64)
    order[np.lexsort((values, -counts))] = np.arange(len(values))  # frequent n-grams first: long shared paths
    ranked = order[inverse.ravel()]
    asking = np.flatnonzero(probe)
    seat = np.full(len(doc), -1)
    seat[asking] = np.arange(len(asking))
    owner = np.repeat(seat, lens)
    mine = np.flatnonzero(owner >= 0)
    mine = mine[np.argsort(ranked[mine], kind="stable")]
    holders = owner[mine]  # the asking documents of each n-gram, one n-gram after the other
    held = np.bincount(ranked[mine], minlength=len(values))
    begins = np.cumsum(held) - held
    lines = {int(i): np.sort(ranked[bounds[i]:bounds[i + 1]]) for i in np.flatnonzero(~probe)}
    members = sorted(lines, key=lambda i: lines[i].astype(">u4").tobytes())

    def further(overlap: np.ndarray, path: np.ndarray) -> np.ndarray:
        return overlap + np.bincount(batches.gather(holders, begins[path], held[path]), minlength=len(asking))

    out = []
    stack = [(0, np.zeros(len(asking), np.int64))]  # nodes of the path on which later documents branch off
    for at_member, i in enumerate(members):
        line = lines[i]
        depth, overlap = stack[-1]
        met = further(overlap, line[depth:])
        near = np.flatnonzero(met)
        if len(near):
            j = asking[near]
            fits = (at[j] != at[i]) & ((at[i] == main[j]) | (doc[j] < doc[i])) & (main[j] == main[i])
            fits &= 100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])
            j, m = j[fits], met[near[fits]]
            both = n[j] + n[i]
            fits = np.bitwise_count((odd[j] ^ odd[i]).view(np.uint64)).sum(axis=1) <= both - 2 * needed(n[j], n[i], percent)
            for x, shared in zip(j[fits].tolist(), m[fits].tolist(), strict=True):
                ours, theirs = slice(bounds[i], bounds[i + 1]), slice(bounds[x], bounds[x + 1])
                _, s, t = np.intersect1d(grams[ours], grams[theirs], assume_unique=True, return_indices=True)
                rest = min(int((n[i] - places[ours][s]).min()), int((n[x] - places[theirs][t]).min())) - 1
                out.append((min(doc[i], doc[x]), max(doc[i], doc[x]), shared, rest, n[i] + n[x], max(n[i], n[x])))
        if at_member + 1 < len(members):
            after = lines[members[at_member + 1]]
            size = min(len(line), len(after))
            differ = np.flatnonzero(line[:size] != after[:size])
            branch = int(differ[0]) if len(differ) else size
            while stack[-1][0] > branch:
                stack.pop()
            depth, overlap = stack[-1]
            if depth < branch:
                stack.append((branch, further(overlap, line[depth:branch])))
    columns = zip(*out, strict=True) if out else [[]] * 6
    return pa.table({name: pa.array([int(v) for v in column], pa.int64())
                     for name, column in zip(("a", "b", "met", "rest", "both", "longer"), columns, strict=True)})


def _promising(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of rows (x, y) that meet in an n-gram, as far as sizes, counts and places leave them a chance.

    Every n-gram the pair shares up to its last meeting is counted; behind it the shorter rest is
    the most they can share, and no more than what follows the first n-grams of the longer one.
    """
    least = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    pair = met.where(least).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"), F.lit(1).alias("met"),
                                   F.expr("least(x.n - x.pos, y.n - y.pos) - 1").alias("rest"),
                                   F.expr("x.n + y.n").alias("both"), F.expr("greatest(x.n, y.n)").alias("longer"))
    return _reaching(pair, percent)


def _reaching(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose meetings, summed over rows, leave them a chance."""
    pair = pairs.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("rest").alias("rest"), F.max("both").alias("both"), F.max("longer").alias("longer"))
    return (pair.withColumn("most", F.col("met") + F.least("rest", F.expr(f"cast(ceil({percent} * longer / 100) as bigint) - 1")))
            .where(f"{100 + percent} * most >= {percent} * both").select("a", "b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
