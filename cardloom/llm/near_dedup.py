"""Near-duplicate documents by bottom-k MinHash sketches.

Method
------
1. *Sketch.*  A document's set is its distinct 5-word shingles, hashed to 64 bits; one hash function orders them, and
   the ``SKETCH`` smallest are its bottom-k sketch.  Documents with equal sets (128-bit digest of the whole set) form
   one class; from here on only classes are compared.
2. *Inverted lists* of the ``LISTED`` smallest values.  Two sets with similarity s share one of them unless all of the
   union's ``LISTED`` smallest values are unshared: probability (1 - s) ** LISTED, about 2e-10 at 0.75.
3. *Stars.*  In every list the first member by a hash is the hub that every other member is paired with.  Lists that then
   still hold several components get more hubs, the smallest set and ``DRAWN`` - 1 members by other hashes, for pairs
   across components.  A list of m gives at most 5 m pairs however large its group of copies is, and the lists of one
   group mostly agree on their hubs, so most of these pairs are the same ones.
4. *Estimate.*  The union's own bottom-k sketch estimates a pair's similarity; pairs far below the threshold go
   (``ESTIMATE`` lies six standard errors below it).  *Verify.*  The rest are confirmed on full sets.
5. *Components* of the links.  Most lists now lie within one component and are done.
6. *Rest.*  In the lists that still hold several components, at most ``WIDE``, members of different components are
   paired; estimate and verification follow.  That finds the links of a document of whose listed values at most one is in
   a wider list: 15 of 16 are left, as surely as above.
7. *Common passages.*  Documents with two or more listed values in wider lists are joined on their whole sets, exactly.
   Shingles that the same of these documents hold are one *part* with a weight, so a passage is one part and not many
   shingles, and what a single document says takes no part.  Documents with equal parts form a group: two of them share
   just these parts, so if they are similar then each is similar to the smallest of the group, and the sizes alone tell.
   Across groups, if two documents are similar then so are each one and the other's smallest, and the two smallest;
   hence only the smallest of each group, and those not similar to theirs, are compared with the smallest of other
   groups.  Similar sets share a part among the rarest quarter of each (prefix filter), and what follows the first
   shared part bounds what they share; a pair is made there only.

Nothing about all documents reaches the driver: sketches lie in a written table, everything else is joins, aggregates
and checkpoints in the shared folder.

Defined cases: a null or wordless text has the empty set, ``component_id`` = its own ``doc_id`` and ``kept`` true; a
null ``doc_id`` takes part, but cannot be a component's id unless all of a component's ids are null; rows repeating a ``doc_id`` give one result row each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm import _shared, _text

SHINGLE = 5
SKETCH = 64
LISTED = 16
#: Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 75
ESTIMATE = 0.43
WIDE = 64
#: So many listed values in wide lists, and a document is compared by the parts of its whole set.
COMMON = 2
#: Links that one task joins into components (16 MB at most); more are contracted by rounds of joins first.
FEW_LINKS = 200_000
#: Hubs of a list that are drawn by a hash, besides the smallest set.
DRAWN = 4
#: Columns that name a part: in how many sets its shingles are, and two hashes of these sets.
PART = ["holders", "one", "two"]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle form one shingle together."""
    for block in _text.blocks(column):
        starts, ends = block.runs(_text.WORD_BYTE)
        first = np.searchsorted(starts, block.offsets)
        words = block.hashes(block.prefix(lower=True), starts, ends)
        windows = _text.combine(words, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(windows[a : b - SHINGLE + 1])
            elif b > a:
                yield _text.combine(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow lists of long; the unsigned order is kept by flipping the top bit."""
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]) ^ np.uint64(1 << 63)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _digests(sets: list[np.ndarray]) -> pa.Array:
    """A 128-bit digest of each set, null for the empty one."""
    return pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() if len(v) else None for v in sets], pa.binary())


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``cls`` (digest of the whole set, null if empty) and ``sketch`` of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, low = [], [], []
            for values in shingle_sets(batch.column(1)):
                counts.append(len(values))
                digests.append(_digests([values]))
                low.append(values[:SKETCH].copy())
            digest = pa.concat_arrays([pa.array([], pa.binary()), *digests])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), digest, _lists(low)],
                ["doc_id", "n_shingles", "cls", "sketch"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, cls binary, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``cls`` and ``whole``, the full shingle set, of every document that has one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list[np.ndarray] = []
            size = 0
            for values in shingle_sets(batch.column(0)):
                if not len(values):
                    continue
                part.append(values)
                size += len(values)
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([_digests(part), _lists(part)], ["cls", "whole"])
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([_digests(part), _lists(part)], ["cls", "whole"])

    return docs.select("text").mapInArrow(run, "cls binary, whole array<long>")


def _similar(shared: Column, a: Column, b: Column) -> Column:
    return shared * 100 >= (a + b - shared) * PERCENT


def _near_size(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose union sketch doesn't rule the similarity out."""
    for name in ("a", "b"):
        pairs = pairs.join(classes.selectExpr(f"cls {name}", f"n_shingles {name}_n", f"sketch {name}_sketch"), name)
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), F.col("merged")))
    pairs = pairs.where(_near_size("a_n", "b_n")).withColumn("merged", union)
    return pairs.where(shared >= F.size("merged") * ESTIMATE).select("a", "b")


def _whole(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Full sets of the wanted classes, as a written table; one text of each is read again."""
    ids = classes.join(wanted, "cls", "left_semi").select(F.col("rep").alias("wanted_id")).distinct()
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    return _shared.save(full_sets(texts).dropDuplicates(["cls"]), "whole")


def _ends(pairs: DataFrame) -> DataFrame:
    """The classes of the pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs that are similar on full sets."""
    for name in ("a", "b"):
        pairs = pairs.join(whole.select(F.col("cls").alias(name), F.col("whole").alias(f"{name}_whole")), name)
    shared = F.size(F.array_intersect("a_whole", "b_whole"))
    return pairs.where(_similar(shared, F.size("a_whole"), F.size("b_whole"))).select("a", "b")


def _joined(edges: DataFrame) -> DataFrame:
    """``node`` and ``to``, the smallest node that it is connected with, of few edges, by one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = sorted((root(x), root(y)))
                parent[high] = low
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.binary()), pa.array([root(x) for x in parent], pa.binary())], ["node", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node binary, to binary")


def _nearer(edges: DataFrame) -> DataFrame:
    """``node`` and ``to``: the smallest node around it and, once more, where that one goes."""
    both = edges.unionByName(edges.selectExpr("b a", "a b"))
    step = both.groupBy("a").agg(F.min("b").alias("to")).selectExpr("a node", "least(a, to) to")
    again = step.selectExpr("node mid", "to far")
    return step.join(again, F.col("to") == F.col("mid"), "left").selectExpr("node", "least(to, coalesce(far, to)) to")


def components(links: DataFrame) -> DataFrame:
    """``cls`` and ``comp`` for every node of the links (``a``, ``b``), the same ``comp`` for connected nodes.

    Edges are contracted by rounds in which every node moves to a smaller one near it; they are carried to the new nodes,
    so connected nodes stay connected.  Once few edges are left, one task joins them; the result is the same either way.
    """
    edges = _shared.save(links.where("a != b").distinct(), "edges")
    label = None
    while label is None or not edges.isEmpty():
        few = edges.count() <= FEW_LINKS
        step = _shared.save(_joined(edges) if few else _nearer(edges), "step")
        if label is None:
            label = step.withColumnsRenamed({"node": "cls", "to": "comp"})
        else:
            label = label.join(step, F.col("comp") == F.col("node"), "left").selectExpr("cls", "coalesce(to, comp) comp")
            label = _shared.save(label, "label")
        if few:
            break
        for end in ("a", "b"):
            moved = step.selectExpr(f"node {end}", f"to {end}_to")
            edges = edges.join(moved, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
        edges = _shared.save(_ordered(edges), "edges")
    return label


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(lists: DataFrame) -> DataFrame:
    """Pairs of members in different components, from lists (``v``, ``cls``, ``n``, ``comp``) of few components."""
    other = lists.selectExpr("v", "cls b", "n b_n", "comp b_comp")
    pairs = lists.withColumnsRenamed({"cls": "a", "n": "a_n"}).join(other, "v")
    return _ordered(pairs.where(F.col("comp") < F.col("b_comp")).where(_near_size("a_n", "b_n")).select("a", "b"))


def _stars(lists: DataFrame, label: DataFrame | None, orders: list[int]) -> DataFrame:
    """Pairs of each list's members with its hubs: the smallest set (order 0) or the first by a hash of that number.

    With ``label`` only lists of several components are left, and only pairs across components.
    """
    comp = lists.withColumn("comp", F.col("cls"))
    if label is not None:
        comp = lists.join(label, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        several = comp.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
        comp = _shared.save(comp.join(several.select("v"), "v"), "open")
    first = [F.min(F.struct("n", "cls", "comp") if k == 0 else F.struct(F.xxhash64("cls", F.lit(k)).alias("order"), "n", "cls", "comp")).alias(f"hub{k}") for k in orders]
    hubs = comp.groupBy("v").agg(*first).select("v", F.array_distinct(F.array(*(F.struct(f"hub{k}.n", f"hub{k}.cls", f"hub{k}.comp") for k in orders))).alias("hubs"))
    star = comp.join(hubs, "v").select(F.col("cls").alias("a"), "n", "comp", F.explode("hubs").alias("hub"))
    star = star.where(_near_size("n", "hub.n") & (F.col("comp") != F.col("hub.comp")))
    return _ordered(star.select("a", F.col("hub.cls").alias("b")))


def _rest(lists: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that the stars can have missed: members of different components in lists (``v``, ``cls``, ``n``) of few ones.

    Also the classes (``cls``) with several values in wider lists.
    """
    lists = lists.join(label, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    width = lists.groupBy("v", "comp").agg(F.lit(1)).groupBy("v").agg(F.count("*").alias("width")).where("width > 1")
    open_lists = _shared.save(lists.join(width, "v"), "open")
    pairs = _across(open_lists.where(F.col("width") <= WIDE).drop("width"))
    common = open_lists.where(F.col("width") > WIDE).groupBy("cls", "n").agg(F.count("*").alias("common"))
    return pairs, common.where(F.col("common") >= F.least("n", F.lit(COMMON))).select("cls")


def _parts(whole: DataFrame) -> DataFrame:
    """The parts of every set that has any: ``holders``, ``one``, ``two`` name a part, the rarest part comes first.

    ``shared`` is the weight of all parts of the set, ``rest`` that of this part and those after it.
    """
    flat = whole.select("cls", F.size("whole").cast("long").alias("n"), F.explode("whole").alias("v"))
    holders = flat.groupBy("v").agg(
        F.count("*").alias("holders"), F.bit_xor(F.xxhash64("cls")).alias("one"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("two")
    )
    parts = flat.join(holders.where("holders > 1"), "v").groupBy("cls", "n", *PART).agg(F.count("*").alias("weight"))
    of_set = Window.partitionBy("cls")
    shared = F.sum("weight").over(of_set)
    rest = F.sum("weight").over(of_set.orderBy(*(F.desc(c) for c in PART)).rowsBetween(Window.unboundedPreceding, 0))
    return parts.select("cls", "n", *PART, shared.alias("shared"), rest.alias("rest"))


def _common(whole: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links within groups of equal parts, and pairs across groups and components that can be similar."""
    parts = _shared.save(_parts(whole), "parts")
    members = parts.groupBy("cls", "n", "shared").agg(
        F.bit_xor(F.xxhash64("one", "two")).alias("g1"), F.bit_xor(F.xxhash64("two", "holders", "one")).alias("g2")
    )
    smallest = members.groupBy("g1", "g2").agg(F.min(F.struct("n", "cls")).alias("hub"))
    members = members.join(smallest, ["g1", "g2"]).withColumn("is_hub", F.col("cls") == F.col("hub.cls"))
    members = _shared.save(members.withColumn("like_hub", _similar(F.col("shared"), F.col("n"), F.col("hub.n"))), "members")
    links = members.where("like_hub and not is_hub").select(F.col("cls").alias("a"), F.col("hub.cls").alias("b"))

    asking = members.where("is_hub or not like_hub").select("cls", "is_hub")
    rows = parts.where(F.col("rest") * 100 >= F.col("n") * PERCENT).join(asking, "cls")
    rows = rows.join(label.select("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = _shared.save(rows.select("cls", "n", "is_hub", "comp", "rest", *PART), "asking")
    several = rows.groupBy(*PART).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    earlier = Window.partitionBy("cls").orderBy(*PART)
    rows = rows.join(several, PART, "left_semi")
    rows = rows.withColumn("earlier", F.collect_list(F.xxhash64(*PART)).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    hubs = rows.where("is_hub").select(*PART, *(F.col(c).alias(f"b_{c}") for c in ("cls", "n", "comp", "rest", "earlier")))
    met = (F.col("comp") != F.col("b_comp")) & _near_size("n", "b_n") & (~F.col("is_hub") | (F.col("cls") < F.col("b_cls")))
    met = met & _similar(F.least("rest", "b_rest"), F.col("n"), F.col("b_n")) & ~F.arrays_overlap("earlier", "b_earlier")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in PART]
    pairs = rows.alias("x").join(hubs.alias("y"), [*same, met])
    return links, _ordered(pairs.select(F.col("cls").alias("a"), F.col("b_cls").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    rows = _shared.save(sketches(docs), "sketches")
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = _shared.save(classes, "classes")
    lists = classes.select("cls", F.col("n_shingles").alias("n"), F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    shared = lists.groupBy("v").agg(F.count("*").alias("members")).where("members > 1").select("v")
    shared_lists = _shared.save(lists.join(shared, "v"), "lists")
    links = label = None
    for orders in ([1], [0, *range(2, DRAWN + 1)]):  # one hub a list joins most of what belongs together
        pairs = _shared.save(_estimated(_stars(shared_lists, label, orders), classes), "pairs")
        whole = _whole(_ends(pairs), docs, classes)
        found = _verified(pairs, whole)
        links = _shared.save(found if links is None else links.unionByName(found), "links")
        _shared.drop(whole, pairs)
        label = components(links)
    pairs, common = _rest(shared_lists.select("v", "cls", "n"), label)
    pairs, common = _shared.save(_estimated(pairs, classes), "pairs"), _shared.save(common, "common")
    if not (pairs.isEmpty() and common.isEmpty()):
        whole = _whole(_ends(pairs).unionByName(common), docs, classes)
        alike, more = _common(whole.join(common, "cls", "left_semi"), label)
        pairs = pairs.unionByName(_estimated(_shared.save(more, "pairs"), classes)).distinct()
        links = _shared.save(links.unionByName(alike).unionByName(_verified(pairs, whole)), "links")
        _shared.drop(whole)
        label = components(links)

    reach = classes.select("cls", "rep").join(label, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = reach.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = reach.join(smallest, "comp").select("cls", "component_id")
    out = rows.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
